"""Prefix propagation, import hubs and connected components, as iterated joins."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_degree_hubs(edges: DataFrame, most: int = 40) -> DataFrame:
    """Per project the targets of the most distinct sources, ties by name."""
    from .rule_hits import top

    return top(edges.select("project", "src", "dst").distinct().groupBy("project", "dst").agg(F.count(F.lit(1)).alias("hub_score")), ["project"], [F.desc("hub_score"), F.col("dst")], most)


def propagate_prefixes(mounts: DataFrame, roots: DataFrame, join, depth: int | None = None) -> DataFrame:
    """Prefix of every file that roots (project, file, prefix) reach over mounts (project, src, dst, prefix).

    The shortest prefix counts, ties in order of the alphabet, so cycles and double mounts
    end: a file's prefix only ever gets less. ``join`` joins a prefix and a mount's. Each
    round extends only what the last one changed, until nothing changes, so there are as many
    as the longest chain of mounts has; its plan is cut by a checkpoint. With a ``depth``
    only chains of as many mounts count.
    """
    better = lambda df: df.groupBy("project", "file").agg(F.min(F.struct(F.length("prefix").alias("n"), F.col("prefix").alias("p"))).alias("b")).select("project", "file", F.col("b.p").alias("prefix"))
    known = checkpointed(better(roots.select("project", "file", "prefix")))
    front = known
    for _ in itertools.count() if depth is None else range(depth):
        m = mounts.select("project", F.col("src").alias("file"), "dst", F.col("prefix").alias("own"))
        reached = better(front.join(m, ["project", "file"]).select("project", F.col("dst").alias("file"), join(F.col("prefix"), F.col("own")).alias("prefix")))
        old = known.withColumnRenamed("prefix", "old")
        new = reached.join(old, ["project", "file"], "left").filter(F.col("old").isNull() | (F.struct(F.length("prefix"), F.col("prefix")) < F.struct(F.length("old"), F.col("old")))).select("project", "file", "prefix")
        front = checkpointed(new)
        if front.isEmpty():
            break
        known = checkpointed(better(known.unionByName(front)))
    return known


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node with the smallest node of its component; edges (a, b) have no direction.

    Labels run along the edges and are halved by following the label's own label, so the
    number of rounds grows with the logarithm of a component's extent.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    label = checkpointed(nodes.select("node").distinct().withColumn("comp", F.col("node")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = label.join(near, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        after = checkpointed(step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        label = after.select("node", "comp")
        if after.filter("comp <> old").isEmpty():
            return label


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the plan in the folder of spark.checkpoint.dir; where all runs in one process and there is none, in a folder of our own."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            import tempfile

            folder = tempfile.mkdtemp(prefix="auditloom-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
