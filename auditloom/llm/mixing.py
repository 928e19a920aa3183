"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target of words; its documents repeat ``floor(target / size)`` times
and the fraction that is left is every document's inclusion probability. The cube method
moves these probabilities through the null space of two constraints (the number of
documents and the number of words), so both totals stay as they were, until a document's
probability is 0 or 1. Sources are dealt into blocks by a hash, so a hot source is many
small tasks; the two documents at most that a block leaves undecided meet in larger
blocks, until one block a source is left, whose last two are landed. A source that fits a
block is landed at once with all its documents; of a larger one some that are decided
before, half a block about, come to the last block to even out with.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, small

#: Documents of a block, about.
BLOCK = 4096
_EPS = 1e-9


def n_words(text: Column) -> Column:
    """Number of runs of other than ASCII white space; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """Targets of sources (source, source_size, n_docs): adds target, double.

    Weights go to the sources by code point, null last, and repeat. A target over ``most``
    times its source's size stops there and the excess is shared anew by weight until none
    is above. That is a water level: sources in order of limit over weight are limited one
    after another for as long as the level reaches them. One row a source is sorted here.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", (F.col("source_size") * most).cast("double"))
    all_of = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*", (F.sum("source_size").over(all_of) * share).alias("total"), F.sum("weight").over(all_of).alias("weights"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("used"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("gone"),
    ).withColumn("full", (F.col("total") - F.col("used")) * F.col("weight") > F.col("limit") * (F.col("weights") - F.col("gone")))
    spare = F.first("total").over(all_of) - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(all_of)
    left = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(all_of)
    return level.select("source", "source_size", "n_docs", F.when(F.col("full"), F.col("limit")).otherwise(spare * F.col("weight") / left).alias("target"))


def flight(p: list[float], size: list[int], draws: np.ndarray) -> list[int]:
    """Move ``p`` in place along null vectors of the constraints (1, size); returns the two undecided at most."""
    active: list[int] = []
    step = iter(draws)
    for j in range(len(p)):
        if not _EPS < p[j] < 1 - _EPS:
            p[j] = float(round(p[j]))
            continue
        active.append(j)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1, -1, 0)
        up = down = math.inf
        for i, v in zip(active, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, p[i] / -v), min(down, (1 - p[i]) / -v)
        move = up if next(step) * (up + down) < down else -down
        for i, v in zip(active, u, strict=True):
            p[i] += move * v
        active = [i for i in active if _EPS < p[i] < 1 - _EPS]
        for i in (a, b, c):
            if i not in active:
                p[i] = float(round(p[i]))
    return active


def land(p: list[float], size: list[int], active: list[int]) -> None:
    """Decide the last ones: of their roundings, that whose words come nearest to the expected ones, then whose count does.

    A very long document tends to be among them, so what is then missing or too much is
    evened out by turning single documents of the block, as long as that comes nearer.
    """
    words, count = sum(p[i] * size[i] for i in active), sum(p[i] for i in active)
    best = min(range(1 << len(active)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(active) if m >> k & 1) - words), abs(m.bit_count() - count), m))
    off = words
    for k, i in enumerate(active):
        p[i] = float(best >> k & 1)
        off -= p[i] * size[i]
    change = np.where(np.array(p) > 0.5, -1, 1) * np.array(size, np.int64)
    for _ in range(len(p)):
        i = int(np.abs(off - change).argmin()) if len(p) else 0
        if not len(p) or abs(off - change[i]) >= abs(off):
            break
        off -= change[i]
        p[i], change[i] = 1 - p[i], -change[i]


def _round(block: int, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "size", *(["row"] if "row" in pdf else [])], kind="stable", ignore_index=True)
        p, size = pdf["p"].tolist(), pdf["size"].tolist()
        rng = np.random.default_rng([seed, int(key[0]), int(key[1]), len(p)])
        active = flight(p, size, rng.random(len(p)))
        if pdf["n_docs"].iloc[0] <= block:
            land(p, size, active)
        pdf["p"] = p
        return pdf

    return run


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 17, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies (0 to ``most``), taken (copies times size)[, row].

    ``row`` names a column that tells rows apart where ids don't; it is carried along.
    Null and empty texts have size 0 and are never taken; a source whose texts are all
    empty has target 0. Null is a source of its own, last in order. Repeated rows are
    sampled one by one; equal rows are interchangeable. Every draw follows from ``seed``
    and the rows themselves, so reruns agree whatever the partitioning. An empty table gives
    an empty result. Extra columns are ignored.
    """
    # Texts are split once; everything below reads the sizes.
    more = [F.col(f"`{row}`").alias("row")] if row else []
    docs = cut(documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), *more))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n_docs"))
    targets = cut(source_targets(sizes, weights, share, most).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("ratio") + _EPS)
    state = (
        docs.alias("d").join(small(targets).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "d.source", "source_no", "size", "source_size", "n_docs", "target", ratio.alias("ratio"), *["row"] * bool(row))
        .withColumn("whole", whole.cast("int"))
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0))).otherwise(0.0))
        .withColumn("order", F.xxhash64("doc_id", "size", F.lit(seed))).drop("ratio")
    )
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    blocks = F.ceil(F.col("n_docs") / block)
    open_ = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    # Documents that a source of several blocks keeps for evening out.
    spare = open_ & (F.col("n_docs") > block) & (F.pmod(F.xxhash64("order", F.lit(-1)), F.ceil(2 * F.col("n_docs") / block)) == 0)
    state = state.withColumn("spare", spare)
    done = []
    while True:
        last = most_docs <= block
        # A flight of fewer sources' blocks: those already whole pass through with their p.
        key = F.pmod(F.xxhash64("order", F.lit(len(done))), F.greatest(blocks, F.lit(1)))
        here = state.filter(open_ | F.col("spare")).withColumn("block", key)
        moved = here.groupBy("source_no", "block").applyInPandas(_round(block, seed), here.schema).drop("block")
        if not done:
            moved = moved.unionByName(state.filter(~open_))
        if last:
            done.append(moved)
            break
        moved = cut(moved)
        going = open_ | (F.col("spare") & (F.col("n_docs") > block))
        done.append(moved.filter(~going))
        # A block leaves two undecided at most.
        state = moved.filter(going).withColumn("n_docs", 2 * F.ceil(F.col("n_docs") / block))
        most_docs = 2 * math.ceil(most_docs / block)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.round("p").cast("int")).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *["row"] * bool(row))
