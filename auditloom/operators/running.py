"""Sums and last values along the order of a group, however large the group is.

Rows are dealt by range of (group, order), so that a group is many tasks' work; what a
range's rows need of the ranges before it comes from one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import checkpointed

#: How many ranges rows are dealt to.
SPREAD = 64


def _ranged(rows: DataFrame, by: list[str], order: list[str], spread: int) -> DataFrame:
    return checkpointed(rows.repartitionByRange(spread, *by, *order).withColumn("_part", F.spark_partition_id()))


def running_totals(rows: DataFrame, by: list[str], order: list[str], values: dict[str, Column], limits: dict[str, int] | None = None, spread: int = SPREAD) -> DataFrame:
    """by, order and, named as in ``values``, the sums over the rows of the group before; where ``limits`` are given, only rows whose sums are all under theirs.

    ``order`` tells the rows of a group apart; sums of values that aren't negative let whole
    ranges beyond a limit be left out before their rows are summed.
    """
    limits = limits or {}
    ranged = _ranged(rows.select(*by, *order, *[v.cast("long").alias(f"_v_{k}") for k, v in values.items()]), by, order, spread)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy(*by, "_part").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    start = whole.select(*by, "_part", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values])
    for k, most in limits.items():
        start = start.filter(F.col(f"_b_{k}") < most)
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.join(start, [*by, "_part"])
    out = near.select(*by, *order, *[(F.col(f"_b_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0))).alias(k) for k in values])
    for k, most in limits.items():
        out = out.filter(F.col(k) < most)
    return out


def last_before(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, spread: int = SPREAD) -> DataFrame:
    """Rows with ``name``: the value, where it isn't null, of the last row of the group that comes earlier in the order; null if there is none. Of rows alike in the order any may come first."""
    ranged = _ranged(rows.withColumn("_v", value), by, order, spread)
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy(*by, "_part").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct(*order, "_v")))["_v"].alias("_end"))
    carried = ends.select(*by, "_part", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    met = ranged.withColumn("_own", F.last("_v", ignorenulls=True).over(inside)).join(carried, [*by, "_part"])
    return met.withColumn(name, F.coalesce("_own", "_carry")).drop("_v", "_own", "_carry", "_part")
