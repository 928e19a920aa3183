"""Sums and last values along large groups, and the plans of what uses them."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import running, scan
from auditloom.plans import views


@pytest.mark.parametrize("spread", [1, 7])
def test_totals_and_last_values_equal_plain_ones(spark, spread):
    rng = random.Random(spread)
    rows = [(g, i, rng.randrange(10), rng.choice([None, i])) for g in "abc" for i in rng.sample(range(1000), 300 if g == "a" else 5)]
    df = spark.createDataFrame(rows, "g string, i int, n int, v int").repartition(4)
    want, last = {}, {}
    for g in "abc":
        total, count, seen = 0, 0, None
        for _, i, n, v in sorted(r for r in rows if r[0] == g):
            want[g, i], last[g, i] = (total, count), seen
            total, count, seen = total + n, count + 1, seen if v is None else v
    got = running.running_totals(df, ["g"], ["i"], {"t": F.col("n"), "c": F.lit(1)}, spread=spread)
    assert {(r["g"], r["i"]): (r["t"], r["c"]) for r in got.collect()} == want
    cut = running.running_totals(df, ["g"], ["i"], {"t": F.col("n"), "c": F.lit(1)}, {"t": 400, "c": 50}, spread=spread)
    assert {(r["g"], r["i"]) for r in cut.collect()} == {k for k, (t, c) in want.items() if t < 400 and c < 50}
    found = running.last_before(df, ["g"], ["i"], F.col("v"), "before", spread)
    assert found.columns == ["g", "i", "n", "v", "before"] and {(r["g"], r["i"]): r["before"] for r in found.collect()} == last
    assert running.last_before(df.limit(0), ["g"], ["i"], F.col("v"), "before").count() == 0


def test_texts_take_no_part_in_the_budget(spark):
    df = spark.createDataFrame([("p", 1, k, "x" * 50) for k in range(30)], "project string, file_rank int, chunk_idx int, content string")
    out = scan.within_budgets(df, 20, 520)
    assert sorted((r["chunk_ordinal"], len(r["content"])) for r in out.collect()) == [(k, 50) for k in range(1, 11)] + [(11, 20)]
    assert scan.within_budgets(df, 4, 10_000).count() == 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line]
    assert windows and not any("content" in line for line in windows)


def test_all_grains_come_from_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, "High", None, 2), (1, "", "confirmed", 3)], "task_id long, severity string, review_status string, stage_num int").write.parquet(f"{tmp_path}/f")
    out = views.snapshot_grains(spark.read.parquet(f"{tmp_path}/f"))
    assert {(r["grain"], r["severity"], r["review_status"], r["stage_num"], r["n"]) for r in out.collect()} == {
        ("total", None, None, None, 2), ("severity", "High", None, None, 1), ("severity", "Unknown", None, None, 1), ("review", None, "unreviewed", None, 1), ("review", None, "confirmed", None, 1),
        ("stage", None, None, 2, 1), ("stage", None, None, 3, 1), ("severity_review", "High", "unreviewed", None, 1), ("severity_review", "Unknown", "confirmed", None, 1),
    }
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
