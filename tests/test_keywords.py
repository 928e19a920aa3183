"""Keywords found in one pass, against looking for each of them."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditloom.functions import keywords
from auditloom.functions.rules import ALL_KEYWORDS
from auditloom.operators import rule_hits, scan

LISTS = [list(ALL_KEYWORDS["rce"]), ["a", "é", "ab", "ab", "", "注入"], ["aaa", "aab", "x" * 40], [], list(ALL_KEYWORDS["config"])]
EDGE = [None, "", "a", "ab", "é", "aa", "aab", "注", "注入", "x" * 39, "x" * 40, "exec", "(exec( eval(", "\x00exec(\x00"]


def texts(seed, n=300):
    rng = random.Random(seed)
    words = [w for ws in LISTS for w in ws] + ["plain ", "ex", "ec(", "é", "\n", "注", "入", "aa"]
    return EDGE + ["".join(rng.choice(words)[: rng.randrange(1, 30)] + rng.choice(["", " "]) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("piece", [3, 64, 1 << 20])
def test_first_places_equal_those_of_each_search(piece, monkeypatch):
    monkeypatch.setattr(keywords, "PIECE", piece)
    index = keywords.KeywordIndex([w for ws in LISTS for w in ws])
    rows = texts(piece, 300 if piece > 3 else 40)
    for array in (pa.array(rows), pa.array(["lead", *rows, "tail"]).slice(1, len(rows)), pa.array(rows, pa.large_string())):
        got = index.first(array)
        for t, own in zip(rows, got.tolist(), strict=True):
            raw = (t or "").encode()
            assert own == [p if (p := raw.find(w.encode())) >= 0 else keywords._NONE for w in index.words]
    assert index.first(pa.array([], pa.string())).shape == (0, len(index.words))


def test_columns_count_place_and_list(spark):
    rows = texts(9)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").repartition(3)
    out = df.select("i", keywords.keyword_counts("t", LISTS).alias("n"), keywords.keywords_first("t", LISTS).alias("at"), keywords.keywords_held("t", LISTS).alias("held")).collect()
    for r in out:
        t = rows[r["i"]] or ""
        held = [[w for w in ws if w in t] for ws in LISTS]
        assert r["n"] == [len(h) for h in held] and r["held"] == held
        assert r["at"] == [min((len(t[: t.find(w)].encode()) for w in h), default=None) for h in held]


def test_texts_are_read_once_whatever_the_number_of_keywords(spark):
    """One pass for all labels of a chunk, and no search for each keyword, in the plans."""
    chunks = spark.createDataFrame([(1, 1, "a.py", "a.py", "full", "exec(x)")], "project int, chunk_ordinal int, file_path string, base_file_path string, chunk_type string, content string")
    scored = scan.with_risk(chunks)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "exists(" not in plan and plan.count("filter(split(") <= 1
    plan = rule_hits.rule_hits(scored.withColumn("x", F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3


def test_workers_are_handed_few_texts_at_a_time(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    sizes = spark.range(3000).coalesce(1).select(keywords.keyword_counts(F.repeat(F.lit("x"), F.col("id").cast("int")), [["xx"]]).alias("n"))
    assert [r["n"][0] for r in sizes.collect()] == [0, 0] + [1] * 2998
    assert int(spark.conf.get(key)) <= 1000
