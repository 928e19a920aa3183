import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm.queries import ORACLE_SQL, QUERIES

from ..helpers import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], ORACLE_SQL[name])


def test_pipeline_keeps_what_is_clean(spark, tmp_path):
    import random

    rng = random.Random(4)
    prose = lambda n, s: " ".join(f"{random.Random(s * 1000 + i).choice('bdfgklmnprst')}a{random.Random(s * 7919 + i).randrange(900)}" for i in range(n))
    texts = [prose(80, i) for i in range(60)]
    bad = ["!! ".join(w.upper() for w in prose(60, 500 + i).split()) for i in range(40)]
    shared_passage = prose(60, 999)
    leak = prose(30, 777)
    texts += [texts[0], texts[1] + " extra", prose(50, 61) + " " + shared_passage, prose(50, 62) + " " + shared_passage, prose(40, 63) + " " + leak, None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*texts, *bad])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, 1, 0) for i in range(60)] + [(len(texts) + i, 0, 0) for i in range(30)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step, ids = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path)).cache()
        ids[name] = {r["doc_id"]: r for r in step.collect()}
        assert set(docs.columns) <= set(step.columns)
    good = set(range(60))
    assert good <= set(ids["quality_classifier"]) and not any(i >= len(texts) + 30 for i in ids["quality_classifier"])
    assert good <= set(ids["minhash_near_dedup"]) and not {60, 61} & set(ids["minhash_near_dedup"])
    assert shared_passage in ids["substring_dedup"][62]["text"] and shared_passage not in ids["substring_dedup"][63]["text"]
    assert 64 not in ids["benchmark_decontamination"] and good <= set(ids["benchmark_decontamination"])
    assert all(1 <= r["copies"] <= 3 for r in ids["source_mixing"].values())
    assert rng is not None
    total = sum(r["taken"] for r in ids["source_mixing"].values())
    assert abs(total - sum(len((r["text"] or "").split()) for r in ids["benchmark_decontamination"].values())) < 400


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 0, 0), (2, 0, 0)], [(0, 1, 0), (1, 0, 0)]])
def test_nothing_is_rejected_without_a_classifier(spark, tmp_path, labels):
    docs = spark.createDataFrame([(0, "long " * 20_000, "en", "s", 100_000), (1, "some text", "en", "s", 9), (2, "other text", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).collect()} == {0, 1, 2}


def test_stages_keep_clashing_columns_and_distinct_texts(spark, tmp_path):
    """Columns named like helpers, null ids, repeated rows, two texts of one id and a very long text, through every stage."""
    prose = lambda n, s: " ".join(f"{chr(97 + (s * 31 + i * 7) % 26)}{(s * 7919 + i * i * 13) % 997}" for i in range(n))
    rows = [(i, prose(40, i)) for i in range(1, 30)] + [(7, prose(60, 500)), (7, prose(60, 500)), (None, prose(50, 600)), (None, prose(50, 601)), (None, prose(50, 601)), (40, " ".join(f"l{i}" for i in range(150_000))), (41, None), (42, "")]
    names = ("text_hash", "hit_id", "hit_key", "t_id", "t_source", "t_size", "row", "row_number", "mixed_row", "k", "h", "n", "key", "kept", "carry", "n_removed", "n_words", "kept_text", "quality_score", "size", "id", "copy")
    docs = spark.createDataFrame([(i, t, "en", f"s{n % 2}", len(t or "")) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(c).alias(c) for c in names])
    spark.createDataFrame([(1, prose(30, 2))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step, left = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path)).cache()
        assert step.columns[: len(docs.columns)] == docs.columns
        got = step.collect()
        assert all(r[c] == c for r in got for c in names)
        left[name] = sorted(((r["doc_id"], len((r["text"] or "").split())) for r in got), key=str)
    assert len(left["quality_classifier"]) == len(rows)
    # The repeated row and the repeated text without an id are gone, the second text of id 7 stays.
    assert left["minhash_near_dedup"] == sorted([(i, len((t or "").split())) for i, t in rows if not (i is None and t == prose(50, 601)) and i != 7] + [(7, 40), (7, 60), (None, 50)], key=str)
    assert left["substring_dedup"] == left["minhash_near_dedup"]
    assert left["benchmark_decontamination"] == [x for x in left["substring_dedup"] if x[0] != 2]
    assert step.agg(F.sum("taken")).first()[0] > 0


def test_repeated_rows_are_mixed_one_by_one(spark, tmp_path):
    rows = [(1, "a b c", "en", "x", 5)] * 40 + [(2, "d e f g", "en", "y", 7)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.source_mixing(spark, docs, str(tmp_path)).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    targets = {"x": 280 * 5 / 7, "y": 280 * 2 / 7}
    assert all(abs(r["t"] - targets[r["source"]]) <= 4 for r in out)
