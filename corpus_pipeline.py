"""The corpus pipeline: each stage's result is written as Parquet and reread as the next one's documents.

Stages take (spark, docs, sf_dir) and work on whatever ``docs`` holds: null texts are empty,
an empty table goes through as such, and columns beyond those of ``documents`` are kept,
whatever their names. Distinct texts under one id are documents of their own, in the order
of their texts' hashes; documents without an id come last in every order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import decontam, mixing, neardup, quality, substrings
from auditloom.llm.shared import Cut, fresh, keyed, own_keys, small, table

#: A sampling and its landing cannot be said in SQL, nor can a compression score; the stages are tested one by one.
ORACLE_SQL = None
#: Documents under this score are rejected.
LEAST_QUALITY = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labels, does not reject; all where none could be fitted.

    Rows are judged one by one by their texts, so repeated rows stay or go together.
    """
    model = quality.train_model(docs, table(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs
    score = fresh(docs, "quality_score")
    return quality.score_quality(docs, model, score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group of near duplicates; texts without a word are in no group.

    Of rows that share id and text one stays, that of the least hash over all columns.
    """
    texts, ids = keyed(docs.select("doc_id", "text"))
    keep = Cut(neardup.near_duplicates(texts, shingle=5, percent=80, doc_id="k").filter("kept").select(F.col("doc_id").alias("k"))).df
    if ids is None:
        key = fresh(docs, "kept_id")
        keep = keep.withColumnRenamed("k", key)
        return docs.join(small(keep), F.col("doc_id").cast("long") == F.col(key), "left_semi")
    wanted = ids.join(keep, "k").select(F.struct("doc_id", "h").alias("kept_key"))
    one = docs.groupBy(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))).alias("row"))
    return one.join(wanted, F.col("key").eqNullSafe(F.col("kept_key")), "left_semi").select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that start earlier elsewhere; those with no word left go."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = substrings.drop_repeats(docs, with_text=True, carry=others).filter("n_removed = 0 OR n_removed < n_words")
    kept = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[(kept[c] if c in kept else F.col("carry")[c]).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Rows that share id and text stay or go together."""
    hit = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select(F.struct("doc_id", "text_hash").alias("hit")).distinct()
    key = fresh(docs, "hit_key")
    own = F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    return docs.join(small(Cut(hit.withColumnRenamed("hit", key)).df), own.eqNullSafe(F.col(key)), "left_anti")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with copies (how often) and taken (words, repeats counted); columns of these names are replaced.

    Every row is sampled on its own, repeated rows as well.
    """
    docs = docs.drop("copies", "taken")
    if own_keys(docs):
        mixed = mixing.mix_sources(docs).select(F.col("doc_id").alias("row"), "copies", "taken")
        numbered, row = docs, "doc_id"
    else:
        row = fresh(docs, "row_number")
        numbered = Cut(docs.withColumn(row, F.monotonically_increasing_id())).df
        mixed = mixing.mix_sources(numbered, row=row).select("row", "copies", "taken")
    key = fresh(numbered, "mixed_row")
    taken = Cut(mixed.filter("copies > 0").withColumnRenamed("row", key)).df
    out = numbered.join(small(taken), F.col(row) == F.col(key)).drop(key)
    return out if row == "doc_id" else out.drop(row)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = Cut(stage(spark, docs, sf_dir)).df
    return docs
