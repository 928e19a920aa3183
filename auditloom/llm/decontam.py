"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Every benchmark item becomes windows of ``window`` consecutive words (an item with
fewer words, but not none, is one window). The words of a window are its one-word
shingles. They are ordered by rarity over the whole corpus; a window that is wholly
contained in a document needs each of them, so a prefix of one, its rarest, is enough
to find every place. Documents meet windows on that token; the positional bound (the
window must begin at word 0 or later) and the length bound (it must end at the last
word or before) drop places that can't hold it, and the words at that place are then
compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, Cut, within

#: What separates words, once A-Z are lower-cased: ASCII other than digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text; none for null. Never null itself, so the optimizer adds no second split to test it."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def item_windows(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """Distinct windows with the ids of all items that have them: win (words), n, items."""
    words = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter((F.size("w") > 0) & F.col("item").isNotNull())
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(window)))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("n", F.size("win"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, n_items, items (sorted array), spans (array of start, length).

    A word is hit if it lies in any occurrence of a window. Null and empty texts, of
    documents and items, have no words and hit nothing; an empty benchmark leaves every
    document clean; repeated items and windows are found once and credited to every item
    that has them; items without an id are ignored. A doc_id that occurs on several rows
    gives a row each, judged by its own text (``text_hash``: xxhash64 of it). Extra columns are ignored.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    windows = item_windows(benchmark, window, item_id, item_text)
    tokens = windows.select(F.explode("win").alias("token")).distinct()
    few = within(windows, broadcast_rows // 10)
    hint = F.broadcast if few else (lambda df: df)
    # The outer forms of explode keep the optimizer from splitting each text a second time to test for emptiness.
    seen = docs.select(F.explode_outer(words_of(F.col("text"))).alias("token")).join(hint(tokens), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    ranked = tokens.join(hint(seen), "token", "left").select("token", F.coalesce("seen", F.lit(0)).alias("seen"))
    place = windows.select("win", "n", "items", F.posexplode("win").alias("at", "token")).join(hint(ranked), "token")
    # A window without any token in the corpus occurs nowhere; the rarest token is its necessary prefix.
    prefix = place.groupBy("win").agg(F.first("n").alias("n"), F.first("items").alias("items"), F.min(F.struct("seen", "token", "at")).alias("p")).filter("p.seen > 0").select("win", "n", "items", F.col("p.token").alias("token"), F.col("p.at").alias("at"))
    # Rows with the same id and text have the same hits, so they may share a key.
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    split = docs.select(key.alias("key"), words_of(F.col("text")).alias("w"))
    fits = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("n") <= F.col("size"))
    start = (F.col("pos") - F.col("at")).alias("start")
    if few:
        spots = split.select("key", "w", F.size("w").alias("size"), F.posexplode_outer("w").alias("pos", "token")).join(hint(prefix), "token").filter(fits).select("key", "w", start, "n", "win", "items")
    else:
        # Positions move without the text; words are joined back only to documents that have places left, with the windows by number.
        numbered = Cut(prefix.withColumn("no", F.monotonically_increasing_id())).df
        each = split.select("key", F.size("w").alias("size"), F.posexplode_outer("w").alias("pos", "token"))
        places = each.join(numbered.select("token", "at", "n", "no"), "token").filter(fits).groupBy("key", "no").agg(F.collect_set(start).alias("starts"))
        opened = places.join(split.dropDuplicates(["key"]), "key").join(numbered.select("no", "n", "win", "items"), "no")
        spots = opened.select("key", "w", F.explode("starts").alias("start"), "n", "win", "items")
    found = spots.filter(F.slice("w", F.col("start") + 1, F.col("n")) == F.col("win")).select("key", F.struct("start", F.col("n").alias("len")).alias("span"), "items")
    per_doc = found.groupBy("key").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["start"] + s["len"]).alias("end"), (acc["hit"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(s["start"], acc["end"]))).cast("long").alias("hit")),
    )["hit"]
    hits = per_doc.select("key", covered.alias("n_hit"), "items", "spans")
    counted = docs.select(key.alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(hits, "key", "left").select(
        F.col("key.doc_id").alias("doc_id"), F.col("key.text_hash").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
    )
