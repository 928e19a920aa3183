"""Cases of earlier operators at their edges: pieces of long texts, crowded sources, nulls, repeats and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.llm import decontam, substrings, urlfilter, warc

from .test_operators import brute_repeats, documents, words


def removed(df):
    return [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize(("name", "value"), [("PIECE", 50), ("PIECE", 333), ("SPANS", 2)])
def test_repeats_whatever_is_read_at_a_time(spark, monkeypatch, name, value):
    """Texts that are cut into pieces, repeats that lie across the cuts, and a source of which many spans are asked."""
    monkeypatch.setattr(substrings, name, value)
    rng = random.Random(value)
    base = words(2000, 1, 5000)
    texts = [" ".join(base)]
    for i in range(30):
        parts = []
        for _ in range(4):
            a = rng.randrange(1950)
            parts += base[a : a + rng.randrange(15, 90)] + words(rng.randrange(20), 100 + i, 3000)
        texts.append(" ".join(parts))
    texts += [" ".join(base[::-1] + base), " ".join(base[30:1500]), "a b c " * 400]
    assert removed(substrings.drop_repeats(documents(spark, texts))) == brute_repeats(texts)


def test_captures_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "http://a.org/x", "2024-01-05"), (1, "http://a.org/x", "2024-01-05"), (2, None, "2024-01-05"), (3, "http://a.org/x", None), (None, "http://a.org/x", "2024-01-05"), (4, "", "2024-01-05"), (5, "no url", "2024-01-05"), (6, "http://a.org/" + "y" * 50_000, "2024-02-05")]
    caps = spark.createDataFrame(rows, "page_id long, url string, d string").select("page_id", "url", F.to_date("d").alias("fetched_on"))
    caps = caps.withColumns({c: F.lit("clash") for c in ("key", "host", "lists", "blocked", "list_name", "valid_from", "valid_to", "n", "capture", "u")})
    changes = spark.createDataFrame([("bad", "h:a.org", "add", "2024-01-01"), ("bad", "h:a.org", "remove", "2024-02-01"), ("bad", None, "add", "2024-01-01"), (None, "h:a.org", "add", "2024-03-01")], "list_name string, key string, action string, d string").select("list_name", "key", "action", F.to_date("d").alias("changed_on")).withColumn("page_id", F.lit(7))
    got = sorted(((r["page_id"], r["fetched_on"] and str(r["fetched_on"]), r["n_active"], r["blocked"]) for r in urlfilter.filter_urls(caps, changes).collect()), key=str)
    day = "2024-01-05"
    assert got == sorted([(1, day, 1, True), (1, day, 1, True), (2, day, 0, False), (3, None, 0, False), (None, day, 1, True), (4, day, 0, False), (5, day, 0, False), (6, "2024-02-05", 0, False)], key=str)


def test_revisits_with_nulls_and_long_headers(spark):
    long = "v" * 2_000_000
    rows = [
        (1, "response", "http://x.org/", 10, 200, {"ETag": '"t"', "X-Long": long}, "d"), (None, "response", "http://x.org/", 5, 200, {"ETag": '"s"'}, "d"), (2, "revisit", "http://x.org/", 20, 304, {"etag": '"t"', "Date": long}, None),
        (None, "revisit", "http://x.org/", 7, 304, {"etag": '"s"'}, None), (3, "revisit", None, 20, 304, None, None), (4, "revisit", "http://x.org/", None, 304, None, None), (5, "revisit", "http://x.org/", 30, None, None, None), (5, "revisit", "http://x.org/", 30, None, None, None), (6, None, "http://x.org/", 1, None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, warc_type string, url string, s long, status int, headers map<string,string>, payload_digest string")
    df = df.withColumn("warc_date", F.timestamp_seconds("s")).withColumns({c: F.lit(0) for c in ("range", "full", "canonical_url", "last", "top", "outcome")})
    got = sorted(((r["record_id"], r["outcome"], r["refers_to"], (r["headers"] or {}).get("x-long") == long, (r["headers"] or {}).get("date") == long) for r in warc.resolve_revisits(df).collect()), key=str)
    assert got == sorted([(2, "resolved", 1, True, True), (None, "resolved", None, False, False), (3, "no_earlier", None, False, False), (4, "no_earlier", None, False, False), (5, "unverified", 1, False, False), (5, "unverified", 1, False, False)], key=str)


def test_decontamination_with_clashing_names(spark):
    leak = " ".join(words(12, 5))
    names = ("key", "token", "win", "n", "items", "item", "w", "size", "pos", "start", "seen", "at", "text_hash", "span", "n_hit", "no", "starts")
    docs = spark.createDataFrame([(1, "before " + leak + " after"), (2, "clean words only"), (None, leak), (3, None)], "doc_id long, text string").withColumns({c: F.lit("clash") for c in names})
    bench = spark.createDataFrame([("b", leak), (None, leak), ("c", None)], "item_id string, text string").withColumns({c: F.lit("clash") for c in names})
    for limit in (0, 1_000_000):
        got = sorted(((r["doc_id"], r["n_hit"], r["items"]) for r in decontam.decontaminate(docs, bench, broadcast_rows=limit).collect()), key=str)
        assert got == sorted([(1, 12, ["b"]), (2, 0, []), (3, 0, []), (None, 12, ["b"])], key=str)
