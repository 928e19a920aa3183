"""Ranked search against brute force; treaps against their definition."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, t) for i, t in bags if t]
    n, total = len(bags), sum(len(t) for _, t in bags)
    df = Counter(x for _, t in bags for x in set(t))
    out = []
    for item, text in items:
        found = []
        for i, t in bags:
            m, tf = 25 + 75 * len(t) * n // total, Counter(t)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in terms(text) if tf[x])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_terms_in_pieces():
    rng = random.Random(1)
    text = "".join(rng.choice(["Ab", "É", "日本", "7", "-", " ", "\n", "`", "word9", "{", "\x7f", "@"]) for _ in range(3000)) + "Z" * 500 + " end"
    for piece in (1, 5, 64, 1 << 20):
        got = [t.decode() for part in ranked.terms_of(text.encode(), piece) for t in part]
        assert got == terms(text)
    assert [*ranked.terms_of(b"")] == []


@pytest.mark.parametrize("seed", range(6))
def test_treaps_are_search_trees_and_heaps_and_find_the_best(seed):
    rng = np.random.default_rng(seed)
    n_docs, n_terms = 300, 12
    held = [(t, d) for t in range(n_terms) for d in range(n_docs) if rng.random() < (t + 1) / 14]
    term, doc = (np.array(x) for x in zip(*held, strict=True))
    impact = rng.integers(1, 4 if seed % 2 else 100_000, len(term))  # many ties, or hardly any
    order = rng.permutation(len(term))
    treaps = ranked.Treaps(term[order], doc[order], impact[order], n_docs)

    def walk(node, lo, hi, most):
        if node < 0:
            return 0
        d, v = int(treaps.doc[node]), int(treaps.impact[node])
        assert lo <= d < hi and v <= most
        return 1 + walk(treaps.left[node], lo, d, v) + walk(treaps.right[node], d + 1, hi, v)

    assert sum(walk(r, 0, n_docs, 10**9) for r in treaps.root.values()) == len(term)
    for asked in ({0: 5, 1: 3}, {t: 10 + t for t in range(n_terms)}, {11: 1}, {3: 0, 99: 7}, {99: 7}):
        score = np.zeros(n_docs, dtype=np.int64)
        for t, w in asked.items():
            score[doc[term == t]] += w * impact[term == t]
        want = [(d, s) for s, d in sorted((-s, d) for d, s in enumerate(score.tolist()) if s > 0)][:10]
        for together in (1, 7, 256):
            best, scores = treaps.search(asked, 10, together)
            assert [*zip(best.tolist(), (-scores).tolist(), strict=True)] == want


def test_traversal_leaves_out_what_cannot_enter():
    """A single document holds all rare terms; the rest share one common term: few documents are scored."""
    n = 20_000
    term = np.r_[np.zeros(n, dtype=int), np.arange(1, 11)]
    doc = np.r_[np.arange(n), np.full(10, 777)]
    impact = np.r_[np.random.default_rng(1).integers(1, 1000, n), np.full(10, 10**6)]
    treaps = ranked.Treaps(term, doc, impact, n)
    seen = []
    within = treaps._within
    treaps._within = lambda node, lo, hi: seen.append(len(node)) or within(node, lo, hi)
    best, _ = treaps.search({t: 10 for t in range(11)}, 10, 1)
    assert best[0] == 777 and sum(seen) // 22 < 100


EDGE = [None, "", " -- \n", "alpha", "ALPHA beta beta", "é É ñ", "x" * 5000, "alpha beta gamma " * 4000]


def test_ranks_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, t) for i, t in enumerate([*EDGE, *(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 120))) for _ in range(400))])]
    docs += [(500 + i, docs[20][1]) for i in range(30)] + [(None, docs[20][1]), (21, docs[21][1])]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 25)))) for i in range(25)] + [(90, None), (91, ""), (92, "alpha ALPHA beta"), (93, "none of this"), (94, docs[20][1]), (95, "É x"), (None, "alpha")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("rank", F.lit("clash")).repartition(5)
    q = spark.createDataFrame(items, "item_id int, text string").withColumn("query", F.lit(0))
    want = brute(docs, items)
    assert {r[1] for r in want} == set(range(1, 11))
    for options in ({}, {"run_postings": 300, "together": 3}, {"batch_bytes": 1500}):
        assert sorted((tuple(r) for r in ranked.rank(d, q, **options).collect()), key=str) == want
    assert sorted((tuple(r) for r in ranked.rank(d, q, k=3).collect()), key=str) == brute(docs, items, 3)


def test_empty_tables_and_other_ids(spark):
    d = spark.createDataFrame([("b", "red fox"), ("a", "red fox"), ("c", "blue")], "key string, body string")
    q = spark.createDataFrame([("q", "fox red")], "item_id string, text string")
    got = ranked.rank(d, q, doc_id="key", text="body").collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "a"), (2, "b")]
    assert ranked.rank(d.limit(0), q, doc_id="key", text="body").count() == 0
    assert ranked.rank(d, q.limit(0), doc_id="key", text="body").count() == 0
    assert ranked.rank(d.select("key", F.lit(None).cast("string").alias("body")), q, doc_id="key", text="body").count() == 0
