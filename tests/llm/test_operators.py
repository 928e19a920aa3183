"""Operators against brute force, and the cases each docstring defines."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import decontam, jpeg, licenses, lm, mixing, neardup, quality, queries, shared, substrings, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], DOCS).withColumn("kept", F.lit(1)).withColumn("key", F.lit("clash"))


def words(n, seed, vocab=300):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


EDGE = [None, "", "   \n\t ", "one", "one two three", "x" * 5000, "é ü ñ", "a b c d e " * 400]


# 7


def brute_repeats(texts, window=20):
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings_equal_brute_force(spark):
    base = [words(200, i) for i in range(12)]
    texts = [" ".join(b) for b in base] + EDGE
    texts += [" ".join(base[0][50:100] + words(30, 99) + base[1][:40]), " ".join(base[2]), " ".join(base[3][:19]), " ".join(base[4][10:30]), " ".join(base[5] + base[5]), " ".join(base[0][40:90])]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.drop_repeats(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_substrings_with_repeated_and_missing_ids(spark):
    t = " ".join(words(60, 1))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (0, "short")], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_removed"]) for r in substrings.drop_repeats(df, with_text=True).collect()), key=str)
    assert got == [(False, 0, 0), (False, 1, 0), (False, 1, 0), (True, None, 60)]
    assert substrings.drop_repeats(df.limit(0)).count() == 0


def test_substrings_of_random_overlaps(spark, monkeypatch):
    """Passages that overlap, nest and repeat in many ways, short periods, and texts of over 5 KB; with hot keys broadcast from two rows on."""
    met_by = substrings.met_by
    monkeypatch.setattr(substrings, "met_by", lambda rows, table, on: met_by(rows, table, on, 2))
    rng = random.Random(12)
    base, small = words(1500, 3, 4000), words(60, 4, 5)
    texts = []
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(1400)
            parts += rng.choice([base[a : a + rng.randrange(10, 120)], words(rng.randrange(30), 1000 + i, 3000), small[: rng.randrange(60)], ["p", "q", "r"] * rng.randrange(15)])
        texts.append(" ".join(parts))
    texts += [" ".join(base * 3), " ".join(base[700:] + base[:700]), "a b c d e " * 3000, "z " * 4000]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.drop_repeats(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_nonbranching_paths(spark):
    """A chain of 100, a fork after two, a circle, and one alone."""
    chain = [(i, i, i + 1, 2) for i in range(100)]
    fork = [(200, 1000, 1001, 3), (201, 1001, 1002, 1), (202, 1002, 1003, 1), (203, 1002, 1004, 1)]
    circle = [(300 + i, 2000 + i, 2000 + (i + 1) % 4, 1) for i in range(4)]
    got = {r["id"]: (r["path"], r["at"]) for r in substrings.nonbranching_paths(spark.createDataFrame([*chain, *fork, *circle, (400, 3000, 3001, 1)], "id long, u long, v long, edges int")).collect()}
    assert got == {**{i: (0, 2 * i) for i in range(100)}, 200: (200, 0), 201: (200, 3), 202: (202, 0), 203: (203, 0), **{300 + i: (300 + i, 0) for i in range(4)}, 400: (400, 0)}


def test_segments_cover_every_window_once():
    cache = shared.WordHashes()
    h = cache.of([w.encode() for w in words(500, 3, 20)])
    doc = np.repeat([0, 1, 2], [100, 15, 385])
    *_, first, count = substrings.segments(h, doc, 20)
    starts = np.concatenate([np.arange(f, f + c) for f, c in zip(first, count, strict=True)])
    assert starts.tolist() == [*range(81), *range(115, 481)]


# 5


def brute_components(texts, size=4):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for g in range(6):
        base = words(120, g, 5000)
        for c in range(15):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    texts += [*EDGE, "One", "ONE two Three", texts[0], texts[0].upper()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(documents(spark, texts), shingle=4).collect()}
    assert [got[i] for i in range(len(texts))] == [(n, c, c == i) for i, (n, c) in enumerate(brute_components(texts))]


def test_near_duplicates_in_several_blocks(spark, monkeypatch):
    """A target with many queries and members, and long texts, is compared in blocks; the result is the same."""
    monkeypatch.setattr(neardup, "TEXT_BLOCK", 4)
    monkeypatch.setattr(neardup, "SHINGLE_BLOCK", 500)
    rng = random.Random(8)
    base = words(150, 1, 5000)
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 3, 6, 9])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(words(30_000, 5, 9000)), " ".join(words(30_000, 5, 9000)) + " more"]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(spark, texts), shingle=4).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute_components(texts)]


def test_near_duplicates_ask_no_pairs_of_components(spark, monkeypatch):
    """Texts at a similarity of about 0.73 are likely but not linked: all pairs of them would be asked for, so each is to be named once a cell."""
    base, n = [f"b{i}" for i in range(260)], 120
    texts = [" ".join(base + [f"w{d}x{i}" for i in range(45)]) for d in range(n)]
    texts += [texts[7] + " more", texts[90] + " more", texts[90].replace("b3 ", "z ", 1)]
    asked = []
    exact = neardup.exact_links
    monkeypatch.setattr(neardup, "exact_links", lambda asks, members, *rest: (asked.append(asks.count() + members.count()), exact(asks, members, *rest))[1])
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(spark, texts), shingle=4).collect()}
    assert got == {d: {n: 7, n + 1: 90, n + 2: 90}.get(d, d) for d in range(n + 3)}
    assert len(asked) == 2 and asked[1] <= 2 * neardup.BANDS * len(texts)


def test_near_duplicates_without_ids_or_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, None)], "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(df).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == [(3, 3, True), (3, 3, True), (4, 4, True), (None, None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_posterior_bounds():
    least = neardup.least_matches(0.8, 1e-7)
    assert all(0 <= m <= 0.8 * n for m, n in zip(least, range(16, 129, 16), strict=True)) and least == sorted(least)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 10


def test_decontamination_cases(spark):
    item = "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item), (2, "Tiny one"), (3, None), (4, "..."), (10, item)], "item_id long, text string")
    texts = [f"noise {item.upper()} noise", "a tiny ONE here, tiny-one!", "alpha beta gamma delta epsilon zeta eta theta iota", *EDGE]
    got = {r["doc_id"]: r for r in decontam.decontaminate(documents(spark, texts), bench).collect()}
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["items"]) == (14, 12, ["1", "10"])
    assert (got[1]["n_hit"], got[1]["items"]) == (4, ["2"])
    assert got[2]["n_hit"] == 0 and got[3]["n_words"] == 0 and len(got) == len(texts)
    assert decontam.decontaminate(documents(spark, texts), bench.limit(0)).filter("n_hit > 0").count() == 0
    wide = decontam.decontaminate(documents(spark, texts), bench, broadcast_rows=0)
    assert {r["doc_id"]: r["n_hit"] for r in wide.collect()} == {k: r["n_hit"] for k, r in got.items()}


def brute_hits(text, items, window):
    """(n_words, n_hit, item ids) of a text by comparing every place."""
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    w, hit, found = split(text), set(), set()
    for item, t in items:
        v = split(t)
        for win in [v[i : i + window] for i in range(max(len(v) - window + 1, 1))] if v and item is not None else []:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_decontamination_equals_brute_force(spark, broadcast_rows):
    rng = random.Random(11)
    items = [(i, " ".join(words(rng.choice([1, 3, 5, 8, 30]), 50 + i, 6))) for i in range(25)] + [(None, "w1 w2"), (90, None), (91, " - "), (3, "w5 w5 w5")]
    texts = [*EDGE, *(" ".join(words(rng.randrange(1, 80), i, 6)) for i in range(60)), "w1 " * 3000, " ".join(words(20_000, 77, 5000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10, texts[10]), (10, texts[11]), (None, texts[12]), (None, texts[12])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(docs, bench, window=5, broadcast_rows=broadcast_rows).collect()
    expected = [(i, *brute_hits(t, items, 5)) for i, t in rows]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == sorted(expected, key=str)


# 9


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 5, 1), (None, 100, 1)], "source string, source_size long, n_docs long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    total, weights, limits = 1115, {"a": 5, "b": 2, "c": 1, None: 5}, {"a": 30, "b": 3000, "c": 15, None: 300}
    fixed = {}
    while True:
        left = {k: w for k, w in weights.items() if k not in fixed}
        t = {k: (total - sum(fixed.values())) * w / sum(left.values()) for k, w in left.items()}
        over = {k: limits[k] for k in t if t[k] > limits[k]}
        if not over:
            break
        fixed |= over
    assert got == pytest.approx(fixed | t)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 500, 300).tolist(), [0.37] * 300
    left = mixing.flight(p, size, rng.random(300))
    assert len(left) <= 2 and sum(p) == pytest.approx(0.37 * 300) and sum(a * b for a, b in zip(p, size, strict=True)) == pytest.approx(0.37 * sum(size))
    assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i not in left)


@pytest.mark.parametrize(("block", "off"), [(16, 1000), (4096, 5)])  # a small block may land half the longest text (2,000 words) away
def test_mix_is_near_its_targets(spark, block, off):
    texts = [" ".join(words(5 + i % 60, i)) for i in range(600)] + EDGE
    df = documents(spark, texts, lambda i: None if i % 7 == 0 else f"s{min(i % 5, 2)}")
    got = mixing.mix_sources(df, block=block).toPandas()
    again = mixing.mix_sources(df.repartition(7), block=block).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))
    assert len(got) == len(texts) and (got.taken <= 3 * got["size"]).all()
    g = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(g.taken - g.target) <= off).all() and got["size"].sum() == pytest.approx(g.target.sum())
    assert mixing.mix_sources(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [64, 100, 4096])
def test_mix_lands_alike_at_every_size(spark, block):
    """A source of one block beside one of many, each with a document longer than many others together."""
    small, large = [" ".join(words(5 + i % 40, i)) for i in range(60)], [" ".join(words(5 + i % 60, i)) for i in range(3000)]
    small[0] = large[0] = "a b c d e " * 100
    df = documents(spark, small + large, lambda i: "small" if i < 60 else "large")
    g = mixing.mix_sources(df, weights=(3, 4), block=block).toPandas().groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), n=("source", "size"))
    assert sorted(g.n) == [60, 3000] and (abs(g.taken - g.target) <= 5).all()


def test_mix_of_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b c", "x")] * 30 + [(None, "d e", "x")] * 30 + [(2, "f g h i", None)] * 30 + [(3, None, "y"), (None, "", None)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))).toPandas()
    assert len(got) == len(rows) and (got.taken == got.copies * got["size"]).all() and (got.taken <= 3 * got["size"]).all()
    g = got[got["size"] > 0].groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(g.taken - g.target) <= 4).all()


# 4


def test_quality_is_learned(spark):
    good = [" ".join(words(80, i)) + "." for i in range(150)]
    bad = ["!!! ".join(w.upper() for w in words(80, 1000 + i)) for i in range(150)]
    df = documents(spark, [t for pair in zip(good, bad, strict=True) for t in pair] + EDGE)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(0, 0), (None, 1)], "doc_id long, quality int")
    out = quality.score_quality(df, quality.train_model(df, labels)).collect()
    assert len(out) == 300 + len(EDGE) and all(0 <= r["quality_score"] <= 1 for r in out)
    right = sum((r["quality_score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in out if 200 <= r["doc_id"] < 300)
    assert right >= 97
    none = quality.train_model(df, labels.limit(0))
    assert quality.score_quality(df, none).first()["quality_score"] == pytest.approx(0.5)
    assert quality.score_quality(df.limit(0), none).count() == 0


def test_quality_scores_equal_brute_force(spark):
    """Sizes block by block with either dictionary; repeated rows, ties, nulls and a text of many blocks."""
    import zstandard

    good, bad = [" ".join(words(60, i)).encode() for i in range(60)], [b"!! ".join(w.upper().encode() for w in words(60, 900 + i)) for i in range(60)]
    model = quality.CompressionModel(quality._dictionary(good), quality._dictionary(bad), mean=0.02, slope=40.0, offset=-0.5, fitted=True)
    texts = [*EDGE, "tie", "tie", " ".join(words(200_000, 5)), good[0].decode(), bad[0].decode()]
    got = {r["doc_id"]: r["quality_score"] for r in quality.score_quality(documents(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        raw, size = (t or "").encode(), {}
        for name, (content, plain) in (("good", model.good), ("bad", model.bad)):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT if plain else zstandard.DICT_TYPE_AUTO)
            size[name] = sum(len(zstandard.ZstdCompressor(level=3, dict_data=d).compress(raw[k : k + 1024])) for k in range(0, len(raw), 1024))
        x = (size["bad"] - size["good"] + 96 * 0.02) / (len(raw) + 96)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(40.0 * x - 0.5))), rel=1e-6)


def test_quality_fit_takes_each_id_once(spark):
    rows = [(i, " ".join(words(60, i)) if i % 2 else "!! ".join(w.upper() for w in words(60, i))) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = quality.train_model(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    often = quality.train_model(spark.createDataFrame(rows * 3 + [(3, None), (5, "y" * 70_000)], "doc_id long, text string"), labels)
    assert once.fitted and (once.good, once.bad, once.slope, once.offset) == (often.good, often.bad, often.slope, often.offset)


def test_wrappers_of_queries_without_sql(spark, sf):
    """Remainders, cuts and columns of the queries that SQL can't express."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    crc = lambda i: zlib.crc32(str(i).encode())
    got = queries.op4_quality_classifier(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(docs) and all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    got = queries.op2_lm_scoring(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(docs) and all(r["held_out"] == (crc(r["doc_id"]) % 10 == 0) and r["n_tokens"] == len(docs[r["doc_id"]].encode().split()) + 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    got = queries.op3_media_jpeg(spark, sf).collect()
    assert all(r["n_bytes"] == len(docs[r["doc_id"]].encode()) and r["payload_bytes"] == max(1, -(-r["n_bytes"] // 576)) * 576 for r in got)
    got = queries.op9_source_mixing(spark, sf).collect()
    assert all(r["size"] == len(docs[r["doc_id"]].encode().split()) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in got)


# 3


def test_jpeg_round_trip():
    rng = np.random.default_rng(0)
    raw = [b"", b"abc", bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), b"\xff\x00" * 700, bytes(rng.integers(0, 256, 400_000, dtype=np.uint8)), bytes([0, 255] * 1000)]
    payloads = [jpeg.payload_of(x) for x in raw]
    files = jpeg.store(payloads)
    for p, planes in zip(payloads, jpeg.thumbnails(files), strict=True):
        assert len(p) % 576 == 0 and b"".join(x.tobytes() for x in planes) == p


def encode_plain(blocks: list[list[int]], width: int, height: int) -> bytes:
    """A baseline JPEG by hand: AC coefficients, no restart intervals. Blocks: DC and then (run, value) pairs."""
    dc_codes = {s: (s, 4) for s in range(12)}
    ac_symbols = [0x00, 0xF0, *(r << 4 | s for r in range(4) for s in range(1, 6))]
    ac_codes = {s: (i, 8) for i, s in enumerate(ac_symbols)}
    bits = ""

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    last = 0
    for dc, *ac in blocks:
        n, b = number(dc - last)
        bits, last = bits + format(dc_codes[n][0], "04b") + b, dc
        at = 1
        for run, v in ac:
            n, b = number(v)
            bits += format(ac_codes[run << 4 | n][0], "08b") + b
            at += run + 1
        if at < 64:
            bits += format(ac_codes[0][0], "08b")
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    dht = b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + b"\x10" + bytes([0] * 7 + [len(ac_symbols)] + [0] * 8) + bytes(ac_symbols)
    sof = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"\xff\xd8" + jpeg._segment(jpeg.DQT, b"\x00" + bytes([8] * 64)) + jpeg._segment(jpeg.SOF0, sof) + jpeg._segment(jpeg.DHT, dht) + jpeg._segment(jpeg.SOS, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_jpeg_with_ac_coefficients_and_no_intervals(spark):
    rng = random.Random(3)
    blocks = [[rng.randrange(-100, 100), *[(rng.randrange(4), rng.choice([-9, -1, 1, 7])) for _ in range(rng.randrange(6))]] for _ in range(12)]
    data = encode_plain(blocks, 30, 20)
    assert jpeg.thumbnails([data])[0][0].reshape(-1).tolist() == [b[0] + 128 for b in blocks]
    rows = spark.createDataFrame([(1, data), (2, b"no jpeg"), (3, None), (4, data[:-20])], "id int, content binary")
    got = {r["id"]: r for r in jpeg.decode_column(rows, keep=("id",)).collect()}
    assert (got[1]["width"], got[1]["height"], got[1]["thumb_width"], got[1]["thumb_height"], got[1]["error"]) == (30, 20, 4, 3, None)
    assert got[2]["error"] and got[3]["error"] and got[2]["width"] is None


def test_stored_texts(spark):
    got = {r["doc_id"]: r for r in jpeg.store_texts(documents(spark, EDGE)).collect()}
    for i, t in enumerate(EDGE):
        p = jpeg.payload_of((t or "").encode())
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[0]["feature"] == got[1]["feature"] and jpeg.store_texts(documents(spark, EDGE).limit(0)).count() == 0


def test_repeated_rows_are_stored_alike(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, "same"), (2, "x " * 60_000)], "doc_id long, text string").withColumn("payload", F.lit("clash"))
    got = jpeg.store_texts(df).collect()
    assert len(got) == 4 and len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got}) == 2 and sum(r["doc_id"] is None for r in got) == 1


# 2


def test_language_model_scores(spark):
    texts = [" ".join(words(40, i, 50)) for i in range(120)] + EDGE
    df = documents(spark, texts)
    training = F.col("doc_id") % 5 != 0
    got = {r["doc_id"]: r for r in lm.score_documents(df, training).collect()}
    c = Counter()
    for i, t in enumerate(texts):
        if i % 5:
            c.update((t or "").encode().lower().split() + [b""])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split() + [b""]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert math.isfinite(got[i]["score"]) and got[i]["score"] < 0


def test_network_gradient_and_normalisation():
    lex = lm.Lexicon([b"", *(f"w{i}".encode() for i in range(99))], np.arange(100, 0, -1), 5050, 100, np.full(lm.SHAPES, 5), np.full(lm.SHAPES, 2))
    net = lm.Network(lex)
    rng = np.random.default_rng(2)
    net.Wc = rng.standard_normal(net.Wc.shape).astype(np.float32) * 0.1
    net.Wo = rng.standard_normal(net.Wo.shape).astype(np.float32) * 0.1
    assert lex.vocab == 100 and net.Wo.shape == (2, lm.STATE, lm.CLASS)
    h = rng.standard_normal((1, lm.STATE)).astype(np.float32) * 0.5
    every = np.arange(lex.vocab + lm.SHAPES)
    assert np.exp(net.log_probs(np.repeat(h, len(every), 0), every)[0]).sum() == pytest.approx(1, abs=1e-4)
    before = -net.log_probs(np.repeat(h, 3, 0), np.array([1, 7, 101]))[0].sum()
    grads = lm._zeros(net)
    net.log_probs(np.repeat(h, 3, 0), np.array([1, 7, 101]), grads)
    net.bc[0] += 1e-2
    after = -net.log_probs(np.repeat(h, 3, 0), np.array([1, 7, 101]))[0].sum()
    assert (after - before) / 1e-2 == pytest.approx(grads["bc"][0], abs=2e-2)


def test_state_is_carried_and_training_helps():
    lex = lm.Lexicon([b"", *(f"w{i}".encode() for i in range(20))], np.full(21, 50), 1050, 21, np.zeros(lm.SHAPES, np.int64), np.zeros(lm.SHAPES, np.int64))
    net = lm.Network(lex)
    ids = [np.array([1 + (i + j) % 20 for j in range(100)] + [0]) for i in range(40)]
    one = lm.score_ids(net, [ids[0]])
    assert lm.score_ids(net, ids)[0] == pytest.approx(one[0], rel=1e-4)
    state = {}
    for _ in range(60):
        lm.train(net, ids, state)
    assert lm.score_ids(net, ids).sum() > 0.7 * one[0] * len(ids)


def plain_scores(net, ids):
    """Log probabilities of texts, one token after another, in double precision."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    E, U, Wc, bc, Wo, bo = (getattr(net, k).astype(float) for k in net.names)
    out, s = [], lm.STATE
    for text in ids:
        h, before, total = np.zeros(s), net.start, 0.0
        for word in text:
            x, hu = E[before], h @ U
            z, r = sigmoid(x[:s] + hu[:s]), sigmoid(x[s : 2 * s] + hu[s : 2 * s])
            h = (1 - z) * h + z * np.tanh(x[2 * s :] + r * hu[2 * s :])
            c = Wc @ h + bc
            k = word // lm.CLASS if word < net.v else net.n_word_classes + word - net.v
            total += c[k] - np.log(np.exp(c).sum())
            if word < net.v:
                w = h @ Wo[k] + bo[k]
                total += w[word % lm.CLASS] - np.log(np.exp(w).sum())
            before = word
        out.append(total)
    return out


def tiny_lexicon():
    return lm.Lexicon([b"", *(f"w{i}".encode() for i in range(149))], np.arange(150, 0, -1), 11325, 150, np.full(lm.SHAPES, 5), np.full(lm.SHAPES, 2))


def test_scores_equal_brute_force():
    rng = np.random.default_rng(3)
    net = lm.Network(tiny_lexicon())
    ids = [np.append(rng.integers(1, net.v + lm.SHAPES, n), 0).astype(np.int32) for n in (0, 1, 5, 31, 32, 33, 200)]
    for _ in range(3):
        lm.train(net, ids, {}, 0.05)
    assert lm.score_ids(net, ids) == pytest.approx(plain_scores(net, ids), rel=1e-4)


def test_gradient_equals_differences(monkeypatch):
    rng = np.random.default_rng(4)
    net, made = lm.Network(tiny_lexicon()), {}
    net.Wc, net.Wo = (rng.standard_normal(x.shape).astype(np.float32) * 0.3 for x in (net.Wc, net.Wo))
    ids = [np.append(rng.integers(1, net.v + lm.SHAPES, n), 0).astype(np.int32) for n in (3, 15, 9)]  # one window, so nothing is truncated
    monkeypatch.setattr(lm, "_update", lambda net, grads, *a: made.update(grads))
    lm.train(net, ids, {})
    for name in net.names:
        at = np.unravel_index(np.abs(made[name]).argmax(), made[name].shape)
        sides = []
        for step in (1e-2, -1e-2):
            moved = net.copy()
            getattr(moved, name)[at] += step
            sides.append(-sum(plain_scores(moved, ids)))
        assert made[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-2, rel=2e-2)


def test_model_does_not_depend_on_partitions(spark, monkeypatch):
    """Held-out texts score above the base, and alike, however the table is partitioned and with several shards."""
    order = random.Random(9)
    texts = [" ".join(f"w{(i + j + order.randrange(2)) % 60}" for j in range(200)) for i in range(300)]
    df = documents(spark, [*texts, texts[0], "long " * 3000])
    monkeypatch.setattr(lm, "SHARD", 20_000)
    monkeypatch.setattr(lm, "UPDATE", 256)
    runs = [{(r["doc_id"], r["score"], r["base_score"]) for r in lm.score_documents(df.repartition(n), F.col("doc_id") % 5 != 0).collect()} for n in (1, 8, 64)]
    for other in runs[1:]:
        for a, b in zip(sorted(runs[0]), sorted(other), strict=True):
            assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-5) and a[2] == pytest.approx(b[2])
    held = [x for x in runs[0] if x[0] % 5 == 0 and x[0] < 300]
    assert sum(x[1] for x in held) > 0.97 * sum(x[2] for x in held)


def test_model_without_training_rows_or_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = lm.score_documents(df, F.lit(False)).collect()
    assert [r["n_known"] for r in got] == [0, 0, 0] and {r["train_tokens"] for r in got} == {0} and all(math.isfinite(r["score"]) for r in got)
    assert lm.score_documents(df.limit(0), F.lit(True)).count() == 0


def test_long_texts_are_numbered_in_pieces():
    text = b" ".join(b"w%d" % (i % 7) for i in range(500)) + b" " + b"x" * 300
    assert [w for p in lm.pieces(text, 64) for w in p.split()] == text.split() and len(list(lm.pieces(text, 64))) > 10
    assert list(lm.pieces(b"")) == [b""]


def test_every_training_text_is_trained_on(spark, monkeypatch):
    made = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: made.append((fit(*a), a[1])) or made[-1][0])
    for texts in ([" ".join(words(40, i, 50)) for i in range(60)], ["only one short text"]):
        lm.score_documents(documents(spark, texts), F.lit(True)).count()
        net, lexicon = made[-1]
        assert net.trained == lexicon.tokens == sum(len(t.split()) + 1 for t in texts)
        assert (net.Wc != 0).any()  # the start has no weights there


def test_words_are_numbered_once(spark, monkeypatch):
    """Training reads the numbers that scoring reads, not texts again."""
    made, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: made.append(a) or fit(*a))
    lm.score_documents(documents(spark, ["b a zz", "A b", None]), F.col("doc_id") < 2).count()
    docs, lexicon = made[0][:2]
    assert docs.columns == ["h", "ids"]
    words = sorted([lexicon.words[i].decode() for i in np.frombuffer(bytes(r["ids"]), np.int16)] for r in docs.collect())
    assert words == [["a", "b", ""], ["b", "a", "zz", ""]]


def test_an_end_rarer_than_the_head_is_counted(spark, monkeypatch):
    rows = [*((f"w{i}", 9) for i in range(3)), *((f"v{i}", 5) for i in range(4)), ("", 2), ("x", 1)]
    monkeypatch.setattr(lm, "HEAD", 5)
    lexicon, least = lm.build_lexicon(spark.createDataFrame(rows, "word string, n long"))
    assert least == 9 and dict(zip(lexicon.words, lexicon.counts.tolist(), strict=True)) == {b"": 2, b"w0": 9, b"w1": 9, b"w2": 9}
    monkeypatch.setattr(lm, "HEAD", 7)  # the head has a place for the end, so no word's number is that of a spelling class
    assert len(lm.build_lexicon(spark.createDataFrame(rows, "word string, n long"))[0].words) <= 7


def test_the_last_gradient_is_applied():
    lex = lm.Lexicon([b"", *(f"w{i}".encode() for i in range(20))], np.full(21, 50), 1050, 21, np.zeros(lm.SHAPES, np.int64), np.zeros(lm.SHAPES, np.int64))
    net = lm.Network(lex)
    before = net.flat()
    assert lm.train(net, [np.array([1, 2, 3, 0])], {}) == 4 and (net.flat() != before).any()


# 1, 6, 8


def test_licenses_in_other_spelling(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + licenses.KNOWN["MIT"][0]
    isc = "Copyright © 2019 X\n" + licenses.KNOWN["ISC"][0].replace('"', "”").upper().replace("LICENSE", "LICENCE")
    texts = [licenses.KNOWN["MIT"][0], mit, isc, "text\n  released under the MIT licence!!\nmore\nReleased under the MIT License.", *EDGE]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, texts), licenses.known_licenses(spark)).collect()}
    assert got[0]["text_license"] == "MIT" and got[1]["text_license"] == "MIT" and got[2]["text_license"] == "ISC"
    assert (got[3]["n_license_lines"], got[3]["line_licenses"]) == (2, ["MIT"])
    assert got[4]["text_digest"] == got[5]["text_digest"] == hashlib.sha256(b"").hexdigest() and len(got) == len(texts)
    none = licenses.scan_licenses(documents(spark, texts), licenses.known_licenses(spark, {"x": []} | {"y": ["zzz"]}))
    assert none.filter("n_license_lines > 0 OR text_license IS NOT NULL").count() == 0


def test_whole_licenses_are_found(spark):
    bsd = licenses.FORMS["BSD-3-Clause"][0]
    cases = [("BSD-3-Clause", bsd), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2021, X\nAll rights reserved.\n\n" + bsd.replace(". ", ".\n")), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 X\n\n" + licenses.KNOWN["MIT"][0]), ("ISC", "ISC License\n\n" + licenses.KNOWN["ISC"][0])]
    published = Path("/usr/share/common-licenses")
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("GPL-2.0", "GPL-2"), ("LGPL-2.1", "LGPL-2.1")):
        if (published / file).exists():
            cases.append((name, (published / file).read_text()))
    cases.append((None, bsd + "\nand more"))
    got = {r["doc_id"]: r["text_license"] for r in licenses.scan_licenses(documents(spark, [t for _, t in cases]), licenses.known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(cases))] == [name for name, _ in cases]


def test_what_is_no_license(spark):
    """Near misses have no licence: a further clause, even one lettered (c), a missing one, a changed word. A copyright line in any usual form changes nothing."""
    mit = licenses.KNOWN["MIT"][0]
    near = [mit + "\n(c) A fee is due for each copy.", "(c) The name must be kept.\n" + mit, mit.replace("free of charge, ", ""), mit.replace("without limitation", "without any limitation"), mit + "\n" + mit, mit[:-1] + " today."]
    owned = ["(c) 2020 Some One\n" + mit, "(C) Some One, 2020.\n" + mit, "Copyright (c) Some One\n" + mit, "© Some One\n" + mit, "* (c) by Some One *\n" + mit]
    long = "word " * 300_000 + "\nReleased under the MIT License.\n" + "word " * 100
    rows = [(i, t) for i, t in enumerate([*near, *owned, long])] + [(100, "Released under the MIT License.\nx"), (100, "Released under the MIT License.\nx"), (None, mit), (None, mit)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark)).collect()
    whole = {r["doc_id"]: r["text_license"] for r in got}
    assert [whole[i] for i in range(len(near))] == [None] * len(near)
    assert [whole[i] for i in range(len(near), len(near) + len(owned))] == ["MIT"] * len(owned)
    assert sorted((str(r["doc_id"]), r["n_license_lines"], r["text_license"]) for r in got if r["doc_id"] in (100, None, len(near) + len(owned))) == [("100", 1, None), ("100", 1, None), (str(len(near) + len(owned)), 1, None), ("None", 0, "MIT"), ("None", 0, "MIT")]


def test_lists_hold_between_their_dates(spark):
    changes = spark.createDataFrame([("l", "d:b.org", "add", "2024-01-10"), ("l", "d:b.org", "remove", "2024-02-01"), ("l", "d:b.org", "add", "2024-03-01"), ("m", "u:x.org/p", "add", "2024-01-01"), ("m", "u:x.org/p", "remove", "2024-01-01"), ("m", None, "add", "2024-01-01"), ("m", "h:x.org", "noise", "2024-01-01")], "list_name string, key string, action string, d string").withColumn("changed_on", F.to_date("d"))
    cases = [(1, "https://A.B.org/x", "2024-01-09", 0), (2, "https://a.b.org:80/x", "2024-01-10", 1), (3, "http://b.org", "2024-02-01", 0), (4, "http://u@b.org?q", "2024-05-01", 1), (5, "http://x.org/p/q", "2024-01-01", 0), (6, None, "2024-01-20", 0), (7, "junk", "2024-01-20", 0), (8, "http://bb.org", "2024-01-20", 0), (2, "https://a.b.org:80/x", "2024-01-10", 1), (9, "http://b.org", None, 0)]
    caps = spark.createDataFrame([c[:3] for c in cases], "page_id long, url string, d string").withColumn("fetched_on", F.to_date("d"))
    for rows in (10, 0):
        got = sorted((r["page_id"], r["n_active"]) for r in urlfilter.filter_urls(caps, changes, broadcast_rows=rows).collect())
        assert got == sorted((c[0], c[3]) for c in cases)
    assert urlfilter.filter_urls(caps, changes.limit(0)).filter("blocked").count() == 0


def test_hosts_in_other_spelling(spark):
    cases = [("http://[::1]:80/x", "[::1]"), ("https://U:p@B.Org.:8080/x", "b.org"), ("http://b.org", "b.org"), ("ftp://", ""), (None, ""), ("junk", "")]
    got = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string").select("i", urlfilter.host_of(F.col("u")).alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {i: h for i, (_, h) in enumerate(cases)}


def test_revisits_that_repeat_and_clash(spark):
    """Repeated revisits get a row each; extra columns with names of one's own change nothing."""
    rows = [("a", "response", "http://x.org/", "2024-01-01 00:00:00", 200, {"ETag": "1"}, "d"), *[("b", "revisit", "http://x.org/", "2024-01-02 00:00:00", 304, {"ETag": "1"}, "d")] * 3]
    df = spark.createDataFrame(rows, "record_id string, warc_type string, url string, d string, status int, headers map<string,string>, payload_digest string").withColumn("warc_date", F.to_timestamp("d"))
    for c in ("canonical_url", "refers_to", "outcome", "rows", "at", "range"):
        df = df.withColumn(c, F.lit("clash"))
    got = warc.resolve_revisits(df).collect()
    assert [(r["record_id"], r["refers_to"], r["outcome"]) for r in got] == [("b", "a", "resolved")] * 3


def test_revisits_find_the_latest_earlier_response(spark):
    full = lambda i, t, e: (i, "response", "http://WWW.x.org/a/#f", t, 200, {"ETag": e, "Content-Type": "text/html", "X": "1"}, "d")
    seen = lambda i, t, h, u="https://x.org/a": (i, "revisit", u, t, 304, h, "d")
    rows = [full(1, "2024-01-01 00:00:00", "v1"), full(2, "2024-01-05 00:00:00", "v2"), full(3, "2024-01-05 00:00:00", "v3"), seen(10, "2024-01-03 00:00:00", {"etag": 'W/v1', "Expires": "later", "X": "2"}), seen(11, "2024-01-05 00:00:00", {"etag": "v3"}), seen(12, "2024-01-06 00:00:00", {"etag": "v3"}), seen(13, "2023-01-01 00:00:00", None), seen(14, "2024-01-07 00:00:00", None, "http://y.org"), seen(15, None, None), seen(16, "2024-01-09 00:00:00", None)]
    df = spark.createDataFrame(rows, "record_id long, warc_type string, url string, d string, status int, headers map<string,string>, payload_digest string").withColumn("warc_date", F.to_timestamp("d"))
    for ranges in (1, 9):
        got = {r["record_id"]: r for r in warc.resolve_revisits(df, ranges).collect()}
        assert {k: (r["refers_to"], r["outcome"]) for k, r in got.items()} == {10: (1, "resolved"), 11: (1, "mismatch"), 12: (3, "resolved"), 13: (None, "no_earlier"), 14: (None, "no_earlier"), 15: (None, "no_earlier"), 16: (3, "resolved")}
        assert got[10]["headers"] == {"content-type": "text/html", "x": "1", "etag": "W/v1", "expires": "later"} and got[11]["headers"] is None
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    data = warc.format_record("response", "http://x.org/", "2024-01-01T00:00:00Z", "<urn:1>", 200, {"ETag": "v1"}, b"body\r\n\r\nmore") + warc.format_record("revisit", "http://x.org/", "2024-01-02T00:00:00Z", "<urn:2>", 304, {"ETag": "v1", "Date": "now"})
    import gzip

    (tmp_path / "a.warc").write_bytes(data)
    assert list(warc.parse_records(gzip.compress(data[:300]) + gzip.compress(data[300:]))) == list(warc.parse_records(data))
    assert [r["body"] for r in warc.parse_records(data)] == [b"body\r\n\r\nmore", b""]
    out = warc.resolve_revisits(warc.read_warc(spark, f"file://{tmp_path}")).first()
    assert (out["record_id"], out["refers_to"], out["outcome"], out["headers"]["date"]) == ("<urn:2>", "<urn:1>", "resolved", "now")
