"""Fill-in-middle against a plain version, and the checkpoints against every unit of a text."""

import hashlib
import random
import re

import pytest

from auditloom.llm import fim

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
EDGE = [None, "", "a", " ", "one two", "é ü ñ", "日本語 text 🙂🙂 mixed", "x" * 200_000, "1" * 3000, "a1" * 70_000, "has <P> inside", "<M>", "< P><S", "ends with <", "<P", "\r\n\x00\t", "ab <<S <P <M> "]


def brute(doc_id, text, transformed=90, turned=20, salt=1):
    text = text or ""
    h = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= transformed:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < turned else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("every", [1, 3, 256])
def test_checkpoints_find_every_unit(every, monkeypatch):
    monkeypatch.setattr(fim, "PIECE", 7)
    rng = random.Random(every)
    texts = ["".join(rng.choice(["a", "Zz", " ", "é", "日", "🙂", "9", "word", "\n"]) for _ in range(n)) for n in (0, 1, 2, 50, 400)]
    for t in texts:
        points = fim.Checkpoints(t.encode(), every)
        units = UNIT.findall(t)
        assert (points.units, points.length) == (len(units), len(t))
        assert points.numbers == list(range(0, len(units), every))
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert points.find(k) == (len(before.encode()), len(before))


def test_outputs_equal_a_plain_version(spark):
    rng = random.Random(5)
    texts = EDGE + ["".join(rng.choice(["ab", "C", " ", "ñ", "語", "<", "P>", "7", ". "]) for _ in range(rng.randrange(1, 900))) for _ in range(150)]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, "no id at all", "x", "y", "z"), (3, "an id again", "x", "y", "z"), (3, "an id again", "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, form string, draws string")
    out = fim.with_restored(fim.fill_in_middle(df, every=16))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted(((i, *brute(i, t), t or "") for i, t, *_ in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_parameters_and_empty_table(spark):
    df = spark.createDataFrame([(i, f"some text {i}") for i in range(200)], "key int, body string")
    out = fim.fill_in_middle(df, transformed=50, turned=100, salt=7, doc_id="key", text="body").collect()
    assert sorted((r[0], *r[1:]) for r in out) == sorted((i, *brute(i, f"some text {i}", 50, 100, 7)) for i in range(200))
    assert fim.fill_in_middle(df.limit(0), doc_id="key", text="body").count() == 0
