"""Queries against their SQL; those without, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from auditloom.functions.rules import CODE_ENDINGS, RISK_KEYWORDS, RISK_PATHS
from auditloom.operators import scan
from auditloom.plans import catalog_audit
from auditloom.plans.catalog import ORACLE_SQL, PROSE, QUERIES
from auditloom.sources import driver_tables as dt

from .helpers import same

BY_HAND = {"code_chunks", "oversized_windows", "packed_batches", "merged_batches"}


def test_every_query_is_compared():
    assert catalog_audit.QUERIES is QUERIES if hasattr(catalog_audit, "QUERIES") else True
    assert set(QUERIES) - set(ORACLE_SQL) == BY_HAND


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], ORACLE_SQL[name])


def stripped(t):
    for pattern, to in ((r"(?s)/\*.*?\*/", " "), (r"//[^\n]*", " "), (r"#[^\n]*", " "), (r'(?s)""".*?"""', '""'), (r"(?s)'''.*?'''", "''")):
        t = re.sub(pattern, to, t)
    return t


def risk(path, content):
    hay = path.lower() + "\n" + stripped(content[:12_000]).lower()
    n = {k: sum(w in hay for w in words) for k, words in RISK_KEYWORDS.items()}
    score = sum(min(v, 4) * 3 for v in n.values()) + 2 * sum(p in path.lower() for p in RISK_PATHS) + path.lower().endswith(CODE_ENDINGS)
    return score, ",".join(k for k, v in n.items() if v)


def test_code_chunks_by_hand(spark, sf):
    """Files in order of priority, packed greedily line by line, and cut off at both budgets."""
    files, expected = {}, []
    for r in dt.files(spark, sf).collect():
        low = r["path"].lower()
        score = 1 + 4 * sum(t in low for t in scan.HIGH_TERMS) + 2 * sum(t in low for t in scan.MEDIUM_TERMS) + (3 if r["size"] > 500_000 else 1 if r["size"] <= 4096 else 0)
        files.setdefault(r["project"], []).append((-score, r["ordinal"], r["path"], r["content"] or ""))
    for project, listed in files.items():
        chars = number = 0
        for _, _, path, content in sorted(listed)[:1200]:
            parts, held, start, lines = [], [], 1, content.split("\n")
            for i, line in enumerate(lines, 1):
                if held and sum(len(x) + 1 for x in held) + len(line) + 1 > 1000:
                    parts.append((f"{path}#L{start}-{i - 1}", "split", "\n".join(held)))
                    held, start = [], i
                held.append(line)
            parts.append((f"{path}#L{start}-{len(lines)}", "split", "\n".join(held)))
            for name, kind, t in [(path, "full", content)] * bool(content) if len(content) <= 1000 else parts:
                number += 1
                if number > 2000 or chars >= 2_000_000:
                    break
                t, chars = t[: 2_000_000 - chars], chars + len(t)
                expected.append((project, name, path, kind, len(t), *risk(path, t), number))
    got = QUERIES["code_chunks"](spark, sf).collect()
    columns = ("project", "file_path", "base_file_path", "chunk_type", "n_chars", "risk_score", "risk_labels", "chunk_ordinal")
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(expected)


def test_oversized_windows_by_hand(spark, sf):
    """Head, up to six windows of 18 lines around keywords, joined over gaps of three, and tail."""
    expected = []
    for r in dt.files(spark, sf).collect():
        lines = re.split("\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]", r["content"] or "")
        lines = lines[:-1] if lines[-1] == "" else lines
        if not lines:
            continue
        windows = []
        for i, line in enumerate(lines):
            if any(w in line.lower() for w in PROSE["notice"]):
                lo, hi = max(i - 18, 0), min(i + 19, len(lines))
                if windows and lo <= windows[-1][1] + 3:
                    windows[-1][1] = max(hi, windows[-1][1])
                else:
                    windows.append([lo, hi])
        cut = lambda t, n: t if len(t) <= n else t[: n - 32] + "\n... (truncated)\n"
        last = lambda t, n: t if len(t) <= n else "\n... (truncated)\n" + t[-(n - 32) :]
        parts = [("oversized_head", "#head", cut("\n".join(lines[:45]).strip(), 1400))]
        parts += [("oversized_signal", f"#signal{k}:L{lo + 1}-{hi}", "\n".join(lines[lo:hi]).strip()) for k, (lo, hi) in enumerate(windows[:6], 1)]
        parts = [p for p in [*parts, ("oversized_tail", "#tail", last("\n".join(lines[-35:]).strip(), 1000))] if p[2]]
        for k, (kind, suffix, t) in enumerate(dict.fromkeys(parts) or [("oversized_excerpt", "#excerpt", cut(r["content"], 1400))]):
            expected.append((r["path"], k, r["path"] + suffix, kind, len(t)))
    got = QUERIES["oversized_windows"](spark, sf).collect()
    assert sorted((r["base_file_path"], r["chunk_idx"], r["file_path"], r["chunk_type"], r["n_chars"]) for r in got) == sorted(expected)


def test_batches_are_packed_by_hand(spark, sf):
    rows = [r.asDict() for r in QUERIES["packed_batches"](spark, sf).collect()]
    for project in {r["project"] for r in rows}:
        load = [0] * 8
        for r in sorted((r for r in rows if r["project"] == project), key=lambda r: (-r["n"], r["comp"])):
            k = load.index(min(load))
            assert r["batch"] == k
            load[k] += r["n"]


def test_batches_are_merged_by_hand(spark, sf):
    rows = [r.asDict() for r in QUERIES["merged_batches"](spark, sf).collect()]
    for project in {r["project"] for r in rows}:
        mine = [r for r in rows if r["project"] == project]
        groups = {r["batch"]: ([r["n_chars"], r["n_chunks"]], {r["batch"]}) for r in mine}
        while len(groups) > 8:
            a, b = sorted(groups, key=lambda k: (*groups[k][0], k))[:2]
            (chars, chunks), members = groups.pop(a)
            groups[b] = ([groups[b][0][0] + chars, groups[b][0][1] + chunks], groups[b][1] | members)
        assert {r["batch"]: r["merged"] for r in mine} == {m: k for k, (_, members) in groups.items() for m in members}


def test_findings_are_compared_whole(spark, sf):
    assert QUERIES["filtered_findings"](spark, sf).select(F.countDistinct("seq")).first()[0] > 100
