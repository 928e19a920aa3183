"""Merging duplicates as one after the other would, without ever taking a key's findings one after the other.

A merged finding's points never fall: it has the highest severity and confidence so far
and keeps what was filled in. So another finding can only take its place where it has
more points than any before it, and there are at most some hundred such records to a key,
whatever its size. Records come from the least place of every number of points; what the
rest does to the merged finding (the first text of each field, the first finding of each
rank, the first of each endpoint between two records) comes from partial aggregates too.
A key's few records and firsts are then replayed in order.

That is for keys with very many findings. The others are sorted by key and order and
merged as they stream by, which moves each finding once and holds one merged finding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.keywords import small_batches
from ..functions.severity import ALIASES, SEVERITIES, confidence_rank, severity_rank
from ..functions.text import text_or_empty
from .findings import TEXT_FIELDS, merge_score
from .graph import checkpointed

_RANK = {s: 5 - i for i, s in enumerate(SEVERITIES)}
_SPACE = " \t\n\r\x0b\x0c"
#: What stands before an equivalent endpoint; points of a description.
NOTE, MOST_CHARS, CHARS_A_POINT = "等价入口：", 12, 80
#: How many findings of a key one task merges as they stream by.
FEW = 20_000


def _named(severity: str | None) -> str:
    return ALIASES.get((severity or "").strip(_SPACE).lower(), "Medium")


def _replay(rows: dict[str, dict], first: dict, endpoints: list[tuple[str, str]]) -> dict:
    """The merged finding of a key: ``rows`` are its records and its second finding by place, ``first`` the firsts, ``endpoints`` those that come first between two records, in order."""
    start = min(rows)
    acc = dict(rows[start])
    if first["n"] == 1:
        return acc
    texts = [c for c in TEXT_FIELDS if c in acc]
    text = lambda row, c: (row.get(c) or "").strip(_SPACE)
    acc |= {c: text(acc, c) for c in texts if text(acc, c)}
    rank, level = _RANK.get(text(acc, "severity"), 0), first["levels"]
    about = first["description"]
    events = sorted({*rows, *(q for q, _ in endpoints), *([about["q"]] if about else [])} - {start})
    entry, own_endpoints = text(acc, "endpoint"), dict(endpoints)
    # The rank of the confidence so far, the places at which a higher one or what has points comes first.
    conf = rows[start]["_conf"]
    reached = lambda name, q: first[name] is not None and first[name] < q

    def raise_confidence(before: str | None) -> None:
        nonlocal conf
        for x in sorted(level, key=lambda x: x["q"]):
            if x["r"] > conf and (before is None or x["q"] < before):
                conf, acc["confidence"] = x["r"], x["v"]

    settled = first["alike"] > 1  # the second finding, if only one like the first, makes any severity one of the five
    if settled:
        rank = rank or _RANK[_named(acc["severity"])]
    for q in events:
        row = rows.get(q)
        raise_confidence(q)
        if settled:
            rank = max([rank, *(s["r"] for s in first["ranks"] if s["q"] < q)])
        points = 100 * rank + 20 * conf + 20 * reached("valid", q) + 12 * reached("snippet", q) + 10 * reached("proof", q) + 6 * reached("entry", q)
        points += min(MOST_CHARS, len(text(acc, "description")) // CHARS_A_POINT)
        before = entry
        if row is not None and row["_score"] > points:
            old, acc = acc, dict(row)
            acc |= {c: text(row, c) or text(old, c) for c in texts if text(row, c) or text(old, c)}
            acc |= {c: old[c] for c in ("line_start", "line_end") if acc.get(c) is None}
            if text(old, "poc_validation_status") and not text(row, "poc_validation_status"):
                acc["poc_validation_status"] = old["poc_validation_status"]
            if row["_conf"] < conf:
                acc["confidence"] = old["confidence"]
            if not settled:
                rank = max(_RANK.get(text(row, "severity"), 0), rank) or _RANK[_named(row["severity"])]
            else:
                rank = max(_RANK.get(text(row, "severity"), 0), rank)
            entry = text(row, "endpoint") or before
            note = before if text(row, "endpoint") and before and before != entry else ""
        else:
            if not settled:
                rank = max(_RANK.get(text(row or {}, "severity"), 0), rank) or _RANK[_named(acc["severity"])]
            if row is not None and row["_conf"] > conf:
                acc["confidence"] = row["confidence"]
            if about and about["q"] == q and not text(acc, "description"):
                acc["description"] = about["v"]
            theirs = own_endpoints.get(q) or (text(row, "endpoint") if row else "")
            entry = before or theirs
            note = theirs if theirs and theirs != entry else ""
        settled = True
        conf = max(conf, row["_conf"]) if row is not None else conf
        if note and NOTE + note not in (acc.get("description") or ""):
            acc["description"] = f"{acc.get('description') or ''}\n\n{NOTE}{note}".strip(_SPACE)
    # Whatever came after the last event only fills gaps.
    raise_confidence(None)
    rank = max([rank, *(s["r"] for s in first["ranks"])])
    acc["severity"] = SEVERITIES[5 - rank]
    for c in texts:
        if c not in ("description", "endpoint") and not text(acc, c) and first[c]:
            acc[c] = first[c]["v"]
    if entry:
        acc["endpoint"] = entry
    for c in ("line_start", "line_end"):
        if acc.get(c) is None and first[c]:
            acc[c] = first[c]["v"]
    if first["valid"] is not None:
        acc["poc_validation_status"] = "valid"
    elif text(acc, "poc_validation_status") == "" and first["status"]:
        acc["poc_validation_status"] = first["status"]["v"]
    return acc


def _place(columns: list[str], ties: tuple[str, ...]) -> Column:
    """A text that sorts as (seq, ties, a hash of all columns) does."""
    whole = F.lpad((F.col("seq").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat_ws("\x01", whole, *[text_or_empty(F.col(c).cast("string")) for c in ties], F.lpad(F.hex(F.xxhash64(*columns)), 16, "0"))


def _bare(f: dict, c: str) -> str:
    return (f.get(c) or "").strip(_SPACE)


def _level(f: dict) -> int:
    return {"high": 3, "low": 1}.get(_bare(f, "confidence").lower(), 2)


def _points(f: dict) -> int:
    out = 100 * _RANK.get(_bare(f, "severity"), 0) + 20 * _level(f) + 20 * (_bare(f, "poc_validation_status").lower() == "valid")
    return out + 12 * bool(_bare(f, "code_snippet")) + 10 * bool(_bare(f, "poc_raw")) + 6 * bool(_bare(f, "endpoint")) + min(MOST_CHARS, len(_bare(f, "description")) // CHARS_A_POINT)


def _met(before: dict, other: dict) -> dict:
    """The merged finding so far and the next one, merged."""
    p, s = (before, other) if _points(before) >= _points(other) else (other, before)
    out = dict(p)
    ranks = [_RANK.get(_bare(x, "severity"), 0) for x in (p, s)]
    out["severity"] = _named((p if ranks[0] >= ranks[1] else s)["severity"])
    out["confidence"] = (p if _level(p) >= _level(s) else s)["confidence"]
    states = [x["poc_validation_status"] for x in (p, s) if _bare(x, "poc_validation_status")]
    if states:
        out["poc_validation_status"] = "valid" if any(x.strip(_SPACE).lower() == "valid" for x in states) else states[0]
    for c in TEXT_FIELDS:
        if c in out:
            out[c] = _bare(p, c) or _bare(s, c) or out[c]
    for c in ("line_start", "line_end"):
        out[c] = s[c] if p[c] is None else p[c]
    mine, theirs = _bare(p, "endpoint"), _bare(s, "endpoint")
    if mine and theirs and mine != theirs and NOTE + theirs not in _bare(out, "description"):
        out["description"] = f"{_bare(out, 'description')}\n\n{NOTE}{theirs}".strip(_SPACE)
    return out


def _starts(batch: pa.RecordBatch, key: tuple[str, ...]) -> np.ndarray:
    """Where in a batch that is sorted by key another key begins."""
    changed = np.zeros(max(batch.num_rows - 1, 0), bool)
    for c in key:
        one, two = batch.column(c).slice(0, len(changed)), batch.column(c).slice(1)
        alike = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(pc.is_null(one), pc.is_null(two)))
        changed |= ~alike.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, changed])


def _streamed(findings: DataFrame, key: tuple[str, ...], ties: tuple[str, ...]) -> DataFrame:
    """Findings merged key by key as they stream by, in the order of folded_duplicates. Those alone in their key, most as a rule, pass in columns; only the others become rows."""
    columns = findings.columns
    # The hash comes first since numbers sort faster than texts.
    order = [F.xxhash64(*key), *key, "seq", *[text_or_empty(F.col(c).cast("string")) for c in ties], F.xxhash64(*columns)]
    n = max(findings.sparkSession.sparkContext.defaultParallelism, int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small_batches(findings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, last, acc, n = None, None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, done, counts = pa.struct(list(batch.schema)), [], []
            starts = _starts(batch, key)
            size = np.diff(np.r_[starts, batch.num_rows])
            # The first key may go on from the batch before, the last in the next one.
            alone = size == 1
            alone[[0, -1]] = False
            single = batch.take(pa.array(starts[alone]))
            yield pa.RecordBatch.from_arrays([*single.columns, pa.array(np.ones(single.num_rows, np.int64))], names=[*columns, "n_merged"])
            rest = batch.filter(pa.array(~np.repeat(alone, size)))
            ids = list(zip(*[rest.column(c).to_pylist() for c in key], strict=True))
            for this, row in zip(ids, rest.to_pylist(), strict=True):
                if acc is not None and this == last:
                    acc, n = _met(acc, row), n + 1
                    continue
                if acc is not None:
                    done.append(acc)
                    counts.append(n)
                last, acc, n = this, row, 1
            made = pa.array(done, kind)
            yield pa.RecordBatch.from_arrays([*made.flatten(), pa.array(counts, pa.int64())], names=[*columns, "n_merged"])
        if acc is not None:
            yield pa.RecordBatch.from_arrays([*pa.array([acc], kind).flatten(), pa.array([n], pa.int64())], names=[*columns, "n_merged"])

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in findings.schema], T.StructField("n_merged", T.LongType())])
    return findings.repartition(n, *key).sortWithinPartitions(*order).mapInArrow(run, schema)


def folded_duplicates(findings: DataFrame, key: tuple[str, ...] = ("task_id", "dedupe_key"), ties: tuple[str, ...] = (), few: int = FEW, bounds: DataFrame | None = None) -> DataFrame:
    """One finding a key, merged in the order of ``seq``: the columns of ``findings``, those that nothing merges from the finding that was preferred last, and n_merged.

    Each finding in turn meets what came before it; the one with more points (the earlier
    of equals) is preferred and takes severity and confidence if the other's are higher,
    a valid proof if either has one, and the other's text or line where its own is
    missing; the other's endpoint, if it is a different one, is noted in the description
    once. A finding alone stays as it is. Findings of one ``seq`` come in the order of
    ``ties``, then of a hash. Keys of more than ``few`` findings are told by counts of a
    hash (where two meet, both count as such) and merged from records and firsts.
    ``bounds`` has the numbers of findings (n) of groups that no key goes beyond: where none
    has more than ``few``, no key has, and keys needn't be worked out to be counted.
    """
    if bounds is not None and bounds.filter(F.col("n") > few).isEmpty():
        return _streamed(findings, key, ties)
    of = findings.withColumn("_of", F.xxhash64(*key))
    many = checkpointed(of.groupBy("_of").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few).select("_of"))
    if many.isEmpty():
        return _streamed(findings, key, ties)
    rest = _streamed(of.join(many, "_of", "left_anti").drop("_of"), key, ties)
    return rest.unionByName(_from_records(of.join(many, "_of", "left_semi").drop("_of").select(*findings.columns), key, ties))


def _from_records(findings: DataFrame, key: tuple[str, ...], ties: tuple[str, ...]) -> DataFrame:
    """The same from records and firsts, so that no task reads all findings of a key."""
    place = lambda c, v: F.struct(F.col("_q").alias("q"), v.alias("v"))
    bare = lambda c: F.btrim(text_or_empty(c), F.lit(_SPACE))
    columns = findings.columns
    rows = checkpointed(findings.withColumns({"_q": _place(columns, ties), "_score": merge_score(), "_conf": confidence_rank("confidence"), "_rank": severity_rank(F.col("severity"))}))
    least = rows.groupBy(*key, "_score").agg(F.min("_q").alias("q"))
    better = F.min("q").over(Window.partitionBy(*key).orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, -1))
    records = least.withColumn("_b", better).filter(F.col("_b").isNull() | (F.col("q") < F.col("_b"))).groupBy(*key).agg(F.array_sort(F.collect_list("q")).alias("_recs"))
    marked = checkpointed(rows.join(records, list(key)))
    proof = F.lower(bare("poc_validation_status"))
    filled = lambda c: F.min(F.when(bare(c) != "", place(c, bare(c))))
    texts = [c for c in TEXT_FIELDS if c in columns]
    firsts = marked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("_q") > F.col("_recs")[0], F.col("_q"))).alias("second"), F.first("_recs").alias("recs"), F.count_if(F.col("_q") == F.col("_recs")[0]).alias("alike"),
        F.min(F.when(proof == "valid", F.col("_q"))).alias("valid"), F.min(F.when(bare("poc_validation_status") != "", place("", F.col("poc_validation_status")))).alias("status"),
        F.min(F.when(bare("code_snippet") != "", F.col("_q"))).alias("snippet"), F.min(F.when(bare("poc_raw") != "", F.col("_q"))).alias("proof"), F.min(F.when(bare("endpoint") != "", F.col("_q"))).alias("entry"),
        *[filled(c).alias(c) for c in texts], *[F.min(F.when(F.col(c).isNotNull(), place(c, F.col(c)))).alias(c) for c in ("line_start", "line_end")],
        *[F.min(F.when(F.col("_conf") == r, place("", F.col("confidence")))).alias(f"_c{r}") for r in (1, 2, 3)], *[F.min(F.when(F.col("_rank") == r, F.col("_q"))).alias(f"_s{r}") for r in range(1, 6)],
    )
    levels = F.array_compact(F.array(*[F.when(F.col(f"_c{r}").isNotNull(), F.struct(F.lit(r).alias("r"), F.col(f"_c{r}.q").alias("q"), F.col(f"_c{r}.v").alias("v"))) for r in (1, 2, 3)]))
    ranks = F.array_compact(F.array(*[F.when(F.col(f"_s{r}").isNotNull(), F.struct(F.lit(r).alias("r"), F.col(f"_s{r}").alias("q"))) for r in range(1, 6)]))
    told = checkpointed(firsts.withColumns({"levels": levels, "ranks": ranks}).drop(*[f"_c{r}" for r in (1, 2, 3)], *[f"_s{r}" for r in range(1, 6)]))
    wanted = told.select(*key, F.explode(F.array_distinct(F.array_compact(F.concat("recs", F.array("second"))))).alias("_q"))
    kept = rows.join(wanted, [*key, "_q"]).groupBy(*key).agg(F.collect_list(F.to_json(F.struct(*columns, "_q", "_score", "_conf"), {"ignoreNullFields": "false"})).alias("rows"))
    part = F.size(F.filter("_recs", lambda q: q <= F.col("_q")))
    entries = marked.filter(bare("endpoint") != "").groupBy(*key, part.alias("_part"), bare("endpoint").alias("e")).agg(F.min("_q").alias("q")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("q", "e"))).alias("endpoints"))
    about = F.to_json(F.struct(*[c for c in told.columns if c not in (*key, "recs", "second")]), {"ignoreNullFields": "false"}).alias("first")
    met = told.select(*key, about).join(kept, list(key)).join(entries, list(key), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for raw, first, ends in zip(batch.column("rows").to_pylist(), batch.column("first").to_pylist(), batch.column("endpoints").to_pylist(), strict=True):
                of = {r["_q"]: r for r in map(json.loads, raw)}
                first = json.loads(first)
                merged = _replay(of, first, [(x["q"], x["e"]) for x in ends or []])
                out.append(json.dumps(merged, ensure_ascii=False))
                n.append(first["n"])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int64())], names=["merged", "n_merged"])

    schema = T.StructType([findings.schema[c] for c in columns])
    made = met.select("rows", "first", "endpoints").mapInArrow(run, "merged string, n_merged long")
    return made.select(F.from_json("merged", schema).alias("m"), "n_merged").select("m.*", "n_merged")
