"""Merged duplicates against merging one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.functions.severity import ALIASES, SEVERITIES
from auditloom.operators.findings import TEXT_FIELDS
from auditloom.operators.folding import folded_duplicates

SCHEMA = "task_id long, dedupe_key string, seq long, stage_num int, title string, severity string, vuln_type string, file_path string, line_start int, line_end int, code_snippet string, endpoint string, poc_raw string, poc_validation_status string, description string, fix_suggestion string, confidence string, salvaged boolean"
NAMES = [x.split(" ")[0] for x in SCHEMA.split(", ")]
RANK = {s: 5 - i for i, s in enumerate(SEVERITIES)}


def bare(x):
    return (x or "").strip()


def level(f):
    return {"high": 3, "low": 1}.get(bare(f["confidence"]).lower(), 2)


def points(f):
    out = 100 * RANK.get(bare(f["severity"]), 0) + 20 * level(f) + 20 * (bare(f["poc_validation_status"]).lower() == "valid")
    return out + 12 * bool(bare(f["code_snippet"])) + 10 * bool(bare(f["poc_raw"])) + 6 * bool(bare(f["endpoint"])) + min(12, len(bare(f["description"])) // 80)


def merged(a, b):
    p, s = (a, b) if points(a) >= points(b) else (b, a)
    out = dict(p)
    worst = p["severity"] if RANK.get(bare(p["severity"]), 0) >= RANK.get(bare(s["severity"]), 0) else s["severity"]
    out["severity"] = ALIASES.get(bare(worst).lower(), "Medium")
    out["confidence"] = p["confidence"] if level(p) >= level(s) else s["confidence"]
    states = [x["poc_validation_status"] for x in (p, s) if bare(x["poc_validation_status"])]
    out["poc_validation_status"] = "valid" if any(bare(x).lower() == "valid" for x in states) else states[0] if states else p["poc_validation_status"]
    for c in TEXT_FIELDS:
        out[c] = bare(p[c]) or bare(s[c]) or out[c]
    for c in ("line_start", "line_end"):
        out[c] = s[c] if p[c] is None else p[c]
    ends = list(dict.fromkeys(bare(x["endpoint"]) for x in (p, s) if bare(x["endpoint"])))
    if len(ends) > 1:
        note = "等价入口：" + ends[1]
        if note not in bare(out["description"]):
            out["description"] = f"{bare(out['description'])}\n\n{note}".strip()
    return out


def one_by_one(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        k = (r["task_id"], r["dedupe_key"])
        m, n = out.get(k, (None, 0))
        out[k] = (dict(r) if m is None else merged(m, r), n + 1)
    return {k: tuple(m[c] for c in NAMES) + (n,) for k, (m, n) in out.items()}


def made(rng, key, seq, rich):
    some = lambda values, p: rng.choice(values) if rng.random() < p else rng.choice([None, "", "  "])
    return {
        "task_id": 1, "dedupe_key": key, "seq": seq, "stage_num": rng.randrange(2, 10), "title": some([f"t{seq}", " t "], rich), "severity": rng.choice([*SEVERITIES, "high", "高危", "", None, "weird"][rng.choice([0, 2, 3, 5]) :]),
        "vuln_type": some([f"v{seq}"], rich), "file_path": some(["a.py"], rich), "line_start": rng.choice([None, seq]), "line_end": rng.choice([None, seq + 1]), "code_snippet": some([f"x{seq}"], rich / 2),
        "endpoint": some([f"GET /{rng.randrange(6)}", "GET /1", "GET /12"], rich), "poc_raw": some(["p"], rich / 3), "poc_validation_status": some(["invalid", "Valid", "valid", "pending"], rich / 4),
        "description": some([f"d{seq} " * rng.randrange(1, 400)], rich / 2), "fix_suggestion": some(["f"], rich), "confidence": rng.choice(["high", "LOW", "?", None, "medium"]), "salvaged": rng.choice([None, True, False]),
    }


@pytest.mark.parametrize("seed", range(3))
def test_merging_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(250):
        order = rng.sample(range(10_000), rng.choice([1, 2, 2, 3, 4, 8, 30]))
        rich = rng.choice([0.1, 0.5, 0.9])
        rows += [made(rng, f"k{k}", q, rich) for q in order]
        if k % 5 == 0:  # the first finding once more
            rows.append(dict(min((r for r in rows if r["dedupe_key"] == f"k{k}"), key=lambda r: r["seq"])))
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA).repartition(1 + 3 * seed)
    got = {(r["task_id"], r["dedupe_key"]): tuple(r) for r in folded_duplicates(df).collect()}
    want = one_by_one(rows)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k], k


def test_a_hot_key_is_replayed_from_few_rows(spark):
    """100,000 findings of one key: as one by one, and only records and firsts reach the replay."""
    n = 100_000
    i = F.col("id")
    df = spark.range(n).select(
        F.lit(1).cast("long").alias("task_id"), F.lit("hot").alias("dedupe_key"), (i * 7919 % n).alias("seq"), (i % 8 + 2).cast("int").alias("stage_num"), F.concat(F.lit("t"), i.cast("string")).alias("title"),
        F.element_at(F.array(*map(F.lit, ("Low", "Medium", "Info", "high", "High", "Critical"))), F.when(i % 977 == 5, 6).when(i % 101 == 7, 5).otherwise((i % 4 + 1).cast("int"))).alias("severity"), F.lit("v").alias("vuln_type"),
        F.lit("a.py").alias("file_path"), F.when(i % 3 == 0, i.cast("int")).alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.when(i % 5 == 0, "x").alias("code_snippet"), F.concat(F.lit("GET /"), (i % 40).cast("string")).alias("endpoint"),
        F.lit("").alias("poc_raw"), F.lit("").alias("poc_validation_status"), F.repeat(F.lit("d"), (i % 900).cast("int")).alias("description"), F.lit(None).cast("string").alias("fix_suggestion"), F.lit("low").alias("confidence"), F.lit(False).alias("salvaged"),
    )
    rows = [r.asDict() for r in df.collect()]
    want = one_by_one(rows)[(1, "hot")]
    for parts in (2, 9):
        assert [tuple(r) for r in folded_duplicates(df.repartition(parts)).collect()] == [want]


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_keys_of_few_and_of_many_findings_merge_alike(spark, few):
    """By records alone, by both ways, and streaming by alone."""
    rng = random.Random(few)
    rows = [made(rng, f"k{k}", q, 0.6) for k in range(80) for q in rng.sample(range(10_000), rng.choice([1, 2, 5, 12]))]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA).repartition(5)
    got = {(r["task_id"], r["dedupe_key"]): tuple(r) for r in folded_duplicates(df, few=few).collect()}
    assert got == one_by_one(rows)


def test_findings_of_few_a_key_are_shuffled_once(spark):
    """No finding is kept in a checkpoint and none joined with what its key's records tell: one exchange and one sort."""
    rng = random.Random(1)
    df = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in (made(rng, f"k{q % 7}", q, 0.5) for q in range(50))], SCHEMA)
    plan = folded_duplicates(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Sort") == 1 and plan.count("Repartition") == 1


@pytest.mark.parametrize("few", [3, 20_000])
def test_keys_go_on_from_batch_to_batch(spark, few):
    """Most keys have one finding, others run over batches of three; bounds that no key goes beyond, here the task's findings, change no result."""
    rng = random.Random(few)
    rows = [made(rng, f"k{k}", q, 0.6) for k in range(120) for q in rng.sample(range(10_000), rng.choice([1, 1, 1, 2, 3, 7]))] + [made(rng, None, q, 0.6) for q in (5, 3, 9)]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA).repartition(5)
    bounds = df.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "3")
    try:
        got = {(r["task_id"], r["dedupe_key"]): tuple(r) for r in folded_duplicates(df.filter("dedupe_key IS NOT NULL"), few=few, bounds=bounds).collect()}
        streamed = {(r["task_id"], r["dedupe_key"]): tuple(r) for r in folded_duplicates(df, bounds=bounds).collect()}
    finally:
        spark.conf.unset(batch)
    want = one_by_one(rows)
    assert streamed == want and got == {k: v for k, v in want.items() if k[1] is not None}


def test_keys_of_bounded_groups_arent_worked_out_to_be_counted(spark):
    """Counting by a group that is cheap to tell leaves the keys to the merge alone: one evaluation a finding."""
    rng = random.Random(2)
    rows = [made(rng, f"k{q % 7}", q, 0.5) for q in range(50)]
    seen = spark.sparkContext.accumulator(0)

    def counted(key):
        seen.add(1)
        return key

    df = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA).repartition(2)
    keyed = df.withColumn("dedupe_key", F.udf(counted, "string").asNondeterministic()("dedupe_key"))
    assert len(folded_duplicates(keyed, bounds=df.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))).collect()) == 7
    assert seen.value == 50
