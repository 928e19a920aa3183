"""Cursors, stalls by timers, corrected ends of runs, claims."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.streaming import events as ev
from auditloom.streaming import follow, state


def log(spark, rows):
    """(id, task, kind, seconds)"""
    df = spark.createDataFrame(rows, "id long, task_id long, event_type string, s long")
    return df.select("id", "task_id", F.lit(None).cast("long").alias("run_id"), F.lit(None).cast("int").alias("stage_num"), "event_type", F.lit("{}").alias("payload"), F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("created_at"))


def test_a_cursor_goes_on_where_it_stopped(spark, tmp_path):
    rows = [(i, 1 + i % 2, "done", i) for i in range(1, 501)]
    random.Random(1).shuffle(rows)
    log(spark, rows).repartition(3).write.parquet(f"{tmp_path}/log")
    stream = follow.cursor_stream(spark, f"{tmp_path}/log", 1, cursor=20, batch=100)
    got, now = {}, {"status": "running"}

    def each(batch, number):
        got.setdefault(number, []).extend(r["id"] for r in batch.collect())

    run = lambda most=None: follow.follow_task(stream, each, f"{tmp_path}/check", lambda: now["status"], pause=0, most=most)
    assert run(2) == 200 and [len(v) for v in got.values()] == [100, 100]
    now["status"] = "completed"
    # A call after the first broke off loses and repeats nothing, and ends: the task is over and its events are read.
    assert run() == 40
    assert [i for v in got.values() for i in v] == [i for i in range(22, 501, 2)]
    # Events that came meanwhile are read by the next call.
    log(spark, [(601, 1, "done", 9), (602, 2, "done", 9)]).write.mode("append").parquet(f"{tmp_path}/log")
    assert run() == 1 and [i for v in got.values() for i in v][-1] == 601


def test_stalls_by_timers_equal_the_batch(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng, rows, at = random.Random(3), [], dict.fromkeys(range(1, 6), 0)
        for i in range(1, 200):
            task = rng.randrange(1, 6)
            at[task] = max(at[task], max(at.values()) - 400) + rng.choice([1, 30, 899, 900, 1500])
            rows.append((i, task, "done", at[task]))
        end = max(at.values()) + 5000
        rows.sort(key=lambda r: r[3])
        for k in range(5):  # files in the order of time, events within one and the next mixed
            part = rows[k * 40 : (k + 1) * 40]
            rng.shuffle(part)
            log(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        log(spark, [(1000, 99, "tick", end), (1001, 5, "run.completed", end)]).coalesce(1).write.parquet(f"{tmp_path}/in/5")
        log(spark, [(1002, 99, "tick", end + 5000)]).coalesce(1).write.parquet(f"{tmp_path}/in/6")
        schema = spark.read.parquet(f"{tmp_path}/in/0").schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = follow.follow_stalls(stream, "20 minutes").writeStream.format("memory").queryName("stalls").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        told = spark.table("stalls").collect()
        gaps = sorted((r["task_id"], r["after_id"], r["before_id"], r["silence_seconds"]) for r in told if r["kind"] == "gap")
        whole = ev.silences(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
        # What the watermark has not passed yet is still to come.
        want = sorted((r["task_id"], r["after_id"], r["before_id"], r["silence_seconds"]) for r in whole.collect() if r["before_id"] != 1002)
        assert gaps == want
        stalled = {r["task_id"] for r in told if r["kind"] == "stalled"}
        assert stalled == {1, 2, 3, 4, 5, 99}
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert left < 40  # a few rows a task, none of the one that is over
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("seed", range(2))
def test_late_ends_correct_what_was_told(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(1, run, seq, rng.choice(["running", "paused", "completed", "failed", "cancelled"]), f"m{run}.{seq}", f"2024-01-01 00:{seq:02d}:00") for run in range(1, 9) for seq in range(1, 8)]
    rng.shuffle(rows)
    schema = "task_id long, run_id long, seq long, status string, message string, at timestamp"
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {}

    def each(batch, number):
        got.update({r["run_id"]: (r["status"], r["completed_at"], r["error_message"]) for r in batch.collect()})

    query = follow.follow_runs(stream, keep="1 day" if seed else None).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    whole = state.run_states(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    assert got == {r["run_id"]: (r["status"], r["completed_at"], r["error_message"]) for r in whole.collect()}


def test_state_of_runs_that_are_over_goes(spark, tmp_path):
    schema = "task_id long, run_id long, seq long, status string, message string, at timestamp"
    rows = [[(1, r, 1, "completed", "", "2024-01-01 00:00:00") for r in range(50)], [(1, 100, 1, "running", "", "2024-01-03 00:00:00")], [(1, 101, 1, "running", "", "2024-01-05 00:00:00")], [(1, 102, 1, "running", "", "2024-01-06 00:00:00")]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = follow.follow_runs(stream, keep="1 day").writeStream.format("memory").queryName("kept").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("kept").count() == 53 and query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_a_task_is_claimed_once(spark, tmp_path):
    tasks = spark.createDataFrame([(i, "pending", True, None, f"2024-01-0{i}") for i in range(1, 6)], "task_id long, status string, queued boolean, claimed_at string, created_at string")
    runs = spark.createDataFrame([(2,)], "task_id long")
    mine = follow.claim(state.claims(tasks, runs, 3), f"file://{tmp_path}/claims", "w1").orderBy("task_id").collect()
    theirs = follow.claim(state.claims(tasks, runs, 4), f"file://{tmp_path}/claims", "w2").collect()
    assert [(r["task_id"], r["mode"], r["claimed_by"]) for r in mine] == [(1, "full", "w1"), (2, "rerun", "w1"), (3, "full", "w1")]
    assert [(r["task_id"], r["claimed_by"]) for r in theirs] == [(4, "w2")]
    assert follow.claim(state.claims(tasks, runs, 4), f"file://{tmp_path}/claims", "w3").count() == 0
