"""The event log: cursors, binding to runs, stalls and statistics, in batch and as a stream.

Events are (id, task_id, run_id, stage_num, event_type, payload, created_at) and are ordered by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.rule_hits import top
from ..operators.running import last_before

#: Statuses that end a run or task.
TERMINAL = ("completed", "failed", "cancelled")
EVENT_SCHEMA = "id long, task_id long, run_id long, stage_num int, event_type string, payload string, created_at timestamp"


def after_cursor(events: DataFrame, cursor: int, limit: int = 100) -> DataFrame:
    """Per task the next events after the cursor; the limit is 1 to 500."""
    return top(events.filter(F.col("id") > cursor), ["task_id"], [F.col("id")], min(max(limit, 1), 500))


def recent(events: DataFrame, limit: int = 50) -> DataFrame:
    """Per task the last events, with their place in ascending order."""
    last = top(events, ["task_id"], [F.desc("id")], limit)
    return last.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("id")))


def current_run(runs: DataFrame) -> DataFrame:
    """Per task the latest run that isn't over, else the latest."""
    open_ = (~F.col("status").isin(*TERMINAL)).cast("int")
    return runs.groupBy("task_id").agg(F.max(F.struct(open_.alias("open"), F.col("id").alias("run_id"), "status")).alias("_r")).select("task_id", "_r.run_id", "_r.status", (F.col("_r.open") == 1).alias("is_open"))


def bind_runs(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Events without a run get their task's run that had started last when they came, open ones first; else the task's latest run.

    Runs (id, task_id, started_at, ended_at) and events are sorted together by range and the
    last start is carried forward, so no event meets all runs of its task, and a task of any
    size is many tasks' work.
    """
    marks = runs.select("task_id", F.col("started_at").alias("at"), F.lit(0).alias("kind"), F.col("id").alias("mark"), F.col("ended_at").alias("until"))
    rows = events.select("task_id", F.col("created_at").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("mark"), F.lit(None).cast("timestamp").alias("until"), F.struct(*events.columns).alias("event"))
    both = marks.withColumn("event", F.lit(None).cast(rows.schema["event"].dataType)).unionByName(rows)
    start = F.when(F.col("kind") == 0, F.struct("mark", F.coalesce("until", F.to_timestamp(F.lit("9999-01-01"))).alias("until")))
    # An event sorts behind the runs that start when it comes.
    seen = last_before(both, ["task_id"], ["at", "kind", "mark"], start, "_run").filter("kind = 1").withColumns({"_last": F.col("_run.mark"), "_until": F.col("_run.until")})
    latest = runs.groupBy("task_id").agg(F.max("id").alias("_latest"))
    return seen.join(latest, "task_id", "left").select("event.*", F.coalesce("event.run_id", "_last", "_latest").alias("bound_run_id"), F.coalesce(F.col("_until") > F.col("at"), F.lit(False)).alias("run_open"))


def stats(events: DataFrame, by: list[str]) -> DataFrame:
    """Counts by kind, and tokens named in payloads, in one pass."""
    kind = F.col("event_type")
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(kind.contains("error") | kind.contains("failed")).alias("n_failed"), F.countDistinct("event_type").alias("n_types"), F.coalesce(F.sum(F.get_json_object("payload", "$.tokens").try_cast("long")), F.lit(0)).alias("tokens"), F.max("id").alias("next_cursor"))


def unseen(incoming: DataFrame, seen: DataFrame, keep: int = 2000) -> DataFrame:
    """Seen and incoming events without doubles, the last ``keep`` of each task."""
    fresh = incoming.join(seen.select("task_id", "id"), ["task_id", "id"], "left_anti").dropDuplicates(["task_id", "id"])
    return top(seen.unionByName(fresh, allowMissingColumns=True), ["task_id"], [F.desc("id")], keep).drop("rank")


def silences(events: DataFrame, seconds: int = 900) -> DataFrame:
    """Gaps of so many seconds or more between a task's events, with the ids on either side."""
    rows = events.select("task_id", "id", "created_at")
    out = last_before(rows, ["task_id"], ["id"], F.struct("id", "created_at"), "_b").withColumn("silence_seconds", F.unix_timestamp("created_at") - F.unix_timestamp("_b.created_at"))
    return out.filter(F.col("silence_seconds") >= seconds).select("task_id", F.col("_b.id").alias("after_id"), F.col("id").alias("before_id"), "silence_seconds")


def sessions(events: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """Runs of events of a task without such a gap. Works on a stream too, if it has a watermark."""
    s = events.groupBy("task_id", F.session_window("created_at", gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    return s.select("task_id", F.col("s.start").alias("started_at"), F.col("s.end").alias("ended_at"), "n_events")


def diagnose(tasks: DataFrame, runs: DataFrame, subtasks: DataFrame, agents: DataFrame, events: DataFrame, now, threshold: int = 900) -> DataFrame:
    """Per task one of ten states: paused, cancelled, blocked, failed, running, starting, waiting, completed, stalled, not_started."""
    cur = current_run(runs).select("task_id", "run_id", F.col("status").alias("run_status"))
    some = lambda df, names: df.groupBy("task_id").agg(*[F.max((F.col("status") == n).cast("int")).alias(f"{p}{n}") for p, n in names])
    sub = some(subtasks, [("s_", n) for n in ("cancelled", "failed", "blocked", "running", "skipped", "pending")])
    agent = some(agents, [("a_", n) for n in ("failed", "running")])
    last = events.groupBy("task_id").agg(F.max("created_at").alias("last_event_at"))
    t = tasks.select("task_id", F.col("status").alias("task_status"), F.coalesce("guard_status", F.lit("")).alias("guard") if "guard_status" in tasks.columns else F.lit("").alias("guard")).join(cur, "task_id", "left").join(sub, "task_id", "left").join(agent, "task_id", "left").join(last, "task_id", "left")
    is_ = lambda s: (F.col("task_status") == s) | F.coalesce(F.col("run_status") == s, F.lit(False))
    any_ = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    state = (
        F.when(is_("paused"), "paused").when(is_("cancelled") | any_("s_cancelled"), "cancelled").when((F.col("guard") == "blocked") & (F.col("task_status") != "completed"), "blocked")
        .when(is_("failed") | any_("s_failed") | any_("a_failed"), "failed").when(any_("s_blocked"), "blocked").when(is_("running") | any_("s_running") | any_("a_running"), "running")
        .when(is_("pending"), "starting").when((any_("s_skipped") | any_("s_pending")) & ~F.col("task_status").isin(*TERMINAL), "waiting").when(is_("completed"), "completed")
        .when(F.col("run_id").isNotNull(), "waiting").otherwise("not_started")
    )
    quiet = F.greatest(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_event_at"), F.lit(0))
    out = t.withColumn("silence_seconds", quiet).withColumn("_s", state)
    stalled = F.col("_s").isin("running", "starting", "waiting") & F.coalesce(F.col("silence_seconds") >= threshold, F.lit(False))
    return out.select("task_id", "run_id", "task_status", "run_status", F.when(stalled, "stalled").otherwise(F.col("_s")).alias("focus_status"), stalled.alias("stalled"), "silence_seconds")


def read_log(spark: SparkSession, path: str, since: int = 0, limit: int = 200, stage: int | None = None, kind: str | None = None) -> DataFrame:
    """An event log of JSON lines: what follows the cursor, of one stage or kind if asked for, the last ``limit`` of each task; broken lines are left out. Adds total, how many there were, and has_more."""
    rows = spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter(F.col("id") > since)
    rows = rows if stage is None else rows.filter(F.col("stage_num") == stage)
    rows = rows if kind is None else rows.filter(F.col("event_type") == kind)
    total = rows.groupBy("task_id").agg(F.count(F.lit(1)).alias("total"))
    return top(rows, ["task_id"], [F.desc("id")], limit).join(total, "task_id").withColumn("has_more", F.col("total") > limit)


#: How long a text of a payload is at most in a log.
PREVIEW_CHARS = 500


def compacted(events: DataFrame) -> DataFrame:
    """Events with payloads (JSON objects) as a log keeps them: fields that are null or empty left out, texts cut with a mark."""
    fields = F.from_json("payload", "map<string,string>")
    kept = F.map_filter(fields, lambda _, v: v.isNotNull() & ~v.isin("", "[]", "{}"))
    cut = F.transform_values(kept, lambda _, v: F.when(F.length(v) > PREVIEW_CHARS, F.concat(F.substring(v, 1, PREVIEW_CHARS), F.lit("...[truncated]"))).otherwise(v))
    return events.withColumn("payload", F.coalesce(F.to_json(cut), F.col("payload")))


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).json(path)


def follow(events: DataFrame, name: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Follow a stream of events once through: doubles dropped within the delay, counts by task and kind in table ``name``."""
    counted = events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["task_id", "id"]).groupBy("task_id", "event_type").count()
    return counted.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Store a stream of events as Parquet once through: doubles dropped within the delay, a folder a kind; it goes on where it stopped."""
    once = events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["task_id", "id"])
    return once.writeStream.format("parquet").partitionBy("event_type").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
