"""Following tasks as their events come: a source with a cursor, stalls told by timers, runs whose state goes when they are over.

The event log is a folder of Parquet files (``events.store``, or any table of events).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .events import EVENT_SCHEMA, TERMINAL
from .state import MESSAGE_CHARS, STATE

#: Events of a batch, seconds without an event that make a stall, events that end a task's run.
BATCH, STALL_SECONDS = 100, 900
ENDINGS = tuple(f"run.{s}" for s in TERMINAL)


class _Cursor(SimpleDataSourceStreamReader):
    """A task's events by id, a batch after the other; an offset is the id of the last one read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.task = options["path"], int(options["task_id"])
        self.start, self.batch = int(options.get("cursor", "0")), min(max(int(options.get("batch", str(BATCH))), 1), 500)

    def initialOffset(self) -> dict:
        return {"id": self.start}

    def _rows(self, low: int, high: int | None) -> list[tuple]:
        import pyarrow as pa
        import pyarrow.dataset as ds

        names = [c.split(" ")[0] for c in EVENT_SCHEMA.split(", ")]
        wanted = (ds.field("task_id") == self.task) & (ds.field("id") > low)
        wanted = wanted if high is None else wanted & (ds.field("id") <= high)
        log = ds.dataset(self.path, format="parquet", partitioning="hive")
        # Only a batch's rows are held beside those of the file at hand.
        held: list[tuple] = []
        for part in log.to_batches(columns=names, filter=wanted):
            # Spark's older form of timestamps has no zone and is UTC.
            at = part.column("created_at").cast(pa.timestamp("us", getattr(part.column("created_at").type, "tz", None)))
            part = part.set_column(names.index("created_at"), "created_at", at.cast(pa.timestamp("us", "UTC")))
            rows = {r["id"]: tuple(r[n] for n in names) for r in part.to_pylist()}
            held = [r for _, r in sorted(({r[0]: r for r in held} | rows).items())]
            held = held if high is not None else held[: self.batch]
        return held

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._rows(start["id"], None)
        return iter(rows), {"id": rows[-1][0] if rows else start["id"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["id"], end["id"]))

    def commit(self, end: dict) -> None:
        return


class EventCursor(DataSource):
    """``format("event_cursor")`` with path, task_id, cursor (default 0) and batch (default 100, 1 to 500): events of a task that follow the cursor."""

    @classmethod
    def name(cls) -> str:
        return "event_cursor"

    def schema(self) -> str:
        return EVENT_SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Cursor(self.options)


def cursor_stream(spark: SparkSession, path: str, task_id: int, cursor: int = 0, batch: int = BATCH) -> DataFrame:
    """A task's events after a cursor as a stream, in the order of their ids, so many a batch at most."""
    spark.dataSource.register(EventCursor)
    return spark.readStream.format("event_cursor").option("path", path).option("task_id", str(task_id)).option("cursor", str(cursor)).option("batch", str(batch)).load()


def follow_task(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, status: Callable[[], str], batch: int = BATCH, pause: float = 2.0, most: int | None = None) -> int:
    """Hands a task's batches to ``each`` until the task is over and all its events are read; gives the number of events.

    What was read is kept in the checkpoint: a call after one that broke off goes on where
    that one stopped, and loses and repeats nothing as far as ``each`` is done once a batch
    number. ``most`` bounds the number of batches (None: none).
    """
    import time

    seen = rounds = 0
    while most is None or rounds < most:
        over = status() in TERMINAL  # asked before reading, so that no event after the last one is missed
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(once=True).start()
        query.awaitTermination()
        got = sum(p["numInputRows"] for p in query.recentProgress)
        seen, rounds = seen + got, rounds + 1
        if over and got < batch:
            break
        if got < batch:
            time.sleep(pause)
    return seen


class _Stalls(StatefulProcessor):
    """A task's events in the order of their ids, once the watermark has passed them; timers wake it for them and for stalls."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, ms long, ends boolean")
        self.last = handle.getValueState("last", "id long, ms long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        more = [(int(r.id), int(r.ms), bool(r.ends)) for pdf in rows for r in pdf.itertuples()]
        self.waiting.appendList(more)
        yield self._settle(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(key, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key: tuple, watermark: int) -> pd.DataFrame:
        out: list[tuple] = []
        held = sorted({tuple(r) for r in self.waiting.get()}) if self.waiting.exists() else []
        due, later = [e for e in held if e[1] <= watermark], [e for e in held if e[1] > watermark]
        last = tuple(self.last.get()) if self.last.exists() else None
        for at, ms, ends in due:
            if last is not None and ms // 1000 - last[1] // 1000 >= self.seconds:
                out.append(("gap", last[0], at, ms // 1000 - last[1] // 1000))
            last = None if ends else (at, ms, False)
        if last is not None and not last[2] and last[1] + self.seconds * 1000 <= watermark and not due[len(due) :]:
            out.append(("stalled", last[0], None, self.seconds))
            last = (*last[:2], True)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(e[1] for e in later))
        elif self.waiting.exists():
            self.waiting.clear()
        if last is None:  # a run that is over leaves no state
            if self.last.exists():
                self.last.clear()
        else:
            self.last.update(last)
            if not last[2]:
                self.handle.registerTimer(last[1] + self.seconds * 1000)
        named = [(key[0], kind, a, b, n) for kind, a, b, n in out]
        return pd.DataFrame(named, columns=["task_id", "kind", "after_id", "before_id", "silence_seconds"]).astype({"after_id": "Int64", "before_id": "Int64"})

    def close(self) -> None:
        return


def follow_stalls(events: DataFrame, delay: str = "10 minutes", seconds: int = STALL_SECONDS) -> DataFrame:
    """Of a stream of events: task_id, kind, after_id, before_id, silence_seconds.

    ``gap`` is a silence of so many seconds or more between two events of a task, as
    ``events.silences`` finds them; ``stalled`` is told as soon as that long has passed
    without an event. Events may come late by ``delay``. State is a task's last event and
    those that the watermark hasn't passed; a run's end removes it. Needs the RocksDB
    state store.
    """
    rows = events.withWatermark("created_at", delay).select("task_id", "id", "created_at", F.unix_millis("created_at").alias("ms"), F.col("event_type").isin(*ENDINGS).alias("ends"))
    schema = "task_id long, kind string, after_id long, before_id long, silence_seconds long"
    return rows.groupBy("task_id").transformWithStateInPandas(_Stalls(seconds), schema, "append", "EventTime")


_KEPT = "status string, started_at timestamp, completed_at timestamp, error_message string, end_seq long, last_seq long"


def follow_runs(transitions: DataFrame, keep: str | None = None, delay: str = "1 hour") -> DataFrame:
    """As ``state.run_states``, of a stream: each batch gives the runs that it changed.

    The end of a run is the first terminal transition by ``seq``, whenever it comes: one
    that comes late corrects what was told. With ``keep``, the state of a run goes so long
    after its end, by event time with transitions late by ``delay`` at most.
    """
    wait = pd.Timedelta(keep) if keep else None

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, start, end, error, end_seq, last_seq = state.get if state.exists else (None, None, None, "", None, None)
        before = (status, end, error)
        for pdf in frames:
            for r in pdf.itertuples():
                start = r.at if start is None or pd.isna(start) else min(start, r.at)
                if r.status in TERMINAL and (end_seq is None or r.seq < end_seq):
                    status, end, end_seq = r.status, r.at, int(r.seq)
                    error = (r.message or "")[:MESSAGE_CHARS] if status == "failed" else ""
                elif end_seq is None and (last_seq is None or r.seq > last_seq):
                    status, last_seq = r.status, int(r.seq)
        state.update((status, start, end, error, end_seq, last_seq))
        if wait is not None and end_seq is not None:
            due = int((pd.Timestamp(end) + wait).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if (status, end, error) != before:
            yield pd.DataFrame({"task_id": [key[0]], "run_id": [key[1]], "status": [status], "started_at": [start], "completed_at": [end], "error_message": [error]})

    rows = transitions.select("task_id", "run_id", "seq", "status", "message", "at")
    rows = rows.withWatermark("at", delay) if keep else rows
    timeout = GroupStateTimeout.EventTimeTimeout if keep else GroupStateTimeout.NoTimeout
    return rows.groupBy("task_id", "run_id").applyInPandasWithState(update, f"task_id long, run_id long, {STATE}", _KEPT, "update", timeout)


def claim(candidates: DataFrame, folder: str, worker: str) -> DataFrame:
    """Of the tasks that ``state.claims`` lists, those that this worker gets: whoever makes a task's file in the shared folder first has it.

    At most as many rows as there are workers are looked at. Adds claimed_by.
    """
    spark = candidates.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    got = []
    for row in candidates.select("task_id").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{row['task_id']}")
        try:
            out = path.getFileSystem(conf).create(path, False)
        except Exception as e:
            if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            continue
        out.write(bytearray(worker.encode()))
        out.close()
        got.append(row["task_id"])
    return candidates.filter(F.col("task_id").isin(got)).withColumn("claimed_by", F.lit(worker)) if got else candidates.limit(0).withColumn("claimed_by", F.lit(worker))
