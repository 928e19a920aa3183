"""Reports of all tasks in one job: rendered where the rows are, published together when all are there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.severity import severity_order
from ..operators.rule_hits import top
from ..plans.views import REPORT_COLUMNS, location, report_page


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a report was written, its name


class _Writer(DataSourceWriter):
    """Each task of the job writes into a folder beside the reports; the commit moves what finished tasks wrote, an abort removes the folder."""

    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        where, base = fs.FileSystem.from_uri(self.path)
        return where, f"{base}/{name}"

    def write(self, iterator: Iterator) -> _Written:
        files = []
        attempt = TaskContext.get().taskAttemptId()
        for task, rows in groupby(iterator, key=lambda r: r["task_id"]):
            rows = list(rows)  # as many as a report shows
            shown = [tuple(r[c] for c in REPORT_COLUMNS) for r in rows if r["rank"] is not None]
            where, staged = self._at(f"{self.staging}/{attempt}-{task}.html")
            where.create_dir(staged.rsplit("/", 1)[0], recursive=True)
            with where.open_output_stream(staged) as out:
                out.write(report_page(task, shown, rows[0]["n_rejected"]).encode())
            files.append((staged, f"{task}.html"))
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for staged, name in m.files if m else ():
                where, final = self._at(name)
                where.move(staged, final)
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, staging = self._at(self.staging)
        if where.get_file_info(staging).type != fs.FileType.NotFound:
            where.delete_dir(staging)


class Reports(DataSource):
    """``format("reports")`` with path: rows of task_id, n_rejected, rank and REPORT_COLUMNS, those of a task together and in order."""

    @classmethod
    def name(cls) -> str:
        return "reports"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_reports(findings: DataFrame, path: str, most: int = 500) -> None:
    """A report of every task of the findings as ``path``/task_id.html, as ``views.report_html`` makes it; none if any can't be made. A report that is there is replaced."""
    findings.sparkSession.dataSource.register(Reports)
    named = findings.withColumn("_o", severity_order("severity")).withColumn("place", location())
    counts = findings.groupBy("task_id").agg(F.count_if(F.col("review_status") == "rejected").alias("n_rejected"))
    kept = top(named.filter(F.coalesce("review_status", F.lit("")) != "rejected"), ["task_id"], [F.desc("_o"), F.col("seq")], most)
    rows = counts.join(kept.select("task_id", "rank", *REPORT_COLUMNS), "task_id", "left")
    dealt = rows.repartition("task_id").sortWithinPartitions("task_id", "rank")
    dealt.write.format("reports").mode("append").option("path", path).save()
