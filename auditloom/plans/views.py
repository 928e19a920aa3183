"""Read models over findings: lists, snapshots, reports and what is written of them."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import SEVERITIES, severity_names, severity_order
from ..functions.text import text_or_empty
from ..operators.rule_hits import top

#: Review statuses.
REVIEWS = ("unreviewed", "needs_review", "confirmed", "rejected")


def list_findings(findings: DataFrame, severity: str | None = None, review: str | None = None, limit: int | None = 50) -> DataFrame:
    """Findings of stages 2 to 9, the worst and latest first. Filters are names or lists with commas; a limit of 0 or None is none, others are up to 200."""
    out = findings.filter(F.col("stage_num").between(2, 9))
    if severity:
        out = out.filter(F.col("severity").isin([n for s in severity.split(",") for n in severity_names(s)]))
    if review:
        out = out.filter(F.col("review_status").isin([r.strip() for r in review.split(",")]))
    out = out.withColumn("_o", severity_order("severity")).orderBy(F.desc("_o"), F.desc("seq")).drop("_o")
    return out.limit(min(limit, 200)) if limit and limit > 0 else out


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """A page of up to 200 rows."""
    size = min(max(size, 1), 200)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def snapshot_counts(findings: DataFrame) -> DataFrame:
    """Per task, whatever filters a list has: counts by severity (blank: Unknown) and by review status, zeros included; other statuses count in the total alone."""
    blank = text_or_empty("severity") == ""
    return findings.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES], F.count_if(blank).alias("unknown"),
        *[F.count_if(F.coalesce("review_status", F.lit("unreviewed")) == r).alias(r) for r in REVIEWS],
    )


def snapshot_grains(findings: DataFrame) -> DataFrame:
    """Counts of each task by every grain of its views, in one pass: task_id, grain (total, severity, review, stage, severity_review), severity, review_status, stage_num, n. What a grain doesn't tell apart is null."""
    rows = findings.select("task_id", F.when(text_or_empty("severity") == "", "Unknown").otherwise(F.col("severity")).alias("severity"), F.coalesce("review_status", F.lit("unreviewed")).alias("review_status"), "stage_num")
    sets = [["task_id"], ["task_id", "severity"], ["task_id", "review_status"], ["task_id", "stage_num"], ["task_id", "severity", "review_status"]]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *rows.columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    # A bit of the id is set for each column that isn't told apart, the first column's being the highest.
    named = {0b111: "total", 0b011: "severity", 0b101: "review", 0b110: "stage", 0b001: "severity_review"}
    grain = F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col("_g").cast("int"))
    return out.select("task_id", grain.alias("grain"), "severity", "review_status", "stage_num", "n")


def location(path: Column | str = "file_path", start: Column | str = "line_start", end: Column | str = "line_end") -> Column:
    """path:L12-14, path:L12 or the path alone."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    span = F.when(a.isNull(), "").when(b.isNull() | (a == b), F.concat(F.lit(":L"), a.cast("string"))).otherwise(F.concat(F.lit(":L"), a.cast("string"), F.lit("-"), b.cast("string")))
    return F.concat(text_or_empty(path), span)


def report_groups(findings: DataFrame) -> DataFrame:
    """Kinds of findings that aren't rejected, by their worst: vuln_type, worst, n, n_valid_proofs. One row a kind."""
    kept = findings.filter(F.coalesce("review_status", F.lit("")) != "rejected")
    rank = 5 - severity_order("severity")
    proofs = F.count_if(F.lower(text_or_empty("poc_validation_status")) == "valid")
    return kept.groupBy("task_id", "vuln_type").agg(F.min(rank).alias("place"), F.count(F.lit(1)).alias("n"), proofs.alias("n_valid_proofs")).orderBy("task_id", "place", "vuln_type")


#: What a report shows of a finding.
REPORT_COLUMNS = ("severity", "vuln_type", "title", "place")


def report_page(task_id: int, rows: list[tuple], rejected: int) -> str:
    """The report of a task from its rows (REPORT_COLUMNS) and how many findings were left out as rejected."""
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v or ''))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<html><body><h1>Task {task_id}</h1><p>{len(rows)} findings, {rejected} rejected ones left out</p><table>{body}</table></body></html>"


def report_html(findings: DataFrame, task_id: int, most: int = 500) -> str:
    """A report of one task as HTML: how many findings were left out as rejected, and the worst ``most`` of the rest. Only these rows are collected; ``sources.report_sink`` writes those of all tasks."""
    own = findings.filter(F.col("task_id") == task_id)
    rejected = own.filter(F.col("review_status") == "rejected").count()
    kept = own.filter(F.coalesce("review_status", F.lit("")) != "rejected").withColumn("_o", severity_order("severity")).withColumn("place", location())
    rows = top(kept, ["task_id"], [F.desc("_o"), F.col("seq")], most).orderBy("rank").select(*REPORT_COLUMNS).collect()
    return report_page(task_id, [tuple(r) for r in rows], rejected)


def write_artifacts(rows: DataFrame, by: str, path: str) -> None:
    """Rows as JSON texts, in a directory for each value of ``by``."""
    rows.select(by, F.to_json(F.struct(*[c for c in rows.columns if c != by])).alias("value")).write.mode("overwrite").partitionBy(by).text(path)
