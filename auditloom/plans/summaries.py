"""Read models of tasks, stages and routes: what lists, headers and notices show, and which actions are open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import is_valid
from ..functions.severity import SEVERITIES, severity_order
from ..functions.text import text_or_empty
from ..operators.rule_hits import top
from ..operators.planning import recommendations

#: What reviews and findings may be set to.
REVIEW_STATUSES, LIFECYCLE = ("unreviewed", "needs_review", "confirmed", "rejected"), ("open", "accepted_risk", "fixed")
#: Statuses from which a task may be cancelled, retried, paused and resumed; those of a stage that a retry may take.
ACTIONS = {"cancel": ("pending", "running", "paused"), "retry": ("completed", "failed", "cancelled"), "pause": ("running",), "resume": ("paused",)}
RETRIED = ("failed", "completed", "cancelled")


# Counts and lists


def stage_counts(findings: DataFrame) -> DataFrame:
    """Findings of every stage of a task."""
    return findings.groupBy("task_id", "stage_num").agg(F.count(F.lit(1)).alias("n"))


def totals(**tables: DataFrame) -> DataFrame:
    """One row of counts, a column a table. Each is counted by itself; only the counts meet."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name, df in tables.items()]
    both = counts[0]
    for c in counts[1:]:
        both = both.unionByName(c)
    return both.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def latest(rows: DataFrame, by: str, owners: DataFrame, id_: str = "id") -> DataFrame:
    """Owners (by, ..) with how many rows they have and the latest id, 0 without any."""
    per = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.max(id_).alias("latest"))
    return owners.join(per, by, "left").na.fill(0, ["n_rows", "latest"])


def type_groups(findings: DataFrame) -> DataFrame:
    """Kinds of findings with their worst and number, the worst kind first: adds place. One row a kind is ranked."""
    g = findings.groupBy("vuln_type").agg(F.max(severity_order("severity")).cast("long").alias("worst"), F.count(F.lit(1)).alias("n"))
    return top(g.withColumn("_all", F.lit(1)), ["_all"], [F.desc("worst"), F.col("vuln_type")], 1 << 30, "place").drop("_all")


def orphans(rows: DataFrame, owners: DataFrame, by: str) -> DataFrame:
    """Rows whose owner is gone."""
    return rows.join(owners.select(by).distinct(), by, "left_anti")


def without_orphans(rows: DataFrame, owners: DataFrame, by: str) -> DataFrame:
    """Rows whose owner is there: what a cascading delete leaves."""
    return rows.join(owners.select(by).distinct(), by, "left_semi")


# Stages


def stage_quality(stages: DataFrame) -> DataFrame:
    """Of rows (stage_num, candidates, formal): adds filtered, how many candidates became no formal finding, 0 at least; the first stage has neither."""
    first = F.col("stage_num") == 1
    candidates, formal = F.when(first, 0).otherwise(F.coalesce("candidates", F.lit(0))), F.when(first, 0).otherwise(F.greatest(F.coalesce("formal", F.lit(0)), F.lit(0)))
    out = stages.withColumns({"candidates": candidates, "formal": formal})
    return out.withColumn("filtered", F.greatest(F.col("candidates") - F.col("formal"), F.lit(0)))


#: What notices say.
NOTES = {
    "filtered": "部分候选因缺少标题/类型/入口证据、缺少 file_path 与 endpoint，或与已有漏洞同根因去重，未进入正式漏洞列表。", "filtered_other": "部分候选未进入正式漏洞列表",
    "salvaged": "阶段输出由截断响应中自动恢复，请人工复核", "skipped": "阶段已跳过",
}


def quality_notices(stages: DataFrame) -> DataFrame:
    """Of rows (task_id, stage_num, filtered, salvaged, parse_error, skipped, skip_reason): a row a notice, kind being filtered, salvaged, parse_error or skipped, with count and message."""
    none = F.lit(None).cast("long")
    one = lambda kind, count, message: F.struct(F.lit(kind).alias("kind"), count.cast("long").alias("count"), message.alias("message"))
    note = F.when(F.col("stage_num").between(2, 9), NOTES["filtered"]).otherwise(NOTES["filtered_other"])
    why = F.when(text_or_empty("skip_reason") == "", NOTES["skipped"]).otherwise(F.col("skip_reason"))
    kinds = F.array(
        F.when(F.col("filtered") > 0, one("filtered", F.col("filtered"), note)), F.when(F.coalesce("salvaged", F.lit(False)), one("salvaged", none, F.lit(NOTES["salvaged"]))),
        F.when(text_or_empty("parse_error") != "", one("parse_error", none, F.substring("parse_error", 1, 240))), F.when(F.coalesce("skipped", F.lit(False)), one("skipped", none, F.substring(why, 1, 240))),
    )
    return stages.select("task_id", "stage_num", F.inline(F.array_compact(kinds)))


def phase_progress(stages: DataFrame) -> DataFrame:
    """Per task of its stages 2 to 9: planned, completed, skipped, executable (planned and not skipped) and a colour: running before failed before completed."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    out = stages.filter(F.col("stage_num").between(2, 9)).groupBy("task_id").agg(F.count(F.lit(1)).alias("planned"), is_("completed").alias("completed"), is_("skipped").alias("skipped"), is_("running").alias("_r"), is_("failed").alias("_f"))
    colour = F.when(F.col("_r") > 0, "running").when(F.col("_f") > 0, "failed").when(F.col("completed") > 0, "completed").otherwise("pending")
    return out.withColumn("executable", F.greatest(F.col("planned") - F.col("skipped"), F.lit(0))).withColumn("colour", colour).drop("_r", "_f")


def current_stage(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """Per task (task_id, status, phase, total_stages) the stage it shows: the last if it is completed; by phase the first, the plan (-1) and the review (-2); else the first running stage, the first pending one, the last."""
    n, of = F.col("stage_num"), lambda s: F.col("status") == s
    at = stages.filter(n.between(2, 9)).groupBy("task_id").agg(F.min(F.when(of("running"), n)).alias("_running"), F.min(F.when(of("pending"), n)).alias("_pending"), F.max(n).alias("_last"))
    total, phase = F.coalesce("total_stages", F.lit(9)), F.coalesce("phase", F.lit(1))
    shown = F.when(of("completed"), total).when(phase <= 1, 1).when(phase == 2, -1).when(phase >= 4, -2).otherwise(F.coalesce("_running", "_pending", "_last", F.least(total, F.lit(2))))
    return tasks.join(at, "task_id", "left").withColumn("shown_stage", shown).drop("_running", "_pending", "_last")


def coverage_percent(ratio: Column) -> Column:
    """A ratio as whole per cent, 0 to 100; null is 0."""
    return F.least(F.greatest(F.round(F.coalesce(ratio, F.lit(0.0)) * 100), F.lit(0.0)), F.lit(100.0)).cast("int")


def notice_class(status: Column, next_action: Column, unresolved: Column) -> Column:
    """How a review's outcome is shown: info without one, danger, warning or success."""
    s, a = text_or_empty(status), text_or_empty(next_action)
    danger = s.contains("failed") | (a == "manual_review") | (F.coalesce(unresolved, F.lit(0)) > 0)
    warning = a.isin("rerun", "monitor") | s.contains("notes") | s.contains("recommended")
    return F.when(status.isNull() & next_action.isNull(), "info").when(danger, "danger").when(warning, "warning").otherwise("success")


def first_stage_coverage(rows: DataFrame) -> DataFrame:
    """Of rows (scanned_chunk_count, audit_scope_chunk_count, total_chunk_count, route_count, n_routes): adds total_chunks (the scope, else all), ratio (by 1 at least, four places) and routes (what is said, else counted)."""
    some = lambda c: F.nullif(F.coalesce(c, F.lit(0)), F.lit(0))
    total = F.coalesce(some("audit_scope_chunk_count"), some("total_chunk_count"), F.lit(0))
    ratio = F.round(F.coalesce("scanned_chunk_count", F.lit(0)) / F.greatest(total, F.lit(1)), 4)
    return rows.withColumns({"total_chunks": total, "ratio": ratio, "routes": F.coalesce("route_count", "n_routes", F.lit(0))})


#: Scan counters and flags, all 0 or false where a scan says nothing.
SCAN_COUNTS = (
    "source_files_detected", "source_files_indexed", "oversized_files_skipped", "oversized_files_compacted", "files_selected_for_audit", "files_skipped_by_audit_file_budget",
    "files_considered_for_chunks", "files_with_content", "chunk_count", "rule_hit_count", "route_count", "route_source_files",
)
SCAN_FLAGS = ("truncated_by_audit_file_count", "truncated_by_code_chunks", "truncated_by_total_chars", "partial_audit")


def scan_stats(scans: DataFrame) -> DataFrame:
    """Scans with all counters and flags: indexed files fall back to detected ones, selected to considered, routes and hits to fallback columns; partial if a flag says so or files were compacted."""
    has = set(scans.columns)
    n = {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in has else F.lit(0).cast("long") for c in SCAN_COUNTS}
    flag = {c: F.coalesce(F.col(c), F.lit(False)) if c in has else F.lit(False) for c in SCAN_FLAGS}
    back = {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in has else F.lit(0) for c in ("route_count_fallback", "rule_hit_fallback")}
    or_ = lambda a, b: F.when(a == 0, b).otherwise(a)
    n |= {
        "source_files_indexed": or_(n["source_files_indexed"], n["source_files_detected"]), "files_selected_for_audit": or_(n["files_selected_for_audit"], n["files_considered_for_chunks"]),
        "route_count": or_(n["route_count"], back["route_count_fallback"]), "rule_hit_count": or_(n["rule_hit_count"], back["rule_hit_fallback"]),
    }
    flag["partial_audit"] = flag["partial_audit"] | flag["truncated_by_audit_file_count"] | flag["truncated_by_code_chunks"] | flag["truncated_by_total_chars"] | (n["oversized_files_compacted"] > 0)
    return scans.select(*[c for c in scans.columns if c not in (*n, *flag, *back)], *[v.alias(k) for k, v in {**n, **flag}.items()])


def task_summary(findings: DataFrame, first: DataFrame, scans: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per task what its header says: findings of stages 2 to 9 in all and by severity, coverage of the first stage, advice, and the route coverage (task_id, coverage_ratio)."""
    formal = findings.filter(F.col("stage_num").between(2, 9)).groupBy("task_id").agg(F.count(F.lit(1)).alias("n_findings"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    scanned = scan_stats(scans).withColumn("truncated", F.col("truncated_by_audit_file_count") | F.col("truncated_by_code_chunks") | F.col("truncated_by_total_chars"))
    both = scanned.select("task_id", "rule_hit_count", "oversized_files_compacted", "truncated", "partial_audit").join(formal, "task_id", "left").na.fill(0)
    stage1 = first_stage_coverage(first).select("task_id", F.col("ratio").alias("stage1_ratio"))
    out = recommendations(both).join(stage1, "task_id", "left").join(coverage.select("task_id", "coverage_ratio"), "task_id", "left")
    return out.withColumn("coverage_percent", coverage_percent(F.col("coverage_ratio")))


# Actions


def open_actions(tasks: DataFrame) -> DataFrame:
    """Tasks with what may be done with them: can_cancel, can_retry, can_pause, can_resume."""
    return tasks.withColumns({f"can_{k}": F.coalesce(F.col("status").isin(*v), F.lit(False)) for k, v in ACTIONS.items()})


def retry_stages(stages: DataFrame, requested: DataFrame) -> DataFrame:
    """Per task the stages that a retry takes and those asked for that it can't: of its failed, completed and cancelled stages those requested (task_id, stage_num), all without a request. It is valid if nothing asked for is left over and something is taken."""
    can = stages.filter(F.col("status").isin(*RETRIED)).groupBy("task_id").agg(F.array_sort(F.collect_set("stage_num")).alias("_can"))
    asked = requested.groupBy("task_id").agg(F.array_sort(F.collect_set("stage_num")).alias("_asked"))
    none = F.array().cast("array<int>")
    both = stages.select("task_id").distinct().join(can, "task_id", "left").join(asked, "task_id", "left").withColumns({"_can": F.coalesce("_can", none), "_asked": F.coalesce("_asked", none)})
    taken = F.when(F.size("_asked") == 0, F.col("_can")).otherwise(F.array_intersect("_can", "_asked"))
    out = both.withColumns({"rerun": taken, "invalid": F.array_except("_asked", "_can")})
    return out.withColumn("valid", (F.size("invalid") == 0) & (F.size("rerun") > 0)).drop("_can", "_asked")


def resume_stages(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """Per paused task the stages 2 to 9 that aren't completed, and its next status: pending, or completed if there are none."""
    left = stages.filter(F.col("stage_num").between(2, 9) & (F.col("status") != "completed")).groupBy("task_id").agg(F.array_sort(F.collect_set("stage_num")).alias("remaining"))
    out = tasks.filter("status = 'paused'").select("task_id").join(left, "task_id", "left").withColumn("remaining", F.coalesce("remaining", F.array().cast("array<int>")))
    return out.withColumn("next_status", F.when(F.size("remaining") == 0, "completed").otherwise("pending"))


def apply_reviews(findings: DataFrame, updates: DataFrame, reviewer: str, now) -> DataFrame:
    """Findings (id, review_status, status, review_note, reviewer, reviewed_at) after updates (id, seq, ..), the last a finding; values that are null leave what is there, statuses that don't exist leave the whole update out."""
    ok = (F.col("review_status").isNull() | is_valid("review_status", REVIEW_STATUSES)) & (F.col("status").isNull() | is_valid("status", LIFECYCLE))
    said = F.col("review_status").isNotNull() | F.col("status").isNotNull() | F.col("review_note").isNotNull()
    last = updates.filter(ok & said).groupBy("id").agg(F.max(F.struct("seq", "review_status", "status", "review_note")).alias("_u"))
    out = findings.join(last, "id", "left")
    new = {c: F.coalesce(f"_u.{c}", c) for c in ("review_status", "status", "review_note")}
    new |= {"reviewer": F.when(F.col("_u").isNotNull(), reviewer).otherwise(F.col("reviewer")), "reviewed_at": F.when(F.col("_u").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("reviewed_at"))}
    return out.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in findings.columns])


def without_keys(summary: Column, keys: tuple[str, ...]) -> Column:
    """A map without these keys."""
    return F.map_filter(summary, lambda k, _: ~k.isin(*keys))


# Model calls


def error_kind(status_code: Column, message: Column) -> Column:
    """What went wrong in a call: by its HTTP status, else by its message; a network fault if neither tells."""
    m = F.lower(text_or_empty(message))
    holds = lambda *words: F.lit(False) if not words else m.rlike("|".join(words))
    by_text = (
        F.when(holds("timeout", "timed out", "超时"), "timeout").when(holds("blocked"), "blocked").when(holds("unauthorized", "invalid api key", "authentication", "认证失败"), "auth")
        .when(holds("not found") & holds("model"), "model").otherwise("network")
    )
    by_code = F.when(status_code == 429, "rate_limit").when(status_code >= 500, "server_error").when(status_code.isin(401, 403), "auth").when(status_code == 404, "model").otherwise("client_error")
    return F.when(status_code.isNotNull(), by_code).otherwise(by_text)


def retry_delay(attempt: Column, base: float = 1.0, most: float = 10.0) -> Column:
    """Seconds before the next call, in proportion to the failed attempts, within bounds."""
    return F.least(F.greatest(attempt, F.lit(1)) * F.lit(base), F.lit(most))


# Lists that a client shows


def distinct_hints(hints: DataFrame, by: list[str]) -> DataFrame:
    """Hints (by, seq, ..) once each by title, kind, file, endpoint and the first 120 characters of the description, the first of equals; those that say nothing are left out."""
    title, about = F.trim(text_or_empty("title")), F.trim(text_or_empty("description"))
    named = hints.withColumns({"title": F.when(title == "", F.substring(about, 1, 80)).otherwise(title), "description": about, "vuln_type": F.when(F.trim(text_or_empty("vuln_type")) == "", "risk_hint").otherwise(F.trim("vuln_type"))}).filter("title <> ''")
    key = [F.col("title").alias("_t"), F.col("vuln_type").alias("_v"), text_or_empty("file_path").alias("_f"), text_or_empty("endpoint").alias("_e"), F.substring("description", 1, 120).alias("_d")]
    rest = [c for c in named.columns if c not in by and c != "seq"]
    return named.groupBy(*by, *key).agg(F.min(F.struct("seq", *rest)).alias("_h")).select(*by, "_h.*")


def filter_routes(routes: DataFrame, keyword: str = "", auth: str = "") -> DataFrame:
    """Routes of which the verb, path, handler, file or a parameter holds the keyword, whatever its case, and whose auth is this; '' is no filter."""
    word = F.lit(keyword.strip().lower())
    some = F.exists(F.array(*[F.lower(text_or_empty(c)) for c in ("method", "path", "handler", "file_path")]), lambda x: F.contains(x, word)) | F.exists(F.coalesce("params", F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), word))
    out = routes.filter(some) if keyword.strip() else routes
    return out.filter(F.col("auth") == auth) if auth else out


#: Names of review statuses and of a finding's life.
REVIEW_LABELS = {"zh": {"unreviewed": "待复核", "confirmed": "已确认", "rejected": "误报", "needs_review": "需复核"}, "en": {"unreviewed": "Unreviewed", "confirmed": "Confirmed", "rejected": "False Positive", "needs_review": "Needs Review"}}
LIFE_LABELS = {"zh": {"open": "待处理", "accepted_risk": "接受风险", "fixed": "已修复"}, "en": {"open": "Open", "accepted_risk": "Accepted Risk", "fixed": "Fixed"}}


def label(status: Column | str, labels: dict[str, dict[str, str]], locale: str = "zh") -> Column:
    """A status in words; itself if it has none, that of the first status if it is missing."""
    table = labels["en" if locale == "en" else "zh"]
    s = text_or_empty(status)
    named = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[s]
    return F.when(s == "", next(iter(table.values()))).otherwise(F.coalesce(named, s))
