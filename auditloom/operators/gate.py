"""What becomes of findings on their way in: contradictions with the source, output policy, details to fill, submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import match_path
from ..functions.proofs import with_proof
from ..functions.severity import severity, severity_rank
from ..functions.text import any_in, fixed, text_or_empty
from .findings import merge_duplicates, normalize, root_cause
from .graph import checkpointed
from .rule_hits import top

#: How much of a source file is looked at.
SOURCE_CHARS = 60_000
#: What a finding claims and what it says of it; what the source then holds against it.
METHOD_SECURITY, MISSING = ("enablemethodsecurity", "方法级安全", "preauthorize"), ("未启用", "未开启", "未见", "缺少", "没有", "no ", "without", "missing")
CAPTCHA, REUSED = ("验证码",), ("未作废", "可重用", "重复使用", "reuse")
GUESSING = ("暴力破解", "失败尝试", "登录尝试", "rate limit", "lockout")
REASONS = {
    "method_security": "源码中已存在方法级安全启用注解，模型结论与直接代码证据冲突",
    "captcha_used": "验证码校验源码已在 validateCaptcha 中将 token 标记为已使用",
    "attempts_limited": "登录过滤器源码已调用 IP 登录失败次数限制",
}


def source_facts(files: DataFrame) -> DataFrame:
    """Per source file (project, path) what it holds that findings may contradict; files without any of it are left out."""
    low = F.lower(F.substring(text_or_empty("content"), 1, SOURCE_CHARS))
    made = fixed(files.select("project", match_path("path").alias("path"), "content"), _low=low)
    bare = fixed(made, _bare=F.regexp_replace("_low", r"\s+", ""))
    facts = bare.select(
        "project", "path", any_in("_low", ("@enablemethodsecurity", "@enableglobalmethodsecurity")).alias("method_security"),
        (F.contains("_low", F.lit("validatecaptcha")) & F.contains("_bare", F.lit("updateattempts(signature,-1)"))).alias("captcha_used"), F.contains("_bare", F.lit("iploginattemptservice.isexcessive")).alias("attempts_limited"),
    )
    return facts.filter("method_security OR captcha_used OR attempts_limited")


def contradictions(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings (project, seq, stage_num, ..) that their source contradicts, with the reason: project, seq, reason.

    A finding's file is found by its path, else by the end of a path. Only what the files
    hold of it moves, never their texts.
    """
    said = F.lower(F.concat_ws("\n", *[text_or_empty(c) for c in ("title", "vuln_type", "file_path", "endpoint", "code_snippet", "description", "poc_raw", "fix_suggestion")]))
    f = fixed(findings.filter(F.col("stage_num").isin(5, 6)).select("project", "seq", "stage_num", match_path("file_path").alias("path"), said.alias("said")), _said=F.col("said")).drop("said")
    claims = f.select(
        "project", "seq", "path", ((F.col("stage_num") == 6) & any_in("_said", METHOD_SECURITY) & any_in("_said", MISSING)).alias("c1"),
        ((F.col("stage_num") == 5) & any_in("_said", CAPTCHA) & any_in("_said", REUSED)).alias("c2"), ((F.col("stage_num") == 5) & any_in("_said", GUESSING)).alias("c3"),
    ).filter("path <> '' AND (c1 OR c2 OR c3)")
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("rank"), F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("path")))
    every = files.select("project", match_path("path").alias("path")).filter("path <> ''").select("project", F.explode(ends).alias("e"), F.col("path").alias("whole"))
    target = every.groupBy("project", F.col("e.path").alias("path")).agg(F.min(F.struct("e.rank", "whole"))["whole"].alias("whole"))
    found = claims.join(target, ["project", "path"]).join(source_facts(files).withColumnRenamed("path", "whole"), ["project", "whole"])
    reason = F.when(F.col("c1") & F.col("method_security"), REASONS["method_security"]).when(F.col("c2") & F.col("captcha_used"), REASONS["captcha_used"]).when(F.col("c3") & F.col("attempts_limited"), REASONS["attempts_limited"])
    return found.select("project", "seq", reason.alias("reason")).filter("reason IS NOT NULL")


def output_policy(findings: DataFrame, by: tuple[str, ...] = ("task_id", "stage_num")) -> tuple[DataFrame, DataFrame]:
    """Findings of responses, normalised, with accepted proofs told and one a root cause; and per response how many were merged and lack an accepted proof, with up to ten of their titles."""
    named = normalize(findings).withColumn("severity", severity("severity"))
    judged = with_proof(named).withColumn("poc_validation_status", F.when(F.col("proof_accepted"), "valid").otherwise("invalid"))
    merged = merge_duplicates(root_cause(judged.drop("proof_kind", "proof_accepted")), (*by, "dedupe_key"))
    bad = F.col("poc_validation_status") != "valid"
    # Both what is counted and what is named come from these few columns; the merge is worked out for them once.
    told = checkpointed(merged.select(*by, "first_seq", "title", "n_merged", "poc_validation_status"))
    few = top(told.filter(bad), list(by), [F.col("first_seq")], 10, "place").groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.when(text_or_empty("title") == "", "未命名漏洞").otherwise(F.col("title")).alias("title")))), lambda x: x["title"]).alias("invalid_poc_titles"))
    counts = told.groupBy(*by).agg(F.count(F.lit(1)).alias("n_findings"), F.count_if(bad).alias("invalid_poc_vulnerabilities"), (F.sum("n_merged") - F.count(F.lit(1))).alias("merged_duplicate_vulnerabilities"))
    return merged, counts.join(few, list(by), "left").withColumn("invalid_poc_titles", F.coalesce("invalid_poc_titles", F.array().cast("array<string>")))


#: How many findings of a stage are sent back for details.
DETAIL_MOST = {1: 0, 2: 2, 3: 2, 4: 2, 5: 2, 6: 3, 7: 1, 8: 2, 9: 2}


def with_detail_priority(findings: DataFrame) -> DataFrame:
    """Adds needs_detail (whether a finding lacks its snippet, description, fix or the proof that its kind needs, or was salvaged) and priority: severity first, then what it lacks, then that it says where it is."""
    judged = with_proof(findings)
    there = lambda c: F.trim(text_or_empty(c)) != ""
    salvaged, ok = F.coalesce("salvaged", F.lit(False)), F.col("proof_accepted")
    needs = ~there("code_snippet") | ~there("description") | ~there("fix_suggestion") | ((F.col("proof_kind") != "none") & (~there("poc_raw") | ~ok)) | salvaged
    points = ((salvaged, 40), (~there("poc_raw"), 30), (~there("code_snippet"), 20), (~there("fix_suggestion"), 10), (there("endpoint"), 8), (there("file_path"), 5), (~ok, 35))
    total = 100 * severity_rank("severity")
    for holds, n in points:
        total = total + F.when(holds, n).otherwise(0)
    return judged.withColumns({"needs_detail": needs, "priority": total}).drop("proof_kind", "proof_accepted")


def detail_candidates(findings: DataFrame, by: tuple[str, ...] = ("task_id", "stage_num")) -> DataFrame:
    """The findings of each stage to ask for details, by priority, as many as the stage allows: adds priority and place."""
    most = F.create_map(*[F.lit(x) for kv in DETAIL_MOST.items() for x in kv])
    asked = with_detail_priority(findings).filter("needs_detail").drop("needs_detail")
    ranked = top(asked, list(by), [F.desc("priority"), F.col("seq")], max(DETAIL_MOST.values()), "place")
    return ranked.filter(F.col("place") <= F.coalesce(most[F.col("stage_num")], F.lit(0)))


def stable_id(*parts: Column) -> Column:
    """24 hex digits of trimmed parts."""
    return F.substring(F.sha1(F.concat_ws("\u0000", *[F.trim(text_or_empty(p)) for p in parts]).cast("binary")), 1, 24)


def _first(df: DataFrame, *names: str) -> Column:
    """The first of these columns that isn't '' or null, trimmed; '' without one. Columns that don't exist are null."""
    there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.trim(F.coalesce(*there, F.lit("")))


def submitted_routes(rows: DataFrame) -> DataFrame:
    """Routes as they are submitted, under one set of names: id, method, path, source, file_path, handler, notes. Those without a path are left out."""
    source = _first(rows, "source", "source_file", "file_path", "file")
    method = F.upper(_first(rows, "method", "http_method"))
    named = rows.select(
        *[c for c in ("task_id", "seq") if c in rows.columns], _first(rows, "id", "route_id").alias("_id"), F.when(method == "", "UNKNOWN").otherwise(method).alias("method"), _first(rows, "path", "url", "endpoint").alias("path"),
        source.alias("source"), F.when(_first(rows, "file_path") != "", _first(rows, "file_path")).otherwise(source).alias("file_path"), _first(rows, "handler", "function").alias("handler"), _first(rows, "notes", "description").alias("notes"),
    ).filter("path <> ''")
    made = stable_id(F.col("method"), F.col("path"), F.col("source"), F.col("handler"))
    return named.withColumn("id", F.when(F.col("_id") != "", F.col("_id")).otherwise(made)).drop("_id")


def submitted_findings(rows: DataFrame) -> DataFrame:
    """Findings as they are submitted: id, title, vuln_type, file_path, endpoint, description. Those that say nothing are left out."""
    named = rows.select(
        *[c for c in ("task_id", "seq", "stage_num") if c in rows.columns], _first(rows, "id", "finding_id").alias("_id"), _first(rows, "title", "vuln_type", "description").alias("title"), _first(rows, "vuln_type", "type").alias("vuln_type"),
        _first(rows, "file_path", "file").alias("file_path"), _first(rows, "endpoint", "route").alias("endpoint"), _first(rows, "description").alias("description"),
    )
    said = named.filter(F.concat("title", "vuln_type", "file_path", "endpoint", "description") != "")
    made = stable_id(F.col("stage_num").cast("string"), F.col("title"), F.col("vuln_type"), F.col("file_path"), F.col("endpoint"), F.substring("description", 1, 240))
    return said.withColumn("id", F.when(F.col("_id") != "", F.col("_id")).otherwise(made)).drop("_id")


#: What a submitted review may say.
REVIEW_STATUSES = ("confirmed", "uncertain", "rejected")


def submitted_reviews(rows: DataFrame) -> DataFrame:
    """Reviews with a whole number as index and a known status: finding_index, finding_id, verification_status, reviewed_severity, verification_reason."""
    status = F.lower(_first(rows, "verification_status"))
    return rows.select(
        *[c for c in ("task_id", "seq") if c in rows.columns], F.col("finding_index").cast("string").try_cast("int").alias("finding_index"), _first(rows, "finding_id", "id").alias("finding_id"), status.alias("verification_status"),
        _first(rows, "reviewed_severity").alias("reviewed_severity"), _first(rows, "verification_reason").alias("verification_reason"),
    ).filter(F.col("finding_index").isNotNull() & F.col("verification_status").isin(*REVIEW_STATUSES))
