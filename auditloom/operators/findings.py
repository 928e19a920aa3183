"""Findings: normalisation, root-cause identity, merging, gates and carried-over reviews.

Findings are rows (task_id, seq, stage_num, title, severity, vuln_type, file_path, line_start,
line_end, code_snippet, endpoint, poc_raw, poc_validation_status, description,
fix_suggestion, confidence, salvaged); ``seq`` is their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.localize import localize
from ..functions.paths import code_text, endpoint_anchor, file_anchor, keyword_text, match_path, short_hash
from ..functions.severity import confidence_rank, severity, severity_rank
from ..functions.text import contains_any, ends_with_any, first_real, fixed, is_ascii, is_placeholder, text_or_empty

#: Families and the markers that tell them, in order of precedence.
FAMILIES = (
    ("sql_injection", ("sql 注入", "sql注入", "sqli", "sql injection")), ("nosql_injection", ("nosql", "mongo injection", "nosql injection")),
    ("command_execution", ("rce", "命令执行", "command execution", "remote code execution")), ("command_injection", ("命令注入", "command injection")),
    ("xss", ("xss", "跨站脚本")), ("ssrf", ("ssrf", "服务端请求伪造")), ("file_upload", ("文件上传", "upload")), ("file_download", ("文件下载", "download")),
    ("path_traversal", ("路径穿越", "目录遍历", "path traversal", "directory traversal")), ("arbitrary_file_access", ("任意文件", "file read", "file write")),
    ("deserialization", ("反序列化", "deserialize")), ("template_injection", ("模板注入", "ssti", "template injection")), ("session_fixation", ("会话固定", "session fixation")),
    ("brute_force", ("暴力破解", "brute force")), ("weak_password_hash", ("弱密码哈希", "无盐 md5", "无盐md5", "weak md5", "weak sha1", "密码哈希")),
    ("hardcoded_secret", ("硬编码", "hardcoded", "secret key", "api key", "access key", "private key")),
    ("config_leak", ("配置泄露", "信息泄露", ".env", "目录索引", "directory listing", "stack trace")), ("authorization_bypass", ("越权", "idor", "权限绕过", "水平越权", "垂直越权")),
    ("business_logic_bypass", ("业务逻辑", "支付绕过", "下载绕过", "流程绕过", "logic bypass")), ("race_condition", ("竞态", "race")),
)
TEXT_FIELDS = ("title", "vuln_type", "file_path", "code_snippet", "endpoint", "poc_raw", "description", "fix_suggestion")
_LINE_RANGE = r"^\s*[Ll]?\s*(\d+)\s*(?:[-~–—]\s*[Ll]?\s*(\d+))?\s*$"


def line_bound(value: Column, group: int = 1) -> Column:
    """A positive line number of 12, L12, 12-34 and the like; null for anything else."""
    if value is None:
        return F.lit(None).cast("int")
    # A zero before it, since to read '' as a number raises an error inside, which takes long; no number is 0, as no line is.
    n = F.concat(F.lit("0"), F.regexp_extract(value.cast("string"), _LINE_RANGE, group)).try_cast("int")
    return F.when(n > 0, n)


def line_bounds(start: Column, end: Column, *candidates: Column) -> tuple[Column, Column]:
    """First and last line from two fields, else from ranges in further ones; in order, and the last alone is both."""
    return _in_order(*_told_lines(start, end, *candidates))


def _told_lines(start: Column, end: Column, *candidates: Column, numbers: bool = False) -> tuple[Column, Column]:
    """``numbers``: start and end are integers, which are no ranges."""
    if numbers:
        first, last = [F.when(c > 0, c) for c in (start, end)]
        return F.coalesce(first, last, *map(line_bound, candidates)), F.coalesce(last, *[F.when(line_bound(c).isNotNull(), line_bound(c, 2)) for c in candidates])
    every = [start, end, *candidates]
    lo = F.coalesce(line_bound(start), *[line_bound(c) for c in every])
    return lo, F.coalesce(line_bound(end), *[F.when(line_bound(c).isNotNull(), line_bound(c, 2)) for c in every])


def _in_order(lo: Column, hi: Column) -> tuple[Column, Column]:
    lo = F.coalesce(lo, hi)
    return F.when(hi < lo, hi).otherwise(lo), F.when(hi < lo, lo).otherwise(hi)


def normalize(findings: DataFrame) -> DataFrame:
    """Fields filled from their other names (name, type, location, remediation, line, line_range, impact, evidence, auth_required), where these columns exist; title and type in Chinese where they have a usual name."""
    has = set(findings.columns)
    col = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    # One step a field: what is generated for several at once is too long to be compiled, and then slow.
    made = fixed(findings, _type=first_real(*map(col, ("vuln_type", "type", "title", "name"))), _place=first_real(col("location")))
    made = fixed(made, _title=first_real(col("title"), col("name"), F.col("_type")))
    made = fixed(fixed(made, _title_zh=localize(F.col("_title"))), _type_zh=localize(F.col("_type")))
    place = F.col("_place")
    named = F.replace(F.regexp_extract(place, r"([A-Za-z]:[\\/][^,#\s]+|[A-Za-z0-9_./\\-]+\.[A-Za-z0-9_]+)", 1), F.lit("\\"), F.lit("/"))
    hint = F.regexp_extract(place, r"#\s*[Ll](\d+)", 1), F.regexp_extract(place, r"#\s*[Ll]\d+\s*[-~–—]\s*[Ll]?(\d+)", 1)
    hint = F.when(hint[0] != "", F.concat(hint[0], F.when(hint[1] != "", F.concat(F.lit("-"), hint[1])).otherwise("")))
    made = fixed(made, _hint=hint)
    lo, hi = _told_lines(col("line_start"), col("line_end"), col("line"), col("line_range"), col("source_line"), F.col("_hint"), numbers=all(c in has and findings.schema[c].dataType.typeName() == "integer" for c in ("line_start", "line_end")))
    made = fixed(fixed(made, _lo=lo), _hi=hi)
    lo, hi = _in_order(F.col("_lo"), F.col("_hi"))
    auth = F.when(first_real(col("auth_required")) != "", F.concat(F.lit("认证要求："), first_real(col("auth_required"))))
    told = F.concat_ws("\n\n", F.nullif(first_real(col("impact")), F.lit("")), F.nullif(first_real(col("evidence")), F.lit("")), auth)
    made = fixed(made, _about=first_real(col("description")))
    made = fixed(made, _path=first_real(col("file_path"), named))
    made = fixed(made, _fix=first_real(col("fix_suggestion"), col("remediation")))
    return made.withColumns({
        "title": F.col("_title_zh"), "vuln_type": F.col("_type_zh"), "file_path": F.col("_path"), "fix_suggestion": F.col("_fix"),
        "description": F.when(F.col("_about") != "", F.col("_about")).otherwise(told), "line_start": lo, "line_end": hi,
    }).drop("_type", "_place", "_title", "_title_zh", "_type_zh", "_hint", "_lo", "_hi", "_about", "_path", "_fix")


#: Families of injections that Chinese texts name by one word, and their markers.
INJECTION, INJECTIONS = "注入", (
    ("sql_injection", ("sql", "select ", "update ", "insert ", "delete from", "where ")), ("nosql_injection", ("mongo", "bson", "nosql")), ("command_injection", ("exec", "shell", "command", "system(")),
)


def family(df: DataFrame, hay: str, base: str, plain: str) -> DataFrame:
    """Adds family: what kind of flaw it is, by the first markers that its texts (the fixed column ``hay``) hold; else ``base``, its type's words.

    The markers are few and texts short, so they are looked for one by one; a third of them
    in a step, which can be compiled. ``plain``: whether the texts are ASCII.
    """
    named = [(name, ~F.col(plain) & F.contains(hay, F.lit(INJECTION)) & contains_any(hay, markers)) for name, markers in INJECTIONS] + [(name, contains_any(hay, markers, plain)) for name, markers in FAMILIES]
    told = None
    for i in range(0, len(named), 8):
        here = F.coalesce(*([F.col(told)] if told else []), *[F.when(hit, name) for name, hit in named[i : i + 8]])
        df, told = fixed(df, **{f"_family{i}": here}), f"_family{i}"
    return df.withColumn("family", F.coalesce(told, F.when(F.col(base) == "", "generic_vulnerability").otherwise(F.col(base)))).drop(*[f"_family{i}" for i in range(0, len(named), 8)])


def root_cause(df: DataFrame) -> DataFrame:
    """Adds family, file_anchor, location_anchor and dedupe_key (32 hex digits). What several expressions use is worked out once."""
    texts = [text_or_empty(c) for c in ("title", "vuln_type", "description", "code_snippet")]
    rest = F.when(text_or_empty("code_snippet") != "", F.col("code_snippet")).otherwise(text_or_empty("description"))
    named = F.when(text_or_empty("vuln_type") != "", F.col("vuln_type")).otherwise(text_or_empty("title"))
    end = F.coalesce("line_end", "line_start").cast("string")
    line = F.concat(F.lit("line:"), F.col("line_start").cast("string"), F.lit("-"), end)
    made = fixed(df, _hay=F.lower(F.concat_ws(" ", *texts)), _base=F.substring(keyword_text(named), 1, 80))
    made = fixed(made, _file=file_anchor("file_path"), _at=line, _plain=is_ascii("_hay"))
    made = family(made, "_hay", "_base", "_plain").drop("_plain")
    # The next best anchor is worked out only where the ones before it are missing.
    made = fixed(made, _code=F.when(F.col("_at").isNull(), code_text("code_snippet")))
    at = F.coalesce("_at", F.when(F.col("_code") != "", F.concat(F.lit("code:"), short_hash("_code"))))
    made = fixed(made, _told=at)
    made = fixed(made, _end=F.when(F.col("_told").isNull(), endpoint_anchor("endpoint")))
    made = fixed(made, _rest=F.when(F.col("_end") == "", code_text(rest)))
    at = F.coalesce("_told", F.when(F.col("_end") != "", F.col("_end")), F.when(F.col("_rest") != "", short_hash("_rest")), F.lit("global"))
    out = fixed(made, location_anchor=at).withColumnRenamed("_file", "file_anchor").drop("_hay", "_base", "_at", "_code", "_told", "_end", "_rest")
    return out.withColumn("dedupe_key", F.substring(F.sha2(F.concat_ws("|", "family", "file_anchor", "location_anchor").cast("binary"), 256), 1, 32))


def merge_score(f: Column | None = None) -> Column:
    """How much a finding tells: severity first, then confidence, a valid proof, and what is filled in."""
    get = (lambda c: f[c]) if f is not None else F.col
    filled = lambda c, n: F.when(F.trim(text_or_empty(get(c))) != "", n).otherwise(0)
    return (
        100 * severity_rank(get("severity")) + 20 * confidence_rank(get("confidence")) + F.when(F.lower(F.trim(text_or_empty(get("poc_validation_status")))) == "valid", 20).otherwise(0)
        + filled("code_snippet", 12) + filled("poc_raw", 10) + filled("endpoint", 6) + F.least(F.lit(12), F.floor(F.length(F.trim(text_or_empty(get("description")))) / 80).cast("int"))
    )


def merge_duplicates(findings: DataFrame, key: tuple[str, ...] = ("task_id", "dedupe_key"), ties: tuple[str, ...] = ()) -> DataFrame:
    """One finding a key: the one that tells most (the earlier of equals, by ``seq``, then ``ties``), with the highest severity and confidence, a valid proof if any, gaps filled from the others in the order of what they tell, and up to three further endpoints noted in the description.

    Adds n_merged and first_seq. All but the noted endpoints come from partial aggregates,
    so a key with very many duplicates never gathers in one row.
    """
    rows = fixed(findings, _score=merge_score())
    better = lambda c: F.struct((-F.col("_score")).alias("s"), F.col("seq").alias("q"), *ties, c.alias("v"))
    filled = {c: F.min(F.when(F.trim(text_or_empty(c)) != "", better(F.trim(F.col(c)))))["v"] for c in TEXT_FIELDS if c in findings.columns}
    ends = F.collect_set(F.when(F.trim(text_or_empty("endpoint")) != "", F.trim("endpoint")))
    proof = F.lower(F.trim(text_or_empty("poc_validation_status")))
    out = rows.groupBy(*key).agg(
        F.max(severity_rank(F.col("severity"))).alias("_rank"), F.min(better(F.col("severity")))["v"].alias("_own"), F.min(F.struct((-confidence_rank(F.col("confidence"))).alias("r"), F.struct((-F.col("_score")).alias("s"), "seq", *ties).alias("o"), F.col("confidence").alias("v")))["v"].alias("confidence"),
        F.when(F.max((proof == "valid").cast("int")) == 1, "valid").otherwise(F.min(F.when(proof != "", better(F.col("poc_validation_status"))))["v"]).alias("poc_validation_status"),
        *[v.alias(k) for k, v in filled.items()], F.min(F.when(F.col("line_start").isNotNull(), better(F.col("line_start"))))["v"].alias("line_start"), F.min(F.when(F.col("line_end").isNotNull(), better(F.col("line_end"))))["v"].alias("line_end"),
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n_merged"), F.array_sort(ends).alias("_ends"), *([] if "stage_num" in key else [F.min(better(F.col("stage_num")))["v"].alias("stage_num")]),
    )
    names = F.create_map(*[F.lit(x) for i, s in enumerate(("Info", "Low", "Medium", "High", "Critical")) for x in (i + 1, s)])
    more = F.slice(F.array_except("_ends", F.array("endpoint")), 1, 3)
    note = F.concat(F.lit("等价入口："), F.array_join(more, "；"))
    described = F.when(F.size(more) == 0, F.col("description")).when(text_or_empty("description") == "", note).otherwise(F.concat("description", F.lit("\n\n"), note))
    return out.withColumn("severity", F.when(F.col("_rank") > 0, names[F.col("_rank")]).otherwise(severity(F.col("_own")))).withColumn("description", described).drop("_rank", "_own", "_ends")


def is_frontend(path: Column | str) -> Column:
    p = match_path(path)
    return (p != "") & (contains_any(F.concat(F.lit("/"), p), ("/src/api/", "/src/views/", "/src/components/")) | ends_with_any(p, (".vue", ".tsx", ".jsx")) | p.contains("ui-console/") | p.rlike("^(frontend/|src/views/|src/api/|src/components/)"))


def rejection_reason() -> Column:
    """Why a finding is no formal one; null if it is."""
    nowhere = (F.trim(text_or_empty("file_path")) == "") & (F.trim(text_or_empty("endpoint")) == "")
    return (
        F.when(F.coalesce("salvaged", F.lit(False)), "salvaged").when(is_placeholder("title"), "no_title").when(is_placeholder("vuln_type"), "no_type").when(nowhere, "no_location")
        .when(F.col("stage_num").isin(5, 6) & is_frontend("file_path"), "frontend_only")
    )


def upsert(existing: DataFrame, incoming: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Existing and incoming findings of stages 2 to 9, one a root cause; the existing come first, then ``seq`` counts, then ``ties``."""
    both = existing.withColumn("seq", F.struct(F.lit(0).alias("t"), F.col("seq").alias("n"))).unionByName(incoming.withColumn("seq", F.struct(F.lit(1).alias("t"), F.col("seq").alias("n"))), allowMissingColumns=True)
    return merge_duplicates(root_cause(both.filter(F.col("stage_num").between(2, 9))), ties=ties)


def carry_reviews(new: DataFrame, before: DataFrame, defaults: tuple[str, str] = ("unreviewed", "open")) -> DataFrame:
    """Review columns of equal dedupe_key taken over from before, where they are no defaults; a note alone doesn't count. Critical and High findings left unreviewed then need a review."""
    columns = ["review_status", "status", "review_note", "reviewed_at", "reviewer", "cwe"]
    set_ = before.filter((F.coalesce("review_status", F.lit(defaults[0])) != defaults[0]) | (F.coalesce("status", F.lit(defaults[1])) != defaults[1]) | F.col("reviewed_at").isNotNull() | (text_or_empty("reviewer") != "") | (text_or_empty("cwe") != ""))
    last = set_.groupBy("dedupe_key").agg(F.max(F.struct("seq", *columns)).alias("_b"))
    out = new.drop(*columns).join(last, "dedupe_key", "left").select(new["*"] if not set(columns) & set(new.columns) else [F.col(c) for c in new.columns if c not in columns], *[F.col(f"_b.{c}").alias(c) for c in columns])
    out = out.withColumn("review_status", F.coalesce("review_status", F.lit(defaults[0]))).withColumn("status", F.coalesce("status", F.lit(defaults[1])))
    return out.withColumn("review_status", F.when(F.col("severity").isin("Critical", "High") & (F.col("review_status") == defaults[0]), "needs_review").otherwise(F.col("review_status")))


def attach_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews (finding_id, finding_index, ...) joined to findings (id, position): by id; one without an id by position. The last review of a finding counts."""
    values = [c for c in reviews.columns if c not in ("finding_id", "finding_index", "seq")]
    latest = lambda df, by: df.groupBy(by).agg(F.max(F.struct("seq", *values)).alias("r"))
    by_id = latest(reviews.filter(text_or_empty("finding_id") != ""), "finding_id").withColumnRenamed("r", "ri")
    by_at = latest(reviews.filter(text_or_empty("finding_id") == ""), "finding_index").withColumnRenamed("r", "rp")
    out = findings.join(by_id, findings["id"] == by_id["finding_id"], "left").join(by_at, findings["position"] == by_at["finding_index"], "left")
    return out.select(findings["*"], *[F.coalesce(f"ri.{v}", f"rp.{v}").alias(v) for v in values])


def merge_rows(rows: DataFrame, key: str, order: list[str], later_wins: bool) -> DataFrame:
    """One row a key, each column by its first (or last) value that isn't missing, in the order of ``order``."""
    def value(c: str) -> Column:
        kind = rows.schema[c].dataType.typeName()
        there = F.col(c).isNotNull() & (F.size(c) > 0 if kind in ("array", "map") else (F.col(c) != "" if kind == "string" else F.lit(True)))
        pick = F.max if later_wins else F.min
        return pick(F.when(there, F.struct(*order, F.col(c).alias("v"))))["v"].alias(c)

    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(*[value(c) for c in rest], F.min(F.struct(*order)).alias("first_order"))
