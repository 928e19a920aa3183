"""The registered queries over the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths, severity, text
from ..functions.rules import RISK_KEYWORDS, Rule
from ..operators import coverage, findings, folding, graph, planning, rule_hits, scan
from ..operators.rule_hits import top
from ..sources import driver_tables as dt
from ..streaming import events as ev
from . import summaries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: A rule table for prose, as the default one is for source code.
PROSE = {"notice": ("license", "licensed", "version"), "secret": ("token", "api_key", "password", "secret"), "contact": ("@", "phone", "tel"), "markup": ("| ", "***", "###", "$$$")}
PROSE_RULES = tuple(Rule(k, v, v[:1], v[1:], 1, 1, (2 + i, 5 + i)) for i, (k, v) in enumerate(PROSE.items()))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _count_sql(col: str, words) -> str:
    return " + ".join(f"CAST(contains({col}, '{w.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for w in words)


_STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g'), '#[^\n]*', ' ', 'g'), '(?s)""'+'".*?""'+'"', '""', 'g'), '(?s)''''''.*?''''''', '''''', 'g')""".replace("""""'+'\"""", '"""')
_FILES = "SELECT lang AS project, doc_id AS ordinal, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, '.txt' AS extension, n_chars AS size, text AS content FROM documents"


def prose_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks with risk by the prose rules."""
    f = dt.files(spark, sf_dir)
    chunks = f.select("project", F.col("ordinal").alias("chunk_ordinal"), F.col("path").alias("file_path"), F.col("path").alias("base_file_path"), F.lit("full").alias("chunk_type"), "content")
    return scan.with_risk(chunks, PROSE)


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = dt.web_files(spark, sf_dir)
    chunks = f.select("project", F.col("ordinal").alias("chunk_ordinal"), F.col("path").alias("file_path"), F.col("path").alias("base_file_path"), F.lit("full").alias("chunk_type"), "content")
    return scan.with_risk(chunks)


def _hits_sql() -> str:
    parts = []
    for r in PROSE_RULES:
        w = f"3 * ({_count_sql('low', r.strong)}) + ({_count_sql('low', r.medium)})"
        parts.append(f"SELECT project, path, doc, '{r.label}' AS label, {_count_sql('low', r.hits)} AS n, {w} AS w, risk FROM c WHERE {_count_sql('hay', PROSE[r.label])} > 0")
    risk = " + ".join(f"3 * least(4, {_count_sql('hay', v)})" for v in PROSE.values())
    return f"""WITH f AS ({_FILES}),
s AS (SELECT project, path, ordinal AS doc, lower(path) || chr(10) || lower({_STRIP.format('substr(content, 1, 12000)')}) AS hay, lower({_STRIP.format('content')}) AS low FROM f WHERE content <> ''),
c AS (SELECT *, {risk} AS risk FROM s), h AS ({' UNION ALL '.join(parts)})
SELECT project, label, count(*) AS n_hits, CAST(sum(n) AS BIGINT) AS keyword_hits, CAST(sum(w) AS BIGINT) AS weight, CAST(sum(risk + 3 * w + 2 * n) AS BIGINT) AS risk FROM h WHERE n >= 1 AND w >= 1 GROUP BY project, label"""


@query(_hits_sql())
def rule_hit_counts(spark, sf):
    """Prose rules over documents, summed by project and label."""
    h = rule_hits.rule_hits(prose_chunks(spark, sf), PROSE_RULES, None)
    return h.groupBy("project", "label").agg(F.count(F.lit(1)).alias("n_hits"), F.sum("keyword_hit_count").alias("keyword_hits"), F.sum("weighted_score").cast("long").alias("weight"), F.sum("risk_score").cast("long").alias("risk"))


@query(f"""WITH f AS ({_FILES}), l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM f),
hit AS (SELECT path, min(i) AS i FROM l WHERE {_count_sql('lower(line)', PROSE['notice'])} > 0 GROUP BY path)
SELECT l.path, trim(string_agg(line, chr(10) ORDER BY l.i)) AS evidence FROM l JOIN hit ON l.path = hit.path AND l.i BETWEEN hit.i - 2 AND hit.i + 2 GROUP BY l.path""")
def evidence_window(spark, sf):
    """Lines around the first one with a keyword (D3)."""
    lined = dt.files(spark, sf).withColumn("lines", text.split_lines("content"))
    return lined.select("path", text.first_hit_window(F.col("lines"), PROSE["notice"]).alias("evidence")).filter("evidence <> ''")


@query(f"""WITH f AS ({_FILES}) SELECT path, CAST(length({_STRIP.format('content')}) AS BIGINT) AS stripped_length, md5({_STRIP.format('content')}) AS stripped_md5 FROM f
UNION ALL SELECT 'page_' || page_id, CAST(length({_STRIP.format('html')}) AS BIGINT), md5({_STRIP.format('html')}) FROM pages""")
def comment_strip(spark, sf):
    """Comments and triple-quoted strings removed from documents and pages."""
    d = dt.files(spark, sf).select("path", text.strip_comments("content").alias("s")).unionByName(dt.table(spark, sf, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("path"), text.strip_comments("html").alias("s")))
    return d.select("path", F.length("s").cast("long").alias("stripped_length"), F.md5(F.col("s").cast("binary")).alias("stripped_md5"))


def _chunk_risk_sql() -> str:
    risk = " + ".join(f"3 * least(4, {_count_sql('hay', v)})" for v in RISK_KEYWORDS.values())
    labels = ", ".join(f"CASE WHEN {_count_sql('hay', v)} > 0 THEN '{k}' END" for k, v in RISK_KEYWORDS.items())
    return f"""WITH f AS ({_FILES}), s AS (SELECT path, lower(path) || chr(10) || lower({_STRIP.format('substr(content, 1, 12000)')}) AS hay FROM f)
SELECT path, CAST({risk} + 2 * ({_count_sql('lower(path)', scan.RISK_PATHS)}) AS BIGINT) AS risk_score, concat_ws(',', {labels}) AS risk_labels FROM s"""


@query(_chunk_risk_sql())
def chunk_risk(spark, sf):
    """Risk score and labels of documents by the default keywords."""
    f = scan.with_risk(dt.files(spark, sf).withColumnRenamed("path", "base_file_path"))
    return f.select(F.col("base_file_path").alias("path"), F.col("risk_score").cast("long").alias("risk_score"), F.array_join("risk_labels", ",").alias("risk_labels"))


@query(f"""WITH f AS ({_FILES}), s AS (SELECT project, ordinal, path, CAST(1 + 4 * ({_count_sql('lower(path)', scan.HIGH_TERMS)}) + 2 * ({_count_sql('lower(path)', scan.MEDIUM_TERMS)}) + CASE WHEN size > 500000 THEN 3 WHEN size <= 4096 THEN 1 ELSE 0 END AS BIGINT) AS score FROM f)
SELECT project, path, score, file_rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, ordinal, path) AS file_rank FROM s) WHERE file_rank <= 100""")
def file_priority_topk(spark, sf):
    """Files of highest priority in each project."""
    return scan.select_files(dt.files(spark, sf), 100).select("project", "path", F.col("score").cast("long").alias("score"), F.col("file_rank").cast("long").alias("file_rank"))


@query(f"""WITH f AS ({_FILES}), r AS (SELECT project, path, content, coalesce(sum(length(content)) OVER (PARTITION BY project ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT project, path, CAST(least(length(content), 100000 - before) AS BIGINT) AS kept, md5(substr(content, 1, CAST(100000 - before AS BIGINT))) AS kept_md5 FROM r WHERE before < 100000""")
def prefix_char_budget(spark, sf):
    """The first files of each project within a budget of characters, the last one cut."""
    out = planning.running_budget(dt.files(spark, sf), ["project"], ["ordinal"], "content", 100_000)
    return out.select("project", "path", F.length("content").cast("long").alias("kept"), F.md5(F.col("content").cast("binary")).alias("kept_md5"))


@query()
def code_chunks(spark, sf):
    """Files chosen, packed into chunks line by line, scored and held within the budgets."""
    out = scan.code_chunks(scan.select_files(dt.files(spark, sf)), 1000)
    return out.select("project", "file_path", "base_file_path", "chunk_type", F.length("content").alias("n_chars"), "risk_score", F.array_join("risk_labels", ",").alias("risk_labels"), "chunk_ordinal")


@query()
def oversized_windows(spark, sf):
    """Documents treated as oversized: head, merged windows around keywords, tail."""
    f = dt.files(spark, sf).withColumn("file_rank", F.col("ordinal"))
    return scan.oversized_chunks(f, PROSE["notice"]).select("base_file_path", "chunk_idx", "file_path", "chunk_type", F.length("content").alias("n_chars"))


@query(f"""WITH f AS ({_FILES}), l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM f),
h AS (SELECT path, i, lag(i) OVER (PARTITION BY path ORDER BY i) AS prev FROM l WHERE contains(line, '|') OR contains(line, '*')), g AS (SELECT path, i, sum(CASE WHEN prev IS NULL OR i - 1 > prev + 2 + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS island FROM h)
SELECT path, CAST(island AS BIGINT) AS island, greatest(min(i) - 1, 0) AS lo, CAST(max(i) + 2 AS BIGINT) AS hi, count(*) AS n_lines FROM g GROUP BY path, island""")
def signal_windows_merged(spark, sf):
    """Windows of one line around marked lines, joined over gaps of up to two."""
    lined = text.fixed(dt.files(spark, sf), lines=F.split("content", "\n"))
    marked = text.fixed(lined, hits=F.array_compact(F.transform("lines", lambda line, i: F.when(line.contains("|") | line.contains("*"), i))))
    windows = scan.merge_windows(F.transform("hits", lambda i: F.struct(F.greatest(i - 1, F.lit(0)).alias("lo"), (i + 2).alias("hi"))), 2)
    each = marked.select("path", "hits", F.posexplode(windows).alias("k", "w"))
    n = F.size(F.filter("hits", lambda i: (i >= F.col("w.lo")) & (i < F.col("w.hi"))))
    return each.select("path", (F.col("k") + 1).cast("long").alias("island"), F.col("w.lo").cast("long").alias("lo"), F.col("w.hi").cast("long").alias("hi"), n.cast("long").alias("n_lines"))


@query(f"WITH f AS ({_FILES}) SELECT project, sha256(string_agg(path || '|' || extension || '|' || size, chr(10) ORDER BY path || '|' || extension || '|' || size)) AS fingerprint, count(*) AS n_files FROM f GROUP BY project")
def project_fingerprint(spark, sf):
    """A hash of each project's listing."""
    return scan.fingerprint(dt.files(spark, sf))


@query("SELECT substr(sha256(text), 1, 16) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc, CAST(length(any_value(text)) AS BIGINT) AS n_chars FROM documents GROUP BY text HAVING count(*) > 1")
def content_hash_dupes(spark, sf):
    """Equal contents by hash."""
    d = dt.table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), F.length("text").alias("n"))
    return d.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.max("n").cast("long").alias("n_chars")).filter("copies > 1").select(F.substring("h", 1, 16).alias("content_hash"), "copies", "first_doc", "n_chars")


_ID_SQL = "coalesce('rt_' || substr(sha1(concat_ws('|', CASE WHEN trim(method) = '' THEN 'UNKNOWN' ELSE upper(trim(method)) END, regexp_replace(path, '\\s+', '', 'g'), trim(handler), lower(trim(file_path, '/')))), 1, 12), '')"


@query(f"SELECT {_ID_SQL} AS route_id, count(*) AS n, min(ordinal) AS first_page FROM ({dt.ROUTES_SQL}) GROUP BY 1")
def route_identity(spark, sf):
    """Route ids by verb, path, handler and file (K1)."""
    return coverage.with_route_id(dt.routes(spark, sf)).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first_page"))


_CANON = "list_reduce(list_prepend('', list_transform(list_filter(string_split(lower(path), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') OR regexp_full_match(s, '[0-9a-f-]{8,}') THEN '{id}' ELSE s END)), lambda a, b: a || '/' || b)"


@query(f"SELECT {_CANON} AS match_path, count(*) AS n FROM ({dt.ROUTES_SQL}) WHERE path NOT LIKE '%/' AND path <> '' GROUP BY 1")
def path_canonical(spark, sf):
    """Canonical paths, ids as {id} (K6)."""
    return dt.routes(spark, sf).filter("path NOT LIKE '%/' AND path <> ''").groupBy(paths.route_match_path("path").alias("match_path")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT CASE WHEN length(p) > 1 THEN regexp_replace(p, '/+$', '') ELSE p END AS route, count(*) AS n FROM (SELECT regexp_replace('/' || regexp_replace(path, '\\s+', '', 'g'), '/{{2,}}', '/', 'g') AS p FROM ({dt.ROUTES_SQL})) GROUP BY 1""")
def route_paths(spark, sf):
    """Paths with one slash between parts and none at the end."""
    return dt.routes(spark, sf).groupBy(paths.route_path("path").alias("route")).agg(F.count(F.lit(1)).alias("n"))


_PRIORITY_SQL = f"4 * ({_count_sql('lower(path)', coverage.PATH_MARKERS)}) + 2 * ({_count_sql('lower(file_path)', coverage.FILE_MARKERS)}) + 2 * ({_count_sql('lower(handler)', coverage.HANDLER_MARKERS)}) + CASE lower(auth) WHEN 'none' THEN 2 WHEN '' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END + CASE WHEN upper(method) IN ('POST', 'PUT', 'PATCH', 'DELETE', 'ANY') THEN 2 ELSE 0 END"


@query(f"SELECT ordinal AS page_id, CAST({_PRIORITY_SQL} AS BIGINT) AS priority FROM ({dt.ROUTES_SQL})")
def route_priority(spark, sf):
    """How much a route is worth looking at (K3)."""
    return dt.routes(spark, sf).select(F.col("ordinal").alias("page_id"), coverage.route_priority().cast("long").alias("priority"))


@query(f"""WITH r AS (SELECT *, {_ID_SQL.replace("trim(handler)", "''").replace("|| substr", "|| substr")} AS route_id FROM (SELECT * REPLACE ('' AS handler) FROM ({dt.ROUTES_SQL})))
SELECT route_id, arg_min(auth, (source_rank, ordinal)) AS auth, count(*) AS n FROM r GROUP BY route_id""")
def route_merge_first_nonempty(spark, sf):
    """Routes of two sources merged; the earlier value that isn't missing counts (K2)."""
    r = dt.routes(spark, sf).withColumn("handler", F.lit(""))
    n = coverage.with_route_id(r).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    return coverage.merge_routes(r).select("route_id", "auth").join(n, "route_id")


@query("SELECT status AS raw, s AS status, s IN ('audited_no_finding', 'finding', 'confirmed_finding', 'skipped_with_reason', 'not_applicable') AS audited, n FROM (SELECT status, CASE status WHEN '1 0' THEN '1_0' WHEN 'Covered' THEN 'audited_no_finding' WHEN '' THEN 'audited_no_finding' ELSE 'needs_followup' END AS s, count(*) AS n FROM (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'Covered' WHEN quality = 1 THEN '1 0' WHEN toxic = 0 THEN '' ELSE 'gap' END AS status FROM labels) GROUP BY ALL)")
def coverage_statuses(spark, sf):
    """Coverage statuses by their usual names; blank counts as audited (K4)."""
    raw = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "Covered").when(F.col("quality") == 1, "1 0").when(F.col("toxic") == 0, "").otherwise("gap")
    return dt.table(spark, sf, "labels").select(raw.alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", severity.coverage_status("raw").alias("status"), severity.is_audited("raw").alias("audited"), "n")


_SEV_SQL = "CASE severity WHEN 'Critical' THEN 'Critical' WHEN 'high' THEN 'High' WHEN '高危' THEN 'High' WHEN 'Low' THEN 'Low' WHEN 'Info' THEN 'Info' ELSE 'Medium' END"


@query(f"SELECT severity AS raw, {_SEV_SQL} AS severity, count(*) AS n FROM ({dt.FINDINGS_SQL}) GROUP BY ALL")
def severity_names(spark, sf):
    """Severities by their usual names."""
    return dt.findings(spark, sf).groupBy(F.col("severity").alias("raw")).agg(F.count(F.lit(1)).alias("n")).select("raw", severity.severity("raw").alias("severity"), "n")


@query(f"SELECT task_id, count_if(s = 'Critical') AS critical, count_if(s = 'High') AS high, count_if(s = 'Medium') AS medium, count_if(s = 'Low') AS low, count_if(s = 'Info') AS info FROM (SELECT task_id, {_SEV_SQL} AS s FROM ({dt.FINDINGS_SQL})) GROUP BY task_id")
def severity_histogram_zero_filled(spark, sf):
    """A count of every severity, zeros included."""
    return planning.severity_counts(dt.findings(spark, sf).withColumn("severity", severity.severity("severity")), ["task_id"])


@query(f"SELECT task_id, seq, title, severity, place FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY o DESC, seq DESC, title, severity) AS place FROM (SELECT *, CASE severity WHEN 'Critical' THEN 5 WHEN 'high' THEN 4 WHEN '高危' THEN 4 WHEN 'Low' THEN 2 WHEN 'Info' THEN 1 ELSE 0 END AS o FROM ({dt.FINDINGS_SQL})) WHERE stage_num BETWEEN 2 AND 9) WHERE place <= 20")
def findings_filtered_ranked(spark, sf):
    """The worst findings of each task."""
    f = dt.findings(spark, sf).filter(F.col("stage_num").between(2, 9)).withColumn("o", severity.severity_order("severity"))
    return top(f, ["task_id"], [F.desc("o"), F.desc("seq"), F.col("title"), F.col("severity")], 20, "place").select("task_id", "seq", "title", "severity", F.col("place").cast("long").alias("place"))


@query(f"SELECT task_id, stage_num, count(*) AS n FROM ({dt.FINDINGS_SQL}) GROUP BY ALL")
def stage_formal_counts(spark, sf):
    """Findings of every stage."""
    return summaries.stage_counts(dt.findings(spark, sf))


@query("SELECT (SELECT count(*) FROM customer) AS projects, (SELECT count(*) FROM orders) AS audits, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS completed, (SELECT count(*) FROM lineitem) AS findings")
def global_stats(spark, sf):
    """Four counts."""
    o = dt.table(spark, sf, "orders")
    return summaries.totals(projects=dt.table(spark, sf, "customer"), audits=o, completed=o.filter("o_orderstatus = 'F'"), findings=dt.table(spark, sf, "lineitem"))


@query(f"SELECT vuln_type, CAST(max(o) AS BIGINT) AS worst, count(*) AS n, row_number() OVER (ORDER BY max(o) DESC, vuln_type) AS place FROM (SELECT vuln_type, CASE severity WHEN 'Critical' THEN 5 WHEN 'high' THEN 4 WHEN '高危' THEN 4 WHEN 'Low' THEN 2 WHEN 'Info' THEN 1 ELSE 0 END AS o FROM ({dt.FINDINGS_SQL})) GROUP BY vuln_type")
def type_groups_by_worst(spark, sf):
    """Kinds of findings by their worst (O10). One row a kind is ranked."""
    return summaries.type_groups(dt.findings(spark, sf)).withColumn("place", F.col("place").cast("long"))


_ANCHOR = "CASE WHEN line_start IS NOT NULL THEN 'line:' || line_start || '-' || line_start WHEN code_snippet IS NOT NULL THEN 'code:' || substr(sha256(substr(regexp_replace(regexp_replace(trim(regexp_replace(lower(code_snippet), '[^0-9a-z/._-]+', ' ', 'g')), '\\b\\d+\\b', '{n}', 'g'), '\\b[0-9a-f]{8,}\\b', '{hex}', 'g'), 1, 160)), 1, 16) ELSE upper(split_part(endpoint, ' ', 1)) || ' ' || regexp_replace(lower(split_part(endpoint, ' ', 2)), '/[0-9]+$', '/{id}') END"
_KEYED = f"""SELECT *, substr(sha256(concat_ws('|', fam, file_anchor, anchor)), 1, 32) AS dedupe_key FROM (SELECT *, substr(trim(regexp_replace(lower(vuln_type), '[^0-9a-z/._-]+', ' ', 'g')), 1, 80) AS fam,
  array_to_string(string_split(trim(regexp_replace(lower(file_path), '[^0-9a-z/._-]+', ' ', 'g')), '/')[-4:], '/') AS file_anchor, {_ANCHOR} AS anchor FROM ({dt.FINDINGS_SQL}))"""


@query(f"SELECT dedupe_key, any_value(fam) AS family, any_value(file_anchor) AS file_anchor, any_value(anchor) AS location_anchor, count(*) AS n FROM ({_KEYED}) GROUP BY dedupe_key")
def root_cause_keys(spark, sf):
    """Findings by root cause: family, file and place."""
    return findings.root_cause(dt.findings(spark, sf)).groupBy("dedupe_key").agg(F.max("family").alias("family"), F.max("file_anchor").alias("file_anchor"), F.max("location_anchor").alias("location_anchor"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH k AS ({_KEYED}), s AS (SELECT *, CASE severity WHEN 'Critical' THEN 5 WHEN 'Low' THEN 2 WHEN 'Info' THEN 1 ELSE 0 END AS r, CASE lower(confidence) WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END AS cr FROM k),
m AS (SELECT *, 100 * r + 20 * cr + CASE WHEN poc_validation_status = 'valid' THEN 20 ELSE 0 END + CASE WHEN code_snippet IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN endpoint IS NOT NULL THEN 6 ELSE 0 END + least(12, length(description) // 80) AS score FROM s)
SELECT task_id, dedupe_key, CASE max(r) WHEN 5 THEN 'Critical' WHEN 2 THEN 'Low' WHEN 1 THEN 'Info' ELSE any_value(own) END AS severity, arg_min(title, (-score, seq)) AS title, min(seq) AS first_seq, count(*) AS n_merged,
  CASE WHEN bool_or(poc_validation_status = 'valid') THEN 'valid' END AS poc FROM (SELECT *, first_value({_SEV_SQL}) OVER (PARTITION BY task_id, dedupe_key ORDER BY -score, seq) AS own FROM m) GROUP BY task_id, dedupe_key""")
def merge_best_finding(spark, sf):
    """One finding a root cause, the best of each field."""
    m = findings.merge_duplicates(findings.root_cause(dt.findings(spark, sf, row=True)), ties=("row",))
    return m.select("task_id", "dedupe_key", "severity", "title", "first_seq", "n_merged", F.col("poc_validation_status").alias("poc"))


#: What orders findings of one number, which the line items have.
_TIES = ("title", "vuln_type", "file_path", "line_start", "severity", "confidence", "poc_validation_status", "code_snippet", "endpoint", "description")


def _fold_sql() -> str:
    """Findings of a root cause merged one after the other, by recursion."""
    rank = lambda x: f"CASE {x} WHEN 'Critical' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 WHEN 'Info' THEN 1 ELSE 0 END"
    level = lambda x: f"CASE lower({x}) WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END"
    points = lambda t: (
        f"100 * ({rank(f'{t}.severity')}) + 20 * ({level(f'{t}.confidence')}) + CASE WHEN {t}.poc = 'valid' THEN 20 ELSE 0 END + CASE WHEN {t}.code_snippet <> '' THEN 12 ELSE 0 END"
        f" + CASE WHEN {t}.endpoint <> '' THEN 6 ELSE 0 END + least(12, length(trim(coalesce({t}.description, ''))) // 80)"
    )
    fields = ("title", "severity", "confidence", "poc", "code_snippet", "endpoint", "description", "line_start")
    sides = ", ".join(f"CASE WHEN up THEN f_{c} ELSE r_{c} END AS p_{c}, CASE WHEN up THEN r_{c} ELSE f_{c} END AS s_{c}" for c in fields)
    named = lambda x: f"CASE lower({x}) WHEN 'critical' THEN 'Critical' WHEN 'high' THEN 'High' WHEN '高危' THEN 'High' WHEN 'low' THEN 'Low' WHEN 'info' THEN 'Info' ELSE 'Medium' END"
    return f"""
WITH RECURSIVE r AS (SELECT task_id, dedupe_key, seq, title, severity, confidence, poc_validation_status AS poc, code_snippet, endpoint, description, line_start,
  row_number() OVER (PARTITION BY task_id, dedupe_key ORDER BY seq, {", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _TIES)}) AS rn, count(*) OVER (PARTITION BY task_id, dedupe_key) AS n FROM ({_KEYED})),
f AS (SELECT task_id, dedupe_key, rn, n, {", ".join(fields)} FROM r WHERE rn = 1
  UNION ALL SELECT task_id, dedupe_key, rn, n, coalesce(nullif(p_title, ''), s_title), {named(f"CASE WHEN ({rank('p_severity')}) >= ({rank('s_severity')}) THEN p_severity ELSE s_severity END")},
    CASE WHEN ({level('p_confidence')}) >= ({level('s_confidence')}) THEN p_confidence ELSE s_confidence END, CASE WHEN p_poc = 'valid' OR s_poc = 'valid' THEN 'valid' ELSE p_poc END,
    coalesce(nullif(p_code_snippet, ''), s_code_snippet), coalesce(nullif(p_endpoint, ''), s_endpoint),
    CASE WHEN p_endpoint <> s_endpoint AND p_endpoint <> '' AND s_endpoint <> '' AND NOT contains(coalesce(nullif(p_description, ''), s_description), '等价入口：' || s_endpoint)
      THEN coalesce(nullif(p_description, ''), s_description) || chr(10) || chr(10) || '等价入口：' || s_endpoint ELSE coalesce(nullif(p_description, ''), s_description) END, coalesce(p_line_start, s_line_start)
  FROM (SELECT task_id, dedupe_key, rn, n, {sides} FROM (SELECT r.task_id, r.dedupe_key, r.rn, r.n, ({points('f')}) >= ({points('r')}) AS up, {", ".join(f"f.{c} AS f_{c}, r.{c} AS r_{c}" for c in fields)}
    FROM f JOIN r ON r.task_id = f.task_id AND r.dedupe_key = f.dedupe_key AND r.rn = f.rn + 1)))
SELECT task_id, dedupe_key, {", ".join(fields)}, n AS n_merged FROM f WHERE rn = n"""


@query(_fold_sql())
def folded_findings(spark, sf):
    """Findings of one root cause merged in the order they came."""
    told = ("task_id", "dedupe_key", "seq", *_TIES, "poc_raw", "line_end")  # what is merged, and what orders it
    f = dt.findings(spark, sf)
    by_path = f.groupBy("task_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    by_file = by_path.groupBy("task_id", paths.file_anchor("file_path").alias("file")).agg(F.sum("n").alias("n"))  # findings of one root cause are of one file
    m = folding.folded_duplicates(findings.root_cause(f).select(*told), ties=_TIES, bounds=by_file)
    return m.select("task_id", "dedupe_key", "title", "severity", "confidence", F.col("poc_validation_status").alias("poc"), "code_snippet", "endpoint", "description", "line_start", "n_merged")


@query(f"SELECT CASE WHEN salvaged THEN 'salvaged' ELSE 'accepted' END AS outcome, stage_num, count(*) AS n FROM ({dt.FINDINGS_SQL}) GROUP BY ALL")
def gate_rejections(spark, sf):
    """Findings that are no formal ones, by reason."""
    return dt.findings(spark, sf).groupBy(F.coalesce(findings.rejection_reason(), F.lit("accepted")).alias("outcome"), "stage_num").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH k AS (SELECT DISTINCT dedupe_key FROM ({_KEYED}) WHERE seq % 3 = 0), n AS (SELECT seq, dedupe_key, severity FROM ({_KEYED}))
SELECT CASE WHEN k.dedupe_key IS NOT NULL THEN 'confirmed' WHEN severity IN ('Critical', 'High') THEN 'needs_review' ELSE 'unreviewed' END AS review_status, count(*) AS n FROM n LEFT JOIN k USING (dedupe_key) GROUP BY 1""")
def review_carry_forward(spark, sf):
    """Reviews taken over by root cause; severe findings left over are flagged."""
    k = graph.checkpointed(findings.root_cause(dt.findings(spark, sf)).select("seq", "dedupe_key", "severity", "task_id"))  # both sides read it; root causes are worked out once
    null = F.lit(None).cast("string")
    before = k.withColumns({"review_status": F.when(F.col("seq") % 3 == 0, "confirmed").otherwise("unreviewed"), "status": F.lit("open"), "review_note": F.lit("a note"), "reviewed_at": F.lit(None).cast("timestamp"), "reviewer": null, "cwe": null})
    return findings.carry_reviews(k, before).groupBy("review_status").agg(F.count(F.lit(1)).alias("n"))


_ATTEST = "SELECT doc_id % 5 AS task_id, CAST(doc_id % 8 + 2 AS INTEGER) AS stage_num, doc_id AS page_id, CASE WHEN quality = 1 THEN 'covered' WHEN toxic = 1 THEN 'gap' ELSE 'insufficient_context' END AS status FROM labels"


def _attested(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Routes by page, and labels as what stages say about them."""
    routes = coverage.with_route_id(dt.routes(spark, sf))
    l = dt.table(spark, sf, "labels").select((F.col("doc_id") % 5).alias("task_id"), (F.col("doc_id") % 8 + 2).cast("int").alias("stage_num"), F.col("doc_id").alias("ordinal"), F.when(F.col("quality") == 1, "covered").when(F.col("toxic") == 1, "gap").otherwise("insufficient_context").alias("status"), F.lit("").alias("reason"))
    ids = routes.select("ordinal", "route_id")
    items = coverage.coverage_items(l.join(ids, "ordinal"))
    return routes.groupBy("task_id", "route_id").agg(*[F.min(c).alias(c) for c in ("method", "path", "handler", "file_path", "auth")]), items


def _no_findings(routes: DataFrame) -> DataFrame:
    return routes.limit(0).select("task_id", F.lit(2).alias("stage_num"), F.lit(None).cast("string").alias("matched_route_id"))


_ROUTED = f"r AS (SELECT *, {_ID_SQL} AS route_id FROM ({dt.ROUTES_SQL})), k AS (SELECT DISTINCT task_id, route_id FROM r), i AS (SELECT DISTINCT a.task_id, a.stage_num, r.route_id, CASE a.status WHEN 'covered' THEN 'audited_no_finding' WHEN 'gap' THEN 'needs_followup' ELSE a.status END AS status FROM ({_ATTEST}) a JOIN r ON r.ordinal = a.page_id)"


@query(f"""WITH {_ROUTED}, s AS (SELECT task_id, route_id, bool_or(status = 'audited_no_finding') AS ok FROM i GROUP BY ALL)
SELECT task_id, count(*) AS known_route_count, count_if(coalesce(ok, false)) AS audited_route_count, count_if(ok IS NOT NULL) AS attested_route_count, count_if(ok IS NULL) AS unattested_route_count, count_if(NOT ok) AS attested_gap_route_count, round(count_if(coalesce(ok, false)) / count(*), 4) AS coverage_ratio FROM k LEFT JOIN s USING (task_id, route_id) GROUP BY task_id""")
def coverage_summary(spark, sf):
    """Known, audited, attested and missing routes of each task (K5, K8)."""
    routes, items = _attested(spark, sf)
    by_route = coverage.coverage_by_route(routes, items, _no_findings(routes))
    out = coverage.coverage_summary(by_route, coverage.stage_coverage(items, items.limit(0)))
    return out.select("task_id", "known_route_count", "audited_route_count", "attested_route_count", "unattested_route_count", "attested_gap_route_count", "coverage_ratio")


@query(f"WITH {_ROUTED} SELECT task_id, route_id FROM k WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.task_id = k.task_id AND i.route_id = k.route_id)")
def coverage_missing(spark, sf):
    """Routes that no stage attests."""
    routes, items = _attested(spark, sf)
    return routes.select("task_id", "route_id").join(items, ["task_id", "route_id"], "left_anti")


@query(f"""WITH {_ROUTED}, f AS (SELECT task_id, CAST(unnest([2, 3, 4]) AS INTEGER) AS stage_num, route_id FROM k), s AS (SELECT task_id, stage_num, route_id, bool_or(status = 'audited_no_finding') AS ok FROM i GROUP BY ALL)
SELECT task_id, stage_num, count(f.route_id) AS focus_route_count, count(s.route_id) AS attested_route_count, count_if(coalesce(ok, false)) AS audited_route_count, count_if(f.route_id IS NOT NULL AND s.route_id IS NULL) AS unattested_focus_route_count
FROM (SELECT * FROM f) f FULL JOIN s USING (task_id, stage_num, route_id) GROUP BY ALL""".replace("count(f.route_id)", "count(f.is_focus)").replace("SELECT * FROM f", "SELECT *, true AS is_focus FROM f").replace("f.route_id IS NOT NULL", "f.is_focus").replace("count(s.route_id)", "count(s.ok)").replace("s.route_id IS NULL", "s.ok IS NULL"))
def stage_gap_counts(spark, sf):
    """Focus routes of stages, and what became of them (K8)."""
    routes, items = _attested(spark, sf)
    focus = routes.select("task_id", "route_id", F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("stage_num"))
    return coverage.stage_coverage(items, focus).select("task_id", "stage_num", "focus_route_count", "attested_route_count", "audited_route_count", "unattested_focus_route_count")


@query(f"""WITH p AS (SELECT task_id, {_ID_SQL} AS route_id, 2 + ordinal % 8 AS st, CAST({_PRIORITY_SQL} AS BIGINT) AS priority FROM ({dt.ROUTES_SQL})), d AS (SELECT task_id, route_id, min(st) AS stage_num, max(priority) AS priority FROM p GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY priority DESC, route_id) AS r FROM d QUALIFY r <= 48), q AS (SELECT *, (row_number() OVER (PARTITION BY task_id, stage_num ORDER BY priority DESC, route_id) - 1) AS place, min(r) OVER (PARTITION BY task_id, stage_num) AS lead FROM c),
b AS (SELECT *, dense_rank() OVER (PARTITION BY task_id ORDER BY place // 6, lead) AS batch_no FROM q) SELECT task_id, batch_no, stage_num, route_id, place % 6 AS place FROM b WHERE batch_no <= 2""")
def followup_round_robin(spark, sf):
    """Missing routes in batches, stage by stage in turn."""
    r = coverage.with_route_id(dt.routes(spark, sf)).withColumn("p", coverage.route_priority().cast("long"))
    m = r.groupBy("task_id", "route_id").agg(F.min(2 + F.col("ordinal") % 8).alias("suggested_stage"), F.max("p").alias("priority"))
    out = coverage.followup_batches(m)
    return out.select("task_id", F.col("batch_no").cast("long").alias("batch_no"), "stage_num", "route_id", F.col("place").cast("long").alias("place"))


_EVIDENCE = "SELECT o_custkey AS project, CAST(o_orderkey % 8 + 2 AS INTEGER) AS stage_num FROM orders WHERE o_orderstatus <> 'P'"


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    s = dt.stages(spark, sf).filter("status <> 'failed'").select(F.col("task_id").alias("project"), F.array("stage_num").alias("stage_nums"))
    return planning.stage_evidence(s)


@query(f"SELECT project, stage_num, count(*) AS evidence FROM ({_EVIDENCE}) GROUP BY ALL")
def evidence_by_stage(spark, sf):
    """Signals of every stage (L1)."""
    return _evidence(spark, sf)


@query(f"""WITH e AS (SELECT project, stage_num, count(*) AS evidence FROM ({_EVIDENCE}) GROUP BY ALL), p AS (SELECT c_custkey AS project, CAST(unnest(range(2, 10)) AS INTEGER) AS stage_num FROM customer),
f AS (SELECT p.*, coalesce(evidence, 0) AS evidence, p.stage_num IN (2, 7, 9) AS baseline FROM p LEFT JOIN e USING (project, stage_num)), w AS (SELECT *, baseline OR evidence > 0 AS wanted FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY wanted DESC, baseline DESC, evidence DESC, stage_num) AS r FROM w), s AS (SELECT *, wanted AND (baseline OR r <= 5) AS selected FROM r)
SELECT project, stage_num, evidence, selected, CASE WHEN NOT selected THEN CASE WHEN evidence > 0 THEN 'Skipped by fallback agent budget' ELSE 'No supporting static evidence' END END AS skip_reason FROM s""")
def plan_with_budget(spark, sf):
    """Stages to run: the baseline and the best evidence within a budget of five (L2, L3)."""
    projects = dt.table(spark, sf, "customer").select(F.col("c_custkey").alias("project"))
    return planning.plan(projects, _evidence(spark, sf), 5).select("project", "stage_num", "evidence", "selected", "skip_reason")


@query("""WITH s AS (SELECT o_custkey AS task_id, CAST(o_orderkey % 8 + 2 AS INTEGER) AS stage_num, o_orderkey AS id, o_orderstatus AS st FROM orders), l AS (SELECT task_id, stage_num, arg_max(st, id) AS st FROM s GROUP BY ALL),
p AS (SELECT DISTINCT task_id, CAST(unnest([2, 3]) AS INTEGER) AS stage_num FROM s), j AS (SELECT p.*, st FROM p LEFT JOIN l USING (task_id, stage_num))
SELECT task_id, CASE WHEN bool_and(coalesce(st, '') = 'F') THEN 'ok' ELSE 'blocked' END AS guard_status, count_if(st IS NULL) AS missing, count_if(coalesce(st, '') = 'P') AS failed FROM j GROUP BY task_id""")
def orchestration_guard(spark, sf):
    """Whether the planned stages of a task are all done."""
    s = dt.stages(spark, sf)
    last = s.groupBy("task_id", "stage_num").agg(F.max_by("status", "id").alias("status"))
    planned = s.select("task_id").distinct().withColumn("stage_num", F.explode(F.array(F.lit(2), F.lit(3))))
    return planning.guard(planned, last).select("task_id", "guard_status", F.size("missing").cast("long").alias("missing"), F.size("failed").cast("long").alias("failed"))


@query(f"""WITH f AS ({_FILES}), s AS (SELECT project, path, {_count_sql('lower(content)', PROSE['notice'])} - 1 AS score, ordinal FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, ordinal) AS rank FROM s)
SELECT project, path, CAST(score AS BIGINT) AS score, rank FROM r WHERE CASE WHEN score > 0 THEN rank <= 24 ELSE rank <= 12 END""")
def topk_with_backfill(spark, sf):
    """The best chunks, filled up from the rest (M1, M2)."""
    f = dt.files(spark, sf).withColumn("score", text.count_present(F.lower("content"), PROSE["notice"]) - 1).select("project", "path", "score", "ordinal")
    return planning.select_with_backfill(f, ["project"], "score", ["ordinal"]).select("project", "path", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH r AS (SELECT task_id, ordinal, row_number() OVER (PARTITION BY task_id ORDER BY ordinal) AS n FROM ({dt.ROUTES_SQL})), p AS (SELECT task_id, ordinal, 'forced' AS pool, 0 AS p, n AS r FROM r WHERE ordinal % 2 = 0 AND n <= 8 UNION ALL SELECT task_id, ordinal, 'all', 1, n FROM r WHERE n <= 24), m AS (SELECT task_id, ordinal, min((p, r, pool)) AS m FROM p GROUP BY ALL), q AS (SELECT task_id, ordinal, m[3] AS pool, row_number() OVER (PARTITION BY task_id ORDER BY m[1], m[2], ordinal) AS place FROM m) SELECT * FROM q WHERE place <= 16")
def ranked_pool_union(spark, sf):
    """Routes from ranked pools, each route once (M8)."""
    r = planning.shards(dt.routes(spark, sf), ["task_id"], ["ordinal"]).withColumn("pool_rank", F.row_number().over(Window.partitionBy("task_id").orderBy("ordinal")))
    pools = r.filter("ordinal % 2 = 0").withColumn("pool", F.lit("forced")).unionByName(r.withColumn("pool", F.lit("all"))).select("task_id", "ordinal", "pool", "pool_rank")
    return planning.ranked_pools(pools, ["task_id"], "ordinal", {"forced": 8, "all": 24}, 16).withColumn("place", F.col("place").cast("long"))


@query("SELECT user_id AS task_id, event_id AS id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_id > 500) WHERE r <= 10")
def events_after_cursor(spark, sf):
    """The next events of each task after a cursor."""
    return ev.after_cursor(dt.events(spark, sf), 500, 10).select("task_id", "id", "event_type")


@query("SELECT user_id AS task_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def recent_events(spark, sf):
    """The last events of each task in ascending order."""
    return ev.recent(dt.events(spark, sf), 5).select("task_id", "id", F.col("rank").cast("long").alias("place"))


_RUNS = "SELECT event_id + 1 AS id, user_id AS task_id, ts AS started_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END AS ended_at, ['completed', 'running', 'pending'][event_id % 3 + 1] AS status FROM events WHERE event_type = 'signup'"


@query(f"SELECT task_id, r.id AS run_id, r.status, r.open AS is_open FROM (SELECT task_id, max({{'open': status <> 'completed', 'id': id, 'status': status}}) AS r FROM ({_RUNS}) GROUP BY task_id)")
def current_run(spark, sf):
    """The run of each task that is open, else its latest."""
    return ev.current_run(dt.runs(spark, sf))


@query(f"""WITH r AS ({_RUNS}), e AS (SELECT event_id AS id, user_id AS task_id, ts FROM events), a AS (SELECT e.id, e.task_id, arg_max(r.id, (r.started_at, r.id)) AS bound FROM e LEFT JOIN r ON r.task_id = e.task_id AND r.started_at <= e.ts GROUP BY ALL)
SELECT a.id, a.task_id, coalesce(bound, l.id) AS bound_run_id FROM a LEFT JOIN (SELECT task_id, max(id) AS id FROM r GROUP BY task_id) l USING (task_id)""")
def current_run_asof(spark, sf):
    """Events bound to the run that had started last."""
    return ev.bind_runs(dt.events(spark, sf), dt.runs(spark, sf)).select("id", "task_id", "bound_run_id")


@query("SELECT task_id, after_id, before_id, silence_seconds FROM (SELECT user_id AS task_id, lag(event_id) OVER w AS after_id, event_id AS before_id, date_diff('second', date_trunc('second', lag(ts) OVER w), date_trunc('second', ts)) AS silence_seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE silence_seconds >= 900")
def stall_gaps(spark, sf):
    """Silences of a quarter of an hour and more."""
    return ev.silences(dt.events(spark, sf))


@query("SELECT user_id AS task_id, count(*) AS n_events, count_if(event_type LIKE '%error%') AS n_failed, count(DISTINCT event_type) AS n_types, CAST(coalesce(sum(CAST(json_extract_string(props, '$.tokens') AS BIGINT)), 0) AS BIGINT) AS tokens, max(event_id) AS next_cursor FROM events GROUP BY user_id")
def event_stats(spark, sf):
    """Counts by kind in one pass."""
    return ev.stats(dt.events(spark, sf), ["task_id"])


@query("SELECT task_id, count(*) AS n_sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT task_id, s, count(*) AS n FROM (SELECT user_id AS task_id, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 15 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY ALL) GROUP BY task_id")
def silence_sessions(spark, sf):
    """Runs of events without such a silence."""
    return ev.sessions(dt.events(spark, sf)).groupBy("task_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n_events").alias("longest"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload_extract(spark, sf):
    """A payload's field."""
    return dt.events(spark, sf).select(F.col("id").alias("event_id"), F.get_json_object("payload", "$.k").cast("long").alias("k"))


@query("SELECT conv_id AS task_id, arg_min(role, turn) AS role, string_agg(role, ',' ORDER BY f) AS roles, CAST(any_value(n) AS BIGINT) AS n_passes FROM (SELECT conv_id, role, min(turn) AS f, min(turn) AS turn, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id, role) GROUP BY conv_id")
def agent_pass_fold(spark, sf):
    """Passes of an agent folded in order."""
    c = dt.table(spark, sf, "conversations").select(F.col("conv_id").alias("task_id"), "turn", "role", F.array("role").alias("roles"))
    return planning.pass_fold(c, ["task_id"], ["turn"], ["role"], ["roles"]).withColumn("roles", F.array_join("roles", ","))


@query("SELECT conv_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY t, p, word) AS place FROM (SELECT conv_id, word, min((turn, p))[1] AS t, min((turn, p))[2] AS p FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS p FROM conversations) WHERE trim(word) <> '' AND trim(word) = word AND word NOT LIKE '%' || chr(10) || '%' GROUP BY ALL)")
def ordered_distinct_union(spark, sf):
    """Distinct words of a conversation in the order they come."""
    w = dt.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("p", "word")).filter("NOT contains(word, '\n')")
    return planning.ordered_union(w, ["conv_id"], ["turn", "p"], "word").withColumn("place", F.col("place").cast("long"))


@query("SELECT o_custkey % 10 AS project, dst, hub_score FROM (SELECT o_custkey % 10 AS o_custkey, l_partkey AS dst, count(DISTINCT l_suppkey) AS hub_score, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY count(DISTINCT l_suppkey) DESC, l_partkey) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) WHERE r <= 40".replace("PARTITION BY o_custkey % 10", "PARTITION BY orders.o_custkey % 10").replace("GROUP BY 1, 2", "GROUP BY orders.o_custkey % 10, l_partkey").replace("SELECT o_custkey % 10 AS o_custkey", "SELECT orders.o_custkey % 10 AS o_custkey"))
def in_degree_hubs(spark, sf):
    """Targets of the most sources."""
    e = dt.table(spark, sf, "orders").join(dt.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") % 10).alias("project"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.in_degree_hubs(e).select("project", "dst", "hub_score")


@query("""WITH RECURSIVE m AS (SELECT DISTINCT s_suppkey AS src, s_suppkey // 25 * 25 + (s_suppkey * 3 + 1) % 25 AS dst, '/p' || s_suppkey % 7 AS own FROM supplier UNION SELECT s_suppkey, s_suppkey // 25 * 25 + (s_suppkey * 5 + 2) % 25, '/q' FROM supplier),
p AS (SELECT DISTINCT s_suppkey // 25 * 25 + 1 AS file, '' AS prefix, 0 AS d FROM supplier UNION SELECT dst, prefix || own, d + 1 FROM p JOIN m ON src = file WHERE d < 16 AND length(prefix) < 60)
SELECT 'p' || file // 25 AS project, file, min((length(prefix), prefix))[2] AS prefix FROM p GROUP BY file""")
def prefix_recursion(spark, sf):
    """Prefixes along up to 16 mounts, as the SQL has it, with cycles, suppliers in projects of 25; the shortest counts."""
    s = F.col("s_suppkey")
    base = s - s % 25
    project = F.concat(F.lit("p"), F.floor(s / 25).cast("string")).alias("project")
    t = dt.table(spark, sf, "supplier")
    near = t.select(project, s.alias("src"), (base + (s * 3 + 1) % 25).alias("dst"), F.concat(F.lit("/p"), (s % 7).cast("string")).alias("prefix"))
    far = t.select(project, s.alias("src"), (base + (s * 5 + 2) % 25).alias("dst"), F.lit("/q").alias("prefix"))
    roots = t.select(project, (base + 1).alias("file"), F.lit("").alias("prefix")).distinct()
    return graph.propagate_prefixes(near.unionByName(far), roots, lambda a, b: F.concat(a, b), depth=16).select("project", "file", "prefix")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, s_suppkey - s_suppkey % 4 + (s_suppkey + 1) % 4 AS b FROM supplier WHERE s_suppkey % 11 <> 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT s_suppkey AS node FROM supplier UNION SELECT b FROM e),
r(node, comp) AS (SELECT node, node FROM n UNION SELECT u.b, r.comp FROM r JOIN u ON u.a = r.node) SELECT node, min(comp) AS comp FROM r GROUP BY node""")
def import_components(spark, sf):
    """Connected components over imports (M6)."""
    s = F.col("s_suppkey")
    t = dt.table(spark, sf, "supplier")
    e = t.filter(s % 11 != 0).select(s.alias("a"), (s - s % 4 + (s + 1) % 4).alias("b"))
    nodes = t.select(s.alias("node")).unionByName(e.select(F.col("b").alias("node")))
    return graph.connected(e, nodes)


@query("SELECT c.c_custkey AS project, c_mktsegment AS segment, count(o_orderkey) AS n_audits, CAST(coalesce(max(o_orderkey), 0) AS BIGINT) AS latest FROM customer c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def audit_lists(spark, sf):
    """Projects with their audits."""
    o = dt.table(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"))
    c = dt.table(spark, sf, "customer").select(F.col("c_custkey").alias("project"), F.col("c_mktsegment").alias("segment"))
    return summaries.latest(o, "project", c).withColumnRenamed("n_rows", "n_audits")


@query("SELECT o_custkey AS orphan_task, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) GROUP BY 1")
def orphan_rows(spark, sf):
    """Rows whose owner is gone."""
    left = dt.table(spark, sf, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("orphan_task"))
    gone = summaries.orphans(dt.table(spark, sf, "orders").withColumnRenamed("o_custkey", "orphan_task"), left, "orphan_task")
    return gone.groupBy("orphan_task").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH f AS ({_FILES}) SELECT path, {_count_sql('lower(path)', ('.md', '.txt', '.rst'))} > 0 AS low_signal, contains(lower(substr(content, 1, 2000)), 'copyright') AND contains(lower(substr(content, 1, 2000)), 'license') AND length(substr(content, 1, 2000)) < 1200 OR path LIKE '%.txt' AS low_value FROM f""")
def chunk_predicates(spark, sf):
    """Which documents say little, by ending, place and content."""
    from ..functions import chunks

    return dt.files(spark, sf).select("path", chunks.is_low_signal("path").alias("low_signal"), chunks.is_low_value("path", "content").alias("low_value"))


@query(f"""SELECT CASE WHEN stage_num IN (2, 3, 4, 8) THEN 'raw_http' WHEN stage_num IN (5, 6, 9) THEN 'stepwise' ELSE 'cli' END AS kind, stage_num, count(*) AS n FROM ({dt.FINDINGS_SQL}) GROUP BY ALL""")
def proof_kinds(spark, sf):
    """The proof that a finding needs."""
    from ..functions import proofs

    f = proofs.with_proof(dt.findings(spark, sf))
    return f.groupBy(F.col("proof_kind").alias("kind"), "stage_num").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT DISTINCT conv_id, turn, role FROM conversations), f AS (SELECT conv_id, role, min(turn) AS turn FROM c GROUP BY ALL), n AS (SELECT conv_id, turn, count(*) AS n_new FROM f GROUP BY ALL),
e AS (SELECT DISTINCT c.conv_id, c.turn, coalesce(n.n_new, 0) AS n_new FROM c LEFT JOIN n USING (conv_id, turn)), s AS (SELECT *, CAST(sum(n_new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS n_seen FROM e)
SELECT conv_id, turn, n_new, n_seen, n_seen >= 0.995 * 3 AS stop FROM s""")
def pass_progress(spark, sf):
    """How far passes have come, and whether that is enough."""
    c = dt.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    total = c.select("conv_id").distinct().withColumn("n_total", F.lit(3))
    return planning.pass_progress(c, ["conv_id"], "turn", "role", total).select("conv_id", "turn", "n_new", "n_seen", "stop")


@query("SELECT o_custkey % 20 AS project, count(*) AS n_calls, CAST(sum(o_orderkey % 1000) AS BIGINT) AS prompt_tokens, CAST(sum(o_orderkey % 77) AS BIGINT) AS completion_tokens FROM orders GROUP BY 1")
def token_usage(spark, sf):
    """Tokens and calls."""
    o = dt.table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("project"), (F.col("o_orderkey") % 1000).alias("prompt_tokens"), (F.col("o_orderkey") % 77).alias("completion_tokens"))
    return planning.token_usage(o, ["project"])


@query("""WITH s AS (SELECT o_custkey % 20 AS project, 'f' || o_orderkey % 30 AS file_path, CAST(o_orderkey % 8 + 2 AS INTEGER) AS stage_num FROM orders), d AS (SELECT project, stage_num, file_path, row_number() OVER (PARTITION BY project, stage_num ORDER BY file_path) AS r FROM (SELECT DISTINCT * FROM s))
SELECT project, stage_num, n, files FROM (SELECT project, stage_num, count(*) AS n FROM s GROUP BY ALL) JOIN (SELECT project, stage_num, string_agg(file_path, ',' ORDER BY file_path) AS files FROM d WHERE r <= 5 GROUP BY ALL) USING (project, stage_num)""")
def stage_samples(spark, sf):
    """Signals of every stage with some files."""
    k = F.col("o_orderkey")
    s = dt.table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("project"), F.concat(F.lit("f"), (k % 30).cast("string")).alias("file_path"), F.array((k % 8 + 2).cast("int")).alias("stage_nums"))
    return planning.stage_samples(s).withColumn("files", F.array_join("files", ","))


@query("SELECT task_id, ordinal, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY total DESC, ordinal) AS rank FROM (SELECT task_id, ordinal, CAST(ordinal % 5 - 2 + CASE WHEN method = 'post' THEN 8 ELSE 0 END + CASE WHEN auth = 'None' THEN 3 ELSE 0 END AS BIGINT) AS total FROM (" + dt.ROUTES_SQL + ")) WHERE total > 0) WHERE rank <= 10")
def rescored_top(spark, sf):
    """The best of each task after bonuses."""
    r = dt.routes(spark, sf).withColumn("score", F.col("ordinal") % 5 - 2)
    out = planning.rescored(r.select("task_id", "ordinal", "method", "auth", "score"), ["task_id"], "score", {"verb": (F.col("method") == "post", 8), "open": (F.col("auth") == "None", 3)}, ["ordinal"], 10)
    return out.select("task_id", "ordinal", "total", F.col("rank").cast("long").alias("rank"))


@query("""WITH l AS (SELECT o_custkey AS task_id, CAST(o_orderkey % 8 + 2 AS INTEGER) AS stage_num, arg_max(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY ALL), a AS (SELECT DISTINCT o_custkey AS task_id, CAST(unnest([2, 5]) AS INTEGER) AS stage_num FROM orders)
SELECT a.task_id, a.stage_num, CASE WHEN st IS NULL THEN 'not_found' WHEN st = 'F' THEN 'done' ELSE 'retry' END AS outcome FROM a LEFT JOIN l USING (task_id, stage_num)""")
def rerun_outcomes(spark, sf):
    """What becomes of stages that are asked for again."""
    s = dt.stages(spark, sf)
    asked = s.select("task_id", F.explode(F.array(F.lit(2), F.lit(5), F.lit(12))).alias("stage_num"))
    return planning.rerun_stages(asked, s).select("task_id", "stage_num", "outcome")


@query(f"SELECT task_id, count(*) AS total, count_if(severity = 'Critical') AS critical, count_if(severity = '') AS unknown, count_if(seq % 3 <> 0) AS unreviewed, count_if(seq % 3 = 0) AS confirmed FROM ({dt.FINDINGS_SQL}) GROUP BY task_id")
def snapshot_counts(spark, sf):
    """Counts of a task's findings that no filter changes (O3)."""
    from . import views

    f = dt.findings(spark, sf).withColumn("review_status", F.when(F.col("seq") % 3 == 0, "confirmed"))
    return views.snapshot_counts(f).select("task_id", "total", "critical", "unknown", "unreviewed", "confirmed")


@query(f"""WITH f AS (SELECT task_id, CASE WHEN severity = '' THEN 'Unknown' ELSE severity END AS severity, CASE WHEN seq % 3 = 0 THEN 'confirmed' ELSE 'unreviewed' END AS review_status, stage_num FROM ({dt.FINDINGS_SQL}))
SELECT task_id, 'total' AS grain, NULL AS severity, NULL AS review_status, NULL AS stage_num, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT task_id, 'severity', severity, NULL, NULL, count(*) FROM f GROUP BY ALL UNION ALL SELECT task_id, 'review', NULL, review_status, NULL, count(*) FROM f GROUP BY ALL
UNION ALL SELECT task_id, 'stage', NULL, NULL, stage_num, count(*) FROM f GROUP BY ALL UNION ALL SELECT task_id, 'severity_review', severity, review_status, NULL, count(*) FROM f GROUP BY ALL""")
def snapshot_grains(spark, sf):
    """Counts of a task's findings by severity, review, stage and both, in one pass (O3)."""
    from . import views

    return views.snapshot_grains(dt.findings(spark, sf).withColumn("review_status", F.when(F.col("seq") % 3 == 0, "confirmed")))


@query(f"SELECT seq, title, severity FROM ({dt.FINDINGS_SQL}) WHERE stage_num BETWEEN 2 AND 9 AND severity IN ('high', '高危', 'High', '高')")
def filtered_findings(spark, sf):
    """Findings of one severity by any of its names."""
    from . import views

    return views.list_findings(dt.findings(spark, sf), "High", None, None).select("seq", "title", "severity")


@query(f"SELECT task_id, vuln_type, count(*) AS n, count_if(poc_validation_status = 'valid') AS n_valid_proofs FROM ({dt.FINDINGS_SQL}) WHERE seq % 7 <> 0 GROUP BY ALL")
def report_groups(spark, sf):
    """Kinds of findings for a report, without rejected ones."""
    from . import views

    f = dt.findings(spark, sf).withColumn("review_status", F.when(F.col("seq") % 7 == 0, "rejected"))
    return views.report_groups(f).select("task_id", "vuln_type", "n", "n_valid_proofs")
