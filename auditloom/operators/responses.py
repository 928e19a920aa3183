"""Model responses as a table of JSON texts: clean, parse, salvage, score, explode."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.severity import confidence, severity
from ..functions.text import is_placeholder, text_or_empty
from ..functions.tolerant_json import Part, read
from .rule_hits import top

#: Finish reasons, and reasons among the details, that say a response was cut off.
CUT_OFF, CUT_DETAILS = ("length", "max_output_tokens", "max_tokens", "incomplete"), ("max_output_tokens", "max_tokens", "length")
FINDING = "title string, severity string, vuln_type string, file_path string, line_start int, line_end int, code_snippet string, endpoint string, description string, fix_suggestion string, confidence string, poc_raw string"


def cleaned(raw: Column | str) -> Column:
    """Without byte-order marks, zero-width spaces and code fences, with plain quotes of either kind."""
    out = F.regexp_replace(text_or_empty(raw), "[﻿​]", "")
    out = F.translate(out, "“”‘’", "\"\"''")
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(out), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def cut_by_writer(finish: Column | str, status: Column | str, details: Column | str) -> Column:
    """Whether what is known of a response says that it was cut off: its finish reason, its status or the reason in its details."""
    said = lambda c: F.lower(F.trim(text_or_empty(c)))
    return said(finish).isin(*CUT_OFF) | (said(status) == "incomplete") | said(details).isin(*CUT_DETAILS)


def breaks_off(text: Column | str) -> Column:
    """Whether a text doesn't end as JSON does."""
    t = F.rtrim(text_or_empty(text))
    return (t != "") & ~F.right(t, F.lit(1)).isin("}", "]")


_DECODER = json.JSONDecoder()


def best_json(text: str) -> str | None:
    """The text itself, else the first object in it, else, where no object ends, what its outermost brackets hold, if it can be read as JSON."""
    first, listed = text.find("{"), text.find("[")
    try:
        if isinstance(_DECODER.decode(text), (dict, list)):
            return text
    except (ValueError, RecursionError):
        pass
    try:
        if first >= 0:
            return text[first : _DECODER.raw_decode(text, first)[1]]
    except (ValueError, RecursionError):
        pass
    within = text[listed : text.rfind("]") + 1]
    try:
        if listed >= 0 and (first < 0 or "}" not in text[first:]) and isinstance(_DECODER.decode(within), list):
            return within
    except (ValueError, RecursionError):
        pass
    return None


#: What may be read of a finding that breaks off, what makes it one, and what stands for the rest.
CUT_FIELDS = ("title", "severity", "vuln_type", "file_path", "line_start", "line_end", "code_snippet", "endpoint", "poc_raw", "description", "fix_suggestion")
TELLING = ("title", "vuln_type", "file_path", "endpoint", "description")
MISSING = {
    "title": "未命名漏洞", "severity": "Medium", "vuln_type": "未分类漏洞", "file_path": "", "code_snippet": "", "endpoint": "", "poc_raw": "未提供可复现 POC，请结合代码补充复现步骤。",
    "description": "", "fix_suggestion": "",
}
ARCHITECTURE_FIELDS = {"tech_stack": "技术栈：", "framework": "框架：", "database": "数据库：", "auth_mechanism": "认证方式："}
COUNTED = {"routes": "识别到 {} 条路由", "modules": "{} 个功能模块"}
#: What is said of responses that could only be read in part, not at all, or were cut off by their writer.
IN_PART, NOT_AT_ALL, CUT_BY_LENGTH = "模型响应 JSON 不完整，已从截断内容中恢复部分漏洞数据", "无法从模型响应中提取 JSON", "模型响应因输出长度限制被截断"
OUTLINE, NO_OUTLINE = "项目架构概要（从截断响应中恢复）：", "模型响应被截断，架构信息不完整，已恢复部分数据。"


def list_objects(text: str, name: str) -> list[dict]:
    """The whole objects at the top of the first list ``name`` of a text that may break off; what can't be read is passed over."""
    listed = next((v for k, v in read(text)[1] if k == name and isinstance(v, Part) and v.kind == "["), None)
    values = [p.value(text) for _, p in listed.pairs if isinstance(p, Part)] if listed else []
    return [v for v in values if isinstance(v, dict)]


def _cut_finding(part: Part) -> dict | None:
    numbers = ("line_start", "line_end")
    held = {k: part.field(k) for k in CUT_FIELDS}
    held = {k: int(v) if k in numbers else v for k, v in held.items() if isinstance(v, (int, float) if k in numbers else str) and not isinstance(v, bool)}
    return MISSING | held | {"_salvaged": True} if any(held.get(k) for k in TELLING) else None


def _findings(listed: Part, text: str) -> list[dict]:
    """The findings of a list: whole ones up to the first that isn't, and of that one what is there."""
    out = []
    for _, part in listed.pairs:
        if not isinstance(part, Part) or part.kind != "{":
            continue
        value = part.value(text)
        if value is None:
            cut = _cut_finding(part)
            return [*out, cut] if cut else out
        out.append(value | {"_salvaged": True})
    return out


def _outline(info: dict) -> str:
    told = [mark + str(info[k]) for k, mark in ARCHITECTURE_FIELDS.items() if info.get(k)]
    told += [mark.format(len(info[k])) for k, mark in COUNTED.items() if isinstance(info.get(k), list) and info[k]]
    return OUTLINE + "；".join(told) + "。" if told else NO_OUTLINE


def recovered(text: str) -> dict | None:
    """Of a broken response its summary, its description of the architecture and its findings, the cut one included; null if there is none of these."""
    _, pairs = read(text)
    first = lambda name, fits: next((v for k, v in pairs if k == name and fits(v)), None)
    listed = first("vulnerabilities", lambda v: isinstance(v, Part) and v.kind == "[")
    about = first("architecture_info", lambda v: isinstance(v, Part) and v.kind == "{")
    summary = first("stage_summary", lambda v: isinstance(v, str)) or ""
    found, info = _findings(listed, text) if listed else [], {}
    if about:
        info = about.value(text)
        if not isinstance(info, dict):
            info = {k: v for k in ARCHITECTURE_FIELDS if isinstance(v := about.field(k), str)}
    if not (found or summary or info):
        return None
    whole = text.rstrip().endswith(("}", "]")) or not text.strip()
    return {"_salvaged": True, "parse_error": IN_PART, "response_incomplete": not whole, "stage_summary": summary or (_outline(info) if info else ""), "architecture_info": info, "vulnerabilities": found}


def salvage(text: str, name: str = "vulnerabilities") -> str | None:
    """Of a broken response, what can be read of its list ``name`` of findings as a JSON array; null if that is nothing."""
    listed = next((v for k, v in read(text)[1] if k == name and isinstance(v, Part) and v.kind == "["), None)
    found = _findings(listed, text) if listed else []
    return json.dumps([{k: v for k, v in f.items() if k != "_salvaged"} for f in found], ensure_ascii=False) if found else None


def parse(responses: DataFrame, content: str = "content") -> DataFrame:
    """Adds clean, json (the response as JSON text, or null), restored (what a broken one still tells, as JSON, or null), response_json (the one or the other, or the notice that nothing can be read) and parse_state.

    Valid JSON is told by Spark itself; only the rest goes through the reader. The raw text
    stays in ``content`` whatever comes of it.
    """
    clean = responses.withColumn("clean", cleaned(content)).withColumn("_good", F.expr("try_parse_json(clean)").isNotNull() & F.col("clean").rlike(r"^[\[{]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("clean").to_pylist()]
            fixed = [best_json(t) for t in texts]
            saved = [None if f else recovered(t) for f, t in zip(fixed, texts, strict=True)]
            saved = [json.dumps(s, ensure_ascii=False) if s else None for s in saved]
            keep = [batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(fixed, pa.string()), pa.array(saved, pa.string())], names=[*batch.schema.names, "json", "restored"])

    schema = T.StructType([*clean.schema.fields, T.StructField("json", T.StringType()), T.StructField("restored", T.StringType())])
    good = clean.filter("_good").withColumn("json", F.col("clean")).withColumn("restored", F.lit(None).cast("string"))
    bad = clean.filter("NOT _good OR _good IS NULL").mapInArrow(run, schema)
    state = F.when(F.col("_good"), "clean").when(F.col("json").isNotNull(), "extracted").when(F.col("restored").isNotNull(), "salvaged").otherwise("parse_error")
    told = F.to_json(F.struct(F.lit(NOT_AT_ALL).alias("parse_error"), breaks_off("clean").alias("response_incomplete"), F.array().cast("array<string>").alias("vulnerabilities")))
    return good.unionByName(bad).withColumn("parse_state", state).withColumn("response_json", F.coalesce("json", "restored", told)).drop("_good")


def annotated(rows: DataFrame, finish: str = "finish_reason", status: str = "response_status", details: str = "incomplete_reason") -> DataFrame:
    """Of rows (response, is_list) as ``typed`` gives them: marks objects as incomplete that their writer cut off, with a notice where none was."""
    r = F.col("response")
    cut = cut_by_writer(finish, status, details) & ~F.col("is_list") & r.isNotNull()
    notice = F.when(text_or_empty(r["parse_error"]) == "", CUT_BY_LENGTH).otherwise(r["parse_error"])
    return rows.withColumn("response", F.when(cut, r.withField("response_incomplete", F.lit(True)).withField("parse_error", notice)).otherwise(r))


def findings_of(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Findings of parsed responses: their vulnerabilities, submitted findings among their actions, and those of restored ones (salvaged)."""
    body = F.from_json("json", f"vulnerabilities array<struct<{FINDING.replace(' ', ':')}>>, actions array<struct<type:string, payload:struct<{FINDING.replace(' ', ':')}>>>".replace(",:", ", "), {"mode": "PERMISSIVE"})
    saved = F.from_json("restored", f"vulnerabilities array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>")["vulnerabilities"]
    empty = F.array().cast(f"array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>")
    submitted = F.transform(F.filter(F.coalesce("_b.actions", F.array().cast("array<struct<type:string,payload:struct<" + FINDING.replace(" ", ":").replace(",:", ",") + ">>>")), lambda a: (a["type"] == "submit_finding") & a["payload"].isNotNull()), lambda a: a["payload"])
    rows = parsed.withColumn("_b", body).withColumn("_s", saved)
    whole = F.concat(F.coalesce("_b.vulnerabilities", empty), submitted)
    out = rows.select(*keep, F.col("restored").isNotNull().alias("salvaged"), F.posexplode(F.concat(whole, F.coalesce("_s", empty))).alias("position", "f"))
    return out.select(*keep, "salvaged", "position", "f.*")


#: What is read of an architecture, and of a response: all of it as far as it is there, the rest null.
ARCHITECTURE = ("tech_stack:string", "framework:string", "database:string", "auth_mechanism:string", "routes:array<struct<method:string,path:string,handler:string,file_path:string,auth:string,params:array<string>,notes:string>>", "modules:array<string>")
RESPONSE = (
    "stage_summary string, architecture_info struct<" + ",".join(ARCHITECTURE) + ">, vulnerabilities array<struct<" + FINDING.replace(", ", ",").replace(" ", ":") + ">>, "
    "parse_error string, response_incomplete boolean, _salvaged boolean"
)


def typed(parsed: DataFrame, json_column: str = "json") -> DataFrame:
    """Adds ``response`` (RESPONSE, and has_architecture: whether that holds anything) and ``is_list``: whether the response is a list of findings by itself."""
    body = F.col(json_column)
    listed = F.coalesce(F.ltrim(body).startswith("["), F.lit(False))
    findings = F.from_json(body, "array<struct<" + FINDING.replace(", ", ",").replace(" ", ":") + ">>")
    about = F.get_json_object(body, "$.architecture_info")
    # An object without a key tells nothing, one with keys that aren't read here does.
    whole = F.from_json(body, RESPONSE, {"mode": "PERMISSIVE"}).withField("has_architecture", F.coalesce(about.startswith("{") & (about != "{}"), F.lit(False)))
    return parsed.withColumn("is_list", listed).withColumn("response", F.when(listed, whole.withField("vulnerabilities", findings)).otherwise(whole))


def response_score(response: Column, is_list: Column) -> Column:
    """How good a response is: 40 if it could be parsed, 30 if it is complete, 20 if it wasn't salvaged, 3 for each of eight findings and 1 more with a proof, 3 each for a summary and a description of the architecture that holds anything. A list has 10 and its length."""
    found = F.coalesce(response["vulnerabilities"], F.array().cast("array<struct<" + FINDING.replace(", ", ",").replace(" ", ":") + ">>"))
    first = F.slice(found, 1, 8)
    absent = lambda c: text_or_empty(c) == ""
    points = (
        F.when(absent(response["parse_error"]), 40).otherwise(0) + F.when(F.coalesce(response["response_incomplete"], F.lit(False)), 0).otherwise(30) + F.when(F.coalesce(response["_salvaged"], F.lit(False)), 0).otherwise(20)
        + 3 * F.size(first) + F.size(F.filter(first, lambda v: F.trim(text_or_empty(v["poc_raw"])) != "")) + F.when(F.trim(text_or_empty(response["stage_summary"])) != "", 3).otherwise(0)
        + F.when(response["has_architecture"], 3).otherwise(0)
    )
    return F.when(is_list, 10 + F.size(found)).when(response.isNull(), 0).otherwise(points)


#: How many findings an incomplete response of a stage keeps.
MOST_FINDINGS = {1: 0, 2: 4, 3: 4, 4: 4, 5: 3, 6: 5, 7: 3, 8: 3, 9: 3}
#: Longest texts of a finding, of a route and of the architecture in an incomplete response.
FINDING_CHARS = {"title": 160, "severity": 20, "vuln_type": 120, "file_path": 260, "code_snippet": 1200, "endpoint": 260, "poc_raw": 1500, "description": 1200, "fix_suggestion": 800, "confidence": 20}
ROUTE_CHARS = {"handler": 160, "file_path": 260, "auth": 40, "notes": 200}
SUMMARY_CHARS, ARCHITECTURE_CHARS = 1200, 200


def capped(responses: DataFrame) -> DataFrame:
    """Of rows (stage_num, response, is_list): incomplete responses cut to a bounded form, adds ``recovered``.

    A response is incomplete if it could not be parsed whole, breaks off or was salvaged; a
    list becomes the findings of an otherwise empty one. Findings and routes are the first
    few of the stage, their texts cut, lacking ones made '' or 0, routes without a path left
    out; a missing summary says that the response broke off.
    """
    r, text = F.col("response"), text_or_empty
    most = F.greatest(F.coalesce(F.create_map(*[F.lit(x) for kv in MOST_FINDINGS.items() for x in kv])[F.col("stage_num")], F.lit(3)), F.lit(1))
    most = F.when(F.col("stage_num") == 1, 3).otherwise(most)
    broken = (text(r["parse_error"]) != "") | F.coalesce(r["response_incomplete"], F.lit(False)) | F.coalesce(r["_salvaged"], F.lit(False))

    def finding(v: Column) -> Column:
        cut = {k: F.substring(text(v[k]), 1, n) for k, n in FINDING_CHARS.items()}
        cut["confidence"] = F.substring(F.when(text(v["confidence"]) == "", "medium").otherwise(v["confidence"]), 1, FINDING_CHARS["confidence"])
        lines = {k: F.coalesce(v[k], F.lit(0)) for k in ("line_start", "line_end")}
        return F.struct(*[({**cut, **lines}[c.split(" ")[0]]).alias(c.split(" ")[0]) for c in FINDING.split(", ")])

    def route(x: Column) -> Column:
        cut = {k: F.substring(text(x[k]), 1, n) for k, n in ROUTE_CHARS.items()}
        cut["auth"] = F.substring(F.when(text(x["auth"]) == "", "Unknown").otherwise(x["auth"]), 1, ROUTE_CHARS["auth"])
        params = F.slice(F.coalesce(x["params"], F.array().cast("array<string>")), 1, 6)
        return F.struct(F.upper(F.when(text(x["method"]) == "", "UNKNOWN").otherwise(x["method"])).alias("method"), F.trim(text(x["path"])).alias("path"), *[cut[k].alias(k) for k in ("handler", "file_path", "auth")], params.alias("params"), cut["notes"].alias("notes"))

    routes = F.filter(F.transform(F.slice(r["architecture_info"]["routes"], F.lit(1), F.least(F.lit(8), F.greatest(F.lit(2), most * 3))), route), lambda x: x["path"] != "")
    info = F.struct(*[F.substring(r["architecture_info"][k], 1, ARCHITECTURE_CHARS).alias(k) for k in ("tech_stack", "framework", "database", "auth_mechanism")], F.when(F.size(routes) > 0, routes).alias("routes"), F.lit(None).cast("array<string>").alias("modules"))
    said = F.trim(text(r["stage_summary"]))
    told = F.when(said == "", F.concat(F.lit("阶段"), F.col("stage_num").cast("string"), F.lit(" 模型响应出现截断，系统已根据可恢复字段整理为完整 JSON。"))).otherwise(said)
    kept = F.slice(F.coalesce(r["vulnerabilities"], F.array().cast("array<struct<" + FINDING.replace(", ", ",").replace(" ", ":") + ">>")), F.lit(1), most)
    small = r.withField("stage_summary", F.substring(told, 1, SUMMARY_CHARS)).withField("architecture_info", info).withField("vulnerabilities", F.transform(kept, finding))
    empty = r.withField("stage_summary", F.lit("")).withField("architecture_info", F.lit(None)).withField("has_architecture", F.lit(False)).withField("vulnerabilities", r["vulnerabilities"])
    return responses.withColumn("response", F.when(F.col("is_list"), empty).when(broken, small).otherwise(r)).withColumn("recovered", F.col("is_list") | broken)


HINT = "title string, name string, vuln_type string, type string, severity string, confidence string, description string, file_path string, line_start string, line_end string, endpoint string, code_snippet string, stage_nums array<int>, suggested_stage_nums array<int>"
MAX_HINTS = 40


def risk_hints(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Hints of first-stage responses (json): by, place, title, vuln_type, severity, confidence, description, file_path, stage_nums, n_merged.

    They are the entries of risk_hints, vulnerability_hints and vulnerabilities in this
    order, of a list its own; a text is a hint by itself, of lowest severity. Hints of one
    root cause are merged, and the first 40 of a response stay.
    """
    from .findings import merge_duplicates, normalize, root_cause

    lists = F.from_json("json", "risk_hints array<string>, vulnerability_hints array<string>, vulnerabilities array<string>", {"mode": "PERMISSIVE"})
    none = F.array().cast("array<string>")
    listed = F.coalesce(F.ltrim("json").startswith("["), F.lit(False))
    every = F.when(listed, F.coalesce(F.from_json("json", "array<string>"), none)).otherwise(F.concat(*[F.coalesce(lists[k], none) for k in ("risk_hints", "vulnerability_hints", "vulnerabilities")]))
    each = parsed.select(*by, F.posexplode(every).alias("seq", "item")).filter(F.trim("item") != "")
    is_object = F.ltrim("item").startswith("{")
    h = each.withColumn("_h", F.when(is_object, F.from_json("item", HINT))).withColumn("_text", F.when(~is_object, F.trim("item"))).select(*by, "seq", "_text", "_h.*")
    n = normalize(h)
    kind = F.when(is_placeholder("vuln_type"), "未验证风险线索").otherwise(F.col("vuln_type"))
    about = F.trim(text_or_empty("description"))
    title = F.when(~is_placeholder("title"), F.col("title")).when(~is_placeholder("vuln_type"), F.col("vuln_type")).when(~is_placeholder(about), F.substring(about, 1, 80)).otherwise("未命名风险线索")
    stages = F.array_distinct(F.filter(F.concat(F.coalesce("stage_nums", F.array().cast("array<int>")), F.coalesce("suggested_stage_nums", F.array().cast("array<int>"))), lambda x: x.between(2, 9)))
    is_text = F.col("_text").isNotNull()
    named = n.withColumns({"_title": title, "_kind": kind, "stage_nums": stages}).select(
        *by, F.col("seq").cast("long").alias("seq"), F.when(is_text, F.substring("_text", 1, 160)).otherwise(F.col("_title")).alias("title"), F.when(is_text, "未验证风险线索").otherwise(F.col("_kind")).alias("vuln_type"),
        F.when(is_text | (text_or_empty("severity") == ""), "Info").otherwise(severity("severity")).alias("severity"), F.when(is_text, "low").otherwise(confidence("confidence")).alias("confidence"),
        F.when(is_text, F.substring("_text", 1, 1000)).otherwise(F.col("description")).alias("description"), "file_path", "line_start", "line_end", "code_snippet", "endpoint", "stage_nums",
        F.lit(None).cast("string").alias("poc_raw"), F.lit(None).cast("string").alias("poc_validation_status"), F.lit(None).cast("string").alias("fix_suggestion"), F.lit(1).alias("stage_num"),
    )
    keyed = root_cause(named)
    stages_of = keyed.groupBy(*by, "dedupe_key").agg(F.min(F.when(F.size("stage_nums") > 0, F.struct("seq", "stage_nums")))["stage_nums"].alias("stage_nums"))
    merged = merge_duplicates(keyed.drop("stage_nums"), (*by, "dedupe_key")).join(stages_of, [*by, "dedupe_key"])
    out = top(merged, by, [F.col("first_seq")], MAX_HINTS, "place")
    return out.select(*by, "place", "title", "vuln_type", "severity", "confidence", "description", "file_path", F.coalesce("stage_nums", F.array().cast("array<int>")).alias("stage_nums"), "n_merged")


def best_attempt(attempts: DataFrame, by: list[str]) -> DataFrame:
    """The attempt of the highest score; of equals the later."""
    rest = [c for c in attempts.columns if c not in by]
    return attempts.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("score", "attempt")).alias("_a")).select(*by, "_a.*")
