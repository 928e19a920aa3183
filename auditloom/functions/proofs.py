"""Column functions on proofs of concept: what kind a finding needs, and whether one is well-formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import ENDPOINT, http_path
from .text import contains_any, count_present, fixed, is_ascii, text_or_empty

#: Markers of the kinds of proof, in order of precedence.
NONE = (
    "硬编码", "hardcoded", "hard code", "hard-coded", "api key", "access key", "private key", "secret key", "hardcoded secret", "ak/sk", "弱密码哈希", "无盐", "无盐 md5", "无盐md5", "weak md5",
    "weak sha1", "密码哈希", "哈希算法", "无需 poc", "无需poc", "code evidence only",
)
CLI = ("配置", "config", "信息泄露", "debug", "日志泄露", "目录索引", "directory listing", ".env", "env 泄露", "stack trace", "依赖", "dependency", "版本泄露")
STEPWISE = (
    "业务逻辑", "logic bypass", "竞态", "race", "会话固定", "session fixation", "暴力破解", "brute force", "越权", "idor", "权限绕过", "水平越权", "垂直越权", "支付绕过", "下载绕过", "流程绕过", "状态机", "多步",
)
RAW_HTTP = (
    "sqli", "nosqli", "注入", "rce", "命令执行", "command execution", "ssrf", "xss", "文件上传", "文件下载", "路径穿越", "目录遍历", "任意文件", "反序列化", "模板注入", "表达式注入",
)
STEP_WORDS = ("步骤", "复现", "攻击流程", "利用流程", "先 ", "然后", "再 ", "最后", "登录后")
COMMANDS = (
    "curl ", "wget ", "httpie ", "grep ", "findstr ", "cat ", "type ", "php ", "python ", "node ", "diff ", "git diff", "printenv", "set ", "export ", ".env", "配置", "环境变量", "日志", "堆栈",
)
#: Marks of output, and how a step and a request begin.
OUTPUT = ("=>", "BEGIN", "END", "---", "+++", "@@")
_STEP = r"(?i)^(\d+[.)、]|步骤\s*[一二三四五六七八九十0-9]+[：:]?|step\s*\d+[：:]?)"
_REQUEST = r"(?i)^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|TRACE|CONNECT)\s+(\S+)\s+HTTP/1\.[01]$"


#: Texts that a finding's kind of proof is told by, and the kinds that stages take where these tell nothing.
TEXTS = ("title", "vuln_type", "description", "fix_suggestion", "endpoint", "file_path", "poc_raw")
STAGE_KINDS = {1: "none", 2: "raw_http", 3: "raw_http", 4: "raw_http", 5: "stepwise", 6: "stepwise", 7: "cli", 8: "raw_http", 9: "stepwise"}


def with_proof(findings: DataFrame) -> DataFrame:
    """Adds proof_kind (none, cli, stepwise or raw_http: what the finding needs, by what it says, else by its stage) and proof_accepted (whether its proof is of that kind; a request is good for any)."""
    hay = fixed(findings, _hay=F.lower(F.concat_ws(" ", *[text_or_empty(c) if c in findings.columns else F.lit("") for c in TEXTS])))
    # Two kinds a step, and what a request is read from once: a step that is too long is not compiled.
    hay = fixed(hay, _plain=is_ascii("_hay"))
    one = fixed(hay, _kind=F.when(contains_any("_hay", NONE, "_plain"), "none").when(contains_any("_hay", CLI, "_plain"), "cli"))
    two = fixed(one, _other=F.when(F.col("_kind").isNull(), F.when(contains_any("_hay", STEPWISE, "_plain"), "stepwise").when(contains_any("_hay", RAW_HTTP, "_plain"), "raw_http")))
    by_stage = F.create_map(*[F.lit(x) for kv in STAGE_KINDS.items() for x in kv])[F.col("stage_num")]
    read = fixed(two, proof_kind=F.coalesce("_kind", "_other", by_stage, F.lit("raw_http")), _may=F.contains(F.lower(text_or_empty("poc_raw")), F.lit("http/1."))).drop("_hay", "_plain", "_kind", "_other")
    lines = fixed(read, _lines=F.when(F.col("_may"), _lines("poc_raw")))
    told = fixed(lines, _request=F.when(F.col("_may"), _request(F.col("_lines"))["valid"]).otherwise(False)).drop("_may", "_lines")
    needed = F.col("proof_kind")
    ok = F.when(needed == "none", True).when(F.col("_request") | (needed == "raw_http"), F.col("_request")).when(needed == "stepwise", is_stepwise("poc_raw")).otherwise(is_command("poc_raw"))
    return fixed(told, proof_accepted=ok).drop("_request")


def is_stepwise(poc: Column | str) -> Column:
    """Two lines or more, with a numbered step or two words of a procedure."""
    t = F.trim(text_or_empty(poc))
    lines = F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    step = F.exists(lines, lambda x: x.rlike(_STEP))
    return (F.size(lines) >= 2) & (step | (count_present(F.lower(t), STEP_WORDS) >= 2))


def is_command(poc: Column | str) -> Column:
    t = text_or_empty(poc)
    return contains_any(F.lower(t), COMMANDS) | contains_any(t, OUTPUT)


def raw_request(poc: Column | str) -> Column:
    """struct(valid, method, target, host) of a raw HTTP request: a request line, then headers up to a blank line, a host among them."""
    return _request(_lines(poc))


def _lines(poc: Column | str) -> Column:
    return F.transform(F.split(text_or_empty(poc), r"\r?\n"), lambda x: F.rtrim(x))


def _first_line(lines: Column) -> Column:
    return F.trim(F.element_at(F.filter(F.concat(lines, F.array(F.lit(" "))), lambda x: x != ""), 1))


def _request(lines: Column) -> Column:
    first = _first_line(lines)
    blank = F.array_position(F.slice(lines, F.lit(2), F.size(lines)), "")
    headers = F.slice(lines, F.lit(2), F.when(blank > 0, (blank - 1).cast("int")).otherwise(F.size(lines)))
    named = F.filter(headers, lambda h: h.contains(":"))
    host = F.coalesce(F.get(F.transform(F.filter(named, lambda h: F.lower(h).rlike(r"^\s*host\s*:")), lambda h: F.trim(F.regexp_replace(h, "^[^:]*:", ""))), 0), F.lit(""))
    leading = F.coalesce(F.get(headers, 0).contains(":"), F.lit(False))
    ok = first.rlike(_REQUEST) & leading & (host != "")
    return F.struct(ok.alias("valid"), F.upper(F.regexp_extract(first, _REQUEST, 1)).alias("method"), F.regexp_extract(first, _REQUEST, 2).alias("target"), host.alias("host"))


def request_matches(endpoint: Column, request: Column) -> Column:
    """Whether a request (struct of raw_request) is one to an endpoint: the same verb, unless it is for any, and a path that is equal, inside the other or, for any verb, ends alike."""
    verb = F.upper(F.regexp_extract(F.trim(text_or_empty(endpoint)), ENDPOINT, 1))
    path = http_path(F.when(verb != "", F.regexp_extract(F.trim(endpoint), ENDPOINT, 2)).otherwise(endpoint))
    asked, any_verb = http_path(request["target"]), verb.isin("", "ANY")
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    near = (path == asked) | ((path != "") & (asked != "") & (F.contains(path, asked) | F.contains(asked, path))) | (any_verb & (tail(path) != "") & (tail(path) == tail(asked)))
    return (verb.isin("", "ANY", "UNKNOWN") | (verb == request["method"])) & near


def request_text(method: Column, path: Column, params: Column, auth: Column) -> Column:
    """A raw request made from a route: parameters of the path filled with 1, a header by its auth, and a form body for verbs that write."""
    filled = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\{[^/}]+\}", "1"), r"<[^/>]+>", "1"), r"/:[^/]+", "/1")
    body = F.array_join(F.transform(F.coalesce(params, F.array().cast("array<string>")), lambda p: F.concat(p, F.lit("=1"))), "&")
    verb = F.when(F.upper(method).isin("ANY", "UNKNOWN", ""), "GET").otherwise(F.upper(method))
    writes = verb.isin("POST", "PUT", "PATCH")
    header = F.when(F.lower(auth) == "jwt", "\nAuthorization: Bearer TOKEN").when(F.lower(auth).isin("session", "unknown"), "\nCookie: session=SESSION").otherwise("")
    return F.concat(verb, F.lit(" "), filled, F.when(~writes & (body != ""), F.concat(F.lit("?"), body)).otherwise(""), F.lit(" HTTP/1.1\nHost: target.example"), header, F.when(writes & (body != ""), F.concat(F.lit("\nContent-Type: application/x-www-form-urlencoded\n\n"), body)).otherwise(""))
