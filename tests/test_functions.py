"""Golden pairs of the column functions."""

import json

import pytest
from pyspark.sql import functions as F

from auditloom.functions import paths, severity, text
from auditloom.operators import coverage, findings, graph, planning, responses, scan


def value(spark, column, **data):
    names = list(data)
    rows = [tuple(data.values())]
    schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in data.items())
    return spark.createDataFrame(rows, schema).select(column.alias("v")).first()["v"] if names else None


@pytest.mark.parametrize(("fn", "given", "expected"), [
    (paths.route_match_path, "/users/123/posts/:id", "/users/{id}/posts/{id}"), (paths.route_match_path, "/items/<itemId>", "/items/{id}"), (paths.route_match_path, "/a /b", "/a/b"),
    (paths.endpoint_anchor, "GET /api/users/123", "GET /api/users/{id}"), (paths.endpoint_anchor, "POST /items/abc123def45678", "POST /items/abc123def45678".replace("abc123def45678", "{id}")),
    (paths.endpoint_anchor, "/x", "UNKNOWN /x"), (paths.endpoint_anchor, "", ""), (paths.file_anchor, "a/b/c/d/e/f.py", "c/d/e/f.py"), (paths.route_path, "a//b/", "/a/b"), (paths.route_path, "", "/"),
    (paths.match_path, "App\\Auth.py", "app/auth.py"), (paths.archive_member, "a\\.\\b.py", "a/b.py"), (paths.archive_member, "../x", None),
    (severity.severity, "", "Medium"), (severity.severity, "严重", "Critical"), (severity.severity, "高", "High"), (severity.severity, "informational", "Info"), (severity.severity, "bogus", "Medium"),
    (severity.severity_rank, "Critical", 5), (severity.severity_rank, "weird", 0), (severity.confidence, None, "medium"), (severity.confidence, "HIGH", "high"),
    (severity.coverage_status, "covered", "audited_no_finding"), (severity.coverage_status, "", "audited_no_finding"), (severity.coverage_status, "need_followup", "needs_followup"), (severity.coverage_status, "vulnerable", "finding"),
    (text.strip_comments, "a /* b */ c // d", "a   c  "), (paths.auth_kind, "uses jwt here", "JWT"), (paths.auth_kind, "nothing", "None"), (text.is_placeholder, " N/A ", True), (text.is_placeholder, "x", False),
])
def test_canonical_forms(spark, fn, given, expected):
    assert value(spark, fn(F.col("x")), x=given) == expected


def test_route_id(spark):
    row = spark.createDataFrame([("GET", "/api/login", "login", "app/auth.py")], "method string, path string, handler string, file_path string")
    assert coverage.with_route_id(row).first()["route_id"] == "rt_7d9cf59e8220"


@pytest.mark.parametrize(("statuses", "expected"), [(["audited", "confirmed"], "confirmed_finding"), (["insufficient_context"], "needs_followup"), ([], "missing")])
def test_status_ladder(spark, statuses, expected):
    assert value(spark, severity.status_of_route(F.col("s")), s=statuses) == expected


def test_lines_and_evidence(spark):
    df = spark.createDataFrame([("a\r\nb\nKey here\nc\nd\n",)], "t string").withColumn("l", text.split_lines("t"))
    row = df.select("l", text.first_hit_window(F.col("l"), ["key"], 1).alias("w")).first()
    assert row["l"] == ["a", "b", "Key here", "c", "d"] and row["w"] == "b\nKey here\nc"


def test_pack_lines():
    parts = scan.pack_lines("x = 1\n" * 500, 100)
    assert len(parts) > 1 and all(len(t) <= 100 for _, _, t in parts) and "\n".join(t for _, _, t in parts) == "x = 1\n" * 500
    assert scan.pack_lines("a" * 50 + "\nb", 10) == [(1, 1, "a" * 50), (2, 2, "b")]


def test_risk_labels(spark):
    df = spark.createDataFrame([("app/run.py", "import os\nos.system('rm -rf x')\nexec(user_input)\n")], "base_file_path string, content string")
    assert "rce" in scan.with_risk(df).first()["risk_labels"]


def test_coverage_of_three_routes(spark):
    routes = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "task_id long, route_id string")
    items = coverage.coverage_items(spark.createDataFrame([(1, 3, "a", "audited_no_finding", ""), (1, 3, "b", "insufficient_context", "")], "task_id long, stage_num int, route_id string, status string, reason string"))
    focus = spark.createDataFrame([(1, 3, "a"), (1, 3, "b")], "task_id long, stage_num int, route_id string")
    none = spark.createDataFrame([], "task_id long, stage_num int, matched_route_id string")
    by_route = coverage.coverage_by_route(routes, items, none)
    stages = coverage.stage_coverage(items, focus)
    scanned = spark.createDataFrame([(1, 3)], "task_id long, route_count int")
    s = coverage.coverage_summary(by_route, stages, scanned).first()
    assert (s["total_routes"], s["audited_route_count"], s["missing_route_count"], s["unattested_route_count"], s["attested_gap_route_count"]) == (3, 1, 2, 1, 1)
    g = stages.first()
    assert (g["unattested_focus_route_count"], g["gap_focus_route_count"]) == (0, 1)
    assert {r["route_id"]: r["gap_reason"] for r in by_route.collect()} == {"a": None, "b": "attested_but_not_audited", "c": "not_model_attested"}


@pytest.mark.parametrize(("evidence", "most", "check"), [
    ([3], None, lambda s: s == {2, 3, 7, 9}), ([], None, lambda s: s == {2, 7, 9}), ([3, 4, 5, 6, 8], 5, lambda s: {2, 7, 9} <= s and len(s) <= 5), ([3, 4, 5, 6, 8], 9, lambda s: s == set(range(2, 10))),
])
def test_plans(spark, evidence, most, check):
    projects = spark.createDataFrame([("p",)], "project string")
    signals = spark.createDataFrame([("p", evidence)], "project string, stage_nums array<int>")
    out = planning.plan(projects, planning.stage_evidence(signals), most).filter("selected").collect()
    assert check({r["stage_num"] for r in out})


FINDING = "task_id long, seq long, stage_num int, title string, severity string, vuln_type string, file_path string, line_start int, line_end int, code_snippet string, endpoint string, poc_raw string, poc_validation_status string, description string, fix_suggestion string, confidence string, salvaged boolean"


def finding(**kw):
    base = dict(task_id=1, seq=1, stage_num=3, title="SQLi", severity="High", vuln_type="sqli", file_path="a.py", line_start=None, line_end=None, code_snippet=None, endpoint=None, poc_raw=None, poc_validation_status=None, description=None, fix_suggestion=None, confidence=None, salvaged=False)
    return tuple((base | kw).values())


def test_gate(spark):
    rows = [finding(seq=1), finding(seq=2, file_path=""), finding(seq=3, salvaged=True), finding(seq=4, stage_num=5, file_path="frontend/src/api/user.js"), finding(seq=5, title="unknown")]
    out = spark.createDataFrame(rows, FINDING).select("seq", findings.rejection_reason().alias("r")).collect()
    assert {r["seq"]: r["r"] for r in out} == {1: None, 2: "no_location", 3: "salvaged", 4: "frontend_only", 5: "no_title"}


def test_families_and_lines(spark):
    rows = [finding(seq=1, title="SQL 注入"), finding(seq=2, title="水平越权 IDOR", vuln_type="x"), finding(seq=3, line_start=10), finding(seq=4, line_start=20)]
    out = {r["seq"]: r for r in findings.root_cause(spark.createDataFrame(rows, FINDING)).collect()}
    assert out[1]["family"] == "sql_injection" and out[2]["family"] == "authorization_bypass"
    assert out[3]["dedupe_key"] != out[4]["dedupe_key"] and len(out[3]["dedupe_key"]) == 32


def test_merge_of_two(spark):
    rows = [finding(seq=1, line_start=5, code_snippet="x = 1"), finding(seq=2, line_start=5, severity="Critical", endpoint="GET /a", poc_raw="GET /a HTTP/1.1", poc_validation_status="valid")]
    m = findings.merge_duplicates(findings.root_cause(spark.createDataFrame(rows, FINDING))).first()
    assert (m["severity"], m["code_snippet"], m["endpoint"], m["poc_validation_status"], m["n_merged"]) == ("Critical", "x = 1", "GET /a", "valid", 2)


def test_line_bounds(spark):
    lo, hi = findings.line_bounds(F.col("a"), F.col("b"), F.col("c"))
    cases = {("L12-34", None, None): (12, 34), (None, None, "7~3"): (3, 7), ("x", None, "L5"): (5, None), (None, "9", None): (9, 9), ("20", "10", None): (10, 20)}
    for given, expected in cases.items():
        row = spark.createDataFrame([given], "a string, b string, c string").select(lo.alias("lo"), hi.alias("hi")).first()
        assert (row["lo"], row["hi"]) == expected, given


def test_reviews_attach_by_id(spark):
    f = spark.createDataFrame([("finding-a", 0), ("finding-b", 1)], "id string, position int")
    r = spark.createDataFrame([(9, "finding-a", "confirmed", 1)], "finding_index int, finding_id string, verification_status string, seq int")
    assert {x["id"]: x["verification_status"] for x in findings.attach_reviews(f, r).collect()} == {"finding-a": "confirmed", "finding-b": None}


def test_json_salvage():
    assert responses.best_json('noise {"a": "}"} tail') == '{"a": "}"}'
    assert responses.best_json("nothing") is None
    assert responses.salvage('{"vulnerabilities": [{"t": 1}, {"t": 2}, {"t"') == '[{"t": 1}, {"t": 2}]'


CUT = '{"stage_summary": "all\\nof it", "architecture_info": {"framework": "x", "routes": [{"path": "/a"}]}, "vulnerabilities": [{"title": "a", "line_start": 3}, {"title": "b", "severity": "Hi'


def test_broken_responses_keep_all_that_is_there():
    got = responses.recovered(CUT)
    assert (got["stage_summary"], got["architecture_info"]) == ("all\nof it", {"framework": "x", "routes": [{"path": "/a"}]})
    assert [(f["title"], f.get("severity"), f.get("line_start")) for f in got["vulnerabilities"]] == [("a", None, 3), ("b", "Hi", None)]
    assert got["response_incomplete"] and got["vulnerabilities"][1]["vuln_type"] == "未分类漏洞" and got["vulnerabilities"][1]["poc_raw"]
    # An architecture that breaks off keeps its four texts, and speaks for a missing summary.
    got = responses.recovered('{"architecture_info": {"tech_stack": "py", "routes": [{"path": "/a"}], "database": "pg')
    assert got["architecture_info"] == {"tech_stack": "py", "database": "pg"} and got["stage_summary"] == "项目架构概要（从截断响应中恢复）：技术栈：py；数据库：pg。"
    # A finding with a fault keeps its fields and ends the list; one that tells nothing is none.
    got = responses.recovered('{"vulnerabilities": [{"title": "a"}, {"title": "b" "line_start": 12, "severity": "Low"}, {"title": "c"}')
    assert [(f["title"], f.get("line_start")) for f in got["vulnerabilities"]] == [("a", None), ("b", 12)]
    assert responses.recovered('{"vulnerabilities": [{"severity": "High", "code_snippet": "x') is None
    # Without the outer braces, with fields where an object should be, with an escape cut in two, with a line that ends within a text.
    assert responses.recovered('"vulnerabilities": [{"title": "t\\') ["vulnerabilities"][0]["title"] == "t\\"
    assert responses.recovered('{"vulnerabilities": ["title": "t", "severity": "Low"')["vulnerabilities"][0]["title"] == "t"
    assert responses.recovered('{"stage_summary": "one\ntwo')["stage_summary"] == "one"
    assert responses.recovered("[" * 50_000 + '{"stage_summary": "deep') ["stage_summary"] == "deep"
    assert responses.recovered("") is None and responses.recovered("prose: nothing } here ]") is None


def test_every_cut_is_read_and_tells_no_more_than_the_whole():
    whole = json.dumps({"stage_summary": "é \" quoted\\ {[", "architecture_info": {"framework": "a}b", "routes": [{"path": "/x"}]}, "vulnerabilities": [{"title": "t1", "description": "d, }]"}, {"title": "t2", "line_start": 77}]}, ensure_ascii=False)
    seen = 0
    for n in range(len(whole)):
        got = responses.recovered(whole[:n]) or {"vulnerabilities": [], "stage_summary": ""}
        assert len(got["vulnerabilities"]) >= seen and "é \" quoted\\ {[".startswith(got["stage_summary"].rstrip("\\"))  # half an escape stays as it stands
        seen = len(got["vulnerabilities"])
        assert all("t1".startswith(f["title"]) or "t2".startswith(f["title"]) for f in got["vulnerabilities"])
    assert seen == 2


def test_best_json_takes_a_list_only_where_no_object_ends():
    assert responses.best_json('see ["a", "b"] there') == '["a", "b"]'
    assert responses.best_json('{"s": "x", "tags": ["a"]') == '["a"]'
    assert responses.best_json('{"architecture_info": {"routes": [{"path": "/a"}]}, "vulnerabilities": [{"t') is None


def test_what_writers_tell_of_cuts(spark):
    rows = [(1, '{"stage_summary": "s"}', "LENGTH", None, None), (2, '{"parse_error": "p"}', None, "incomplete", None), (3, '{"stage_summary": "s"}', "stop", "completed", " Max_Tokens "), (4, '{"stage_summary": "s"}', "stop", None, None), (5, "[]", "length", None, None), (6, "nothing }", None, None, None), (7, '{"architecture_info": {}, "vulnerabilities": []}', None, None, None), (8, '{"architecture_info": {"other": 1}}', None, None, None)]
    df = spark.createDataFrame(rows, "id int, content string, finish_reason string, response_status string, incomplete_reason string")
    out = responses.annotated(responses.typed(responses.parse(df), "response_json"))
    got = {r["id"]: (r["response"]["response_incomplete"], r["response"]["parse_error"], r["s"], r["content"]) for r in out.withColumn("s", responses.response_score(F.col("response"), F.col("is_list"))).collect() if r["id"] != 5}
    assert got[1][:3] == (True, "模型响应因输出长度限制被截断", 23) and got[2][:3] == (True, "p", 20) and got[3][:2] == got[1][:2] and got[4][:3] == (None, None, 93)
    assert got[6] == (False, "无法从模型响应中提取 JSON", 50, "nothing }") and got[7][2] == 90 and got[8][2] == 93


def test_response_states(spark):
    good = '{"vulnerabilities": [{"title": "T", "severity": "High"}], "actions": [{"type": "submit_finding", "payload": {"title": "S"}}]}'
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, f"see: {good}!"), (4, '{"vulnerabilities": [{"title": "T", "severity": "High"}, {"ti'), (5, "garbage"), (6, None)]
    parsed = responses.parse(spark.createDataFrame(rows, "id int, content string"))
    assert {r["id"]: r["parse_state"] for r in parsed.collect()} == {1: "clean", 2: "clean", 3: "extracted", 4: "salvaged", 5: "parse_error", 6: "parse_error"}
    titles = [(r["id"], r["title"]) for r in responses.findings_of(parsed, ["id"]).orderBy("id", "position").collect()]
    assert titles[:2] == [(1, "T"), (1, "S")]


def test_prefixes_end_on_cycles(spark):
    m = spark.createDataFrame([("p", "a", "b", "/x"), ("p", "b", "a", "/y"), ("p", "a", "c", "/long"), ("p", "a", "c", "/l")], "project string, src string, dst string, prefix string")
    roots = spark.createDataFrame([("p", "a", "")], "project string, file string, prefix string")
    out = {r["file"]: r["prefix"] for r in graph.propagate_prefixes(m, roots, lambda a, b: F.concat(a, b)).collect()}
    assert out == {"a": "", "b": "/x", "c": "/l"}


def test_prefixes_reach_the_end_of_long_chains(spark):
    m = spark.createDataFrame([("p", f"f{i:02}", f"f{i + 1:02}", "/x") for i in range(21)] + [("p", "f21", "f20", "/y"), ("q", "f00", "f21", "/z")], "project string, src string, dst string, prefix string")
    roots = spark.createDataFrame([("p", "f00", ""), ("q", "f00", "")], "project string, file string, prefix string")
    out = {(r["project"], r["file"]): r["prefix"] for r in graph.propagate_prefixes(m, roots, lambda a, b: F.concat(a, b)).collect()}
    assert out == {("p", f"f{i:02}"): "/x" * i for i in range(22)} | {("q", "f00"): "", ("q", "f21"): "/z"}


def test_views(spark, tmp_path):
    from auditloom.plans import views

    rows = [finding(seq=1, line_start=5, line_end=9), finding(seq=2, severity="严重", title="<b>"), finding(seq=3, stage_num=1), finding(seq=4)]
    df = spark.createDataFrame(rows, FINDING).withColumn("review_status", F.when(F.col("seq") == 4, "rejected"))
    assert [r["seq"] for r in views.list_findings(df, None, None, 0).collect()] == [2, 4, 1]
    assert [r["seq"] for r in views.list_findings(df, "critical").collect()] == [2] and [r["seq"] for r in views.page(df, [F.col("seq")], 2, 2).collect()] == [3, 4]
    html = views.report_html(df, 1)
    assert "1 rejected" in html and "a.py:L5-9" in html and "&lt;b&gt;" in html
    views.write_artifacts(df.select("stage_num", "title"), "stage_num", f"file://{tmp_path}/a")
    assert spark.read.text(f"file://{tmp_path}/a").count() == 4
