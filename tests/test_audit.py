"""Rules, routes, responses, gates and run states on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from auditloom.functions import proofs, rules, text
from auditloom.functions.rules import ACCEPT, ALL_RULES, DEFAULT_RULES
from auditloom.operators import coverage, findings, gate, planning, responses, routes, rule_hits, scan
from auditloom.plans import summaries
from auditloom.sources import project_dir
from auditloom.streaming import follow, state

from .test_functions import FINDING, finding


def plain_accept(label, path, evidence, hits):
    """What stands, said in plain words for each label."""
    p, e = path.lower(), evidence.lower()
    has, at = (lambda *m: any(x in e for x in m)), (lambda *m: any(x in p for x in m))
    if "/lang/" in p:
        return label == "config"
    if label in ("file", "business") and p.endswith((".json", ".md", ".txt", ".yml", ".yaml", ".xml")):
        return False
    if label == "file":
        return has("fopen(", "unlink(", "copy(") or (hits >= 2 and at("upload", "file", "path"))
    if label == "business":
        return hits >= 2 and at("order", "cart")
    if label == "config":
        return not p.endswith(".sql") and not has("getrandomstring(") and has("secret", "api_key") and (at("config", "settings", "secret", "verify", "admin/index.php") or has("md5(", "secret="))
    if label == "auth":
        if p.endswith(".sql") or not at("login", "auth", "user", "admin"):
            return False
        if at("/user.php", "/index.php") and not has("login", "logout", "setcookie"):
            return False
        if at("/index.php") and not has("setcookie", "password", "captcha"):
            return False
        if has("session_start();") and not has("password", "jwt", "setcookie"):
            return False
        return has("login", "logout", "setcookie", "jwt") or (has("role") and has("captcha"))
    if label == "xss":
        return not at(".css", ".json") and has("innerhtml", "<script") and at("view", "html", "front", "admin", "session", "login") and (has("request.", "input", "$msg") or (has("location.href") and has("redirect=")))
    return True


def test_acceptance(spark):
    """Every label with many paths and evidences, against plain words."""
    paths = ("a/upload.php", "order/cart.py", "config/settings.py", "x/login.py", "admin/user.php", "admin/index.php", "v/view.html", "v/view.css", "x/lang/en.php", "a.json", "b.sql", "other.c", "auth/q.sql")
    evidences = ("fopen(x)", "secret = 1", "api_key md5(x)", "getrandomstring( secret", "login()", "setcookie(1)", "session_start();", "session_start(); setcookie", "jwt", "role captcha", "x.innerHTML = input", "<script location.href redirect=", "<script", "nothing")
    rows = [(label, p, e, n) for label in (*ACCEPT, "rce") for p in paths for e in evidences for n in (1, 2)]
    df = text.fixed(spark.createDataFrame(rows, "label string, p string, e string, n int"), lp=F.lower("p"), le=F.lower("e"))
    got = df.select("label", "p", "e", "n", rule_hits.accepted(F.col("label"), "lp", "le", F.col("n")).alias("ok")).collect()
    wrong = [(r["label"], r["p"], r["e"], r["n"], r["ok"]) for r in got if r["ok"] != plain_accept(r["label"], r["p"], r["e"], r["n"])]
    assert not wrong


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"ssrf": {"hits": ["curl_exec", "curl_exec", "fetch("], "strong": ["curl_exec"], "medium": ["fetch("], "min_weight": 3}}))
    rule = rules.load_rules(str(tmp_path / "r.json"))
    chunks = spark.createDataFrame([("p", 1, "a.php", "a.php", "full", "x\ncurl_exec($u)\n", 5, ["ssrf"])], "project string, chunk_ordinal int, file_path string, base_file_path string, chunk_type string, content string, risk_score int, risk_labels array<string>")
    hit = rule_hits.rule_hits(chunks, rule).first()
    assert (hit["keyword_hit_count"], hit["weighted_score"], hit["stage_nums"], hit["title"], hit["risk_score"], hit["evidence"]) == (2, 3.0, [2, 3], "ssrf 信号", 5 + 9 + 4, "x\ncurl_exec($u)")
    assert len(ALL_RULES) == len(DEFAULT_RULES) + 3
    risky = scan.with_risk(spark.createDataFrame([("a.py", "requests.get(url); hashlib.md5(x); lxml.etree")], "base_file_path string, content string"), rules.ALL_KEYWORDS)
    assert {"ssrf", "xxe", "crypto"} <= set(risky.first()["risk_labels"])


def test_placeholders_are_no_titles(spark):
    rows = [finding(seq=i, title=t) for i, t in enumerate(("未命名漏洞", "未分类漏洞", "N/A", "未知", "SQLi"))]
    out = spark.createDataFrame(rows, FINDING).select("seq", findings.rejection_reason().alias("r")).collect()
    assert {r["seq"]: r["r"] for r in out} == {0: "no_title", 1: "no_title", 2: "no_title", 3: None, 4: None}


def test_best_routes(spark):
    rows = [(1, "GET", "/api/users", "app/users.py"), (1, "POST", "/login", "app/auth.py"), (1, "ANY", "/any", "app/any.py"), (3, "GET", "/", "app/root.py"), (3, "GET", "/api", "app/api.py"), (2, "GET", "/only", "app/one.py"), (2, "PUT", "/two/a", "app/two.py"), (2, "PUT", "/two/b", "app/two.py")]
    r = coverage.with_route_id(spark.createDataFrame([(t, m, p, "h", f, "None") for t, m, p, f in rows], "task_id long, method string, path string, handler string, file_path string, auth string"))
    # A path inside another need not begin it; '/' lies inside every path and comes first of equals; without points the only route of a file.
    asks = [
        (1, 1, "", "GET", "/api/users/list/all", "/api/users", 16), (1, 2, "users.py", "GET", "http://h/api/users?x=1", "/api/users", 34), (1, 3, "", "DELETE", "/nowhere", "/any", 2), (1, 4, "", "POST", "/x", "/login", 6),
        (1, 5, "", "UNKNOWN", "/users", "/api/users", 10), (1, 6, "", "UNKNOWN", "/us", "/api/users", 10), (1, 7, "", "UNKNOWN", "/sers", None, None), (2, 8, "app/one.py", "UNKNOWN", "", "/only", None), (2, 9, "app/two.py", "UNKNOWN", "", None, None),
        (2, 10, "two.py", "PUT", "/q/b", "/two/b", 18), (2, 11, "", "", "/v1/two/a", "/two/a", 10), (3, 12, "", "GET", "/api/x", "/", 16), (3, 13, "", "GET", "/api", "/api", 26),
    ]
    df = spark.createDataFrame([a[:5] for a in asks], "task_id long, seq long, file_path string, method string, path string")
    path_of = {x["route_id"]: x["path"] for x in r.collect()}
    got = {x["seq"]: (path_of.get(x["best_route_id"]), x["best_score"]) for x in coverage.best_route(df, r).collect()}
    assert got == {a[1]: (a[5], a[6]) for a in asks}


def test_response_points(spark):
    full = {"stage_summary": "s", "architecture_info": {"framework": "x"}, "vulnerabilities": [{"title": "a", "poc_raw": "p"}, {"title": "b"}]}
    rows = [(1, json.dumps(full)), (2, json.dumps(full | {"_salvaged": True})), (3, json.dumps([{"title": "a"}])), (4, json.dumps({"parse_error": "x", "response_incomplete": True})), (5, None)]
    df = responses.typed(spark.createDataFrame(rows, "id int, json string"))
    got = {r["id"]: r["s"] for r in df.select("id", responses.response_score(F.col("response"), F.col("is_list")).alias("s")).collect()}
    assert got == {1: 40 + 30 + 20 + 6 + 1 + 3 + 3, 2: 40 + 30 + 6 + 1 + 3 + 3, 3: 11, 4: 20, 5: 0}


def test_lists_that_break_off():
    assert responses.list_objects('{"a": [{"x": 1}, {"y": {"z": [2]}}, {"w": "br', "a") == [{"x": 1}, {"y": {"z": [2]}}]
    assert responses.list_objects('{"a": [{"x": 1}, {bad}, {"y": 2}], "b": [{"n": 3}]}', "a") == [{"x": 1}, {"y": 2}]
    assert responses.list_objects('{"a": [], "b": [{"n": 3}]}', "a") == [] and responses.list_objects("", "a") == []


def test_handlers_in_other_files(spark):
    files = [("p", 1, "a/urls.py", "from a import views\nfrom a.extra import *\nurlpatterns = [path('x', views.x), path('y', y), path('z', views.late)]\n"), ("p", 0, "a/views.py", "def x(request):\n    return request.GET.get('q') or request.POST['w']\n\nOTHER = request.args.get('no')\n"), ("p", 0, "a/extra.py", "async def y(request):\n    jwt.decode(1)\n")]
    df = spark.createDataFrame([(*f, len(f[3])) for f in files], "project string, ordinal long, path string, content string, size long")
    got = {r["path"]: (r["params"], r["auth"], r["handler_file_path"]) for r in routes.enrich_handlers(routes.extract_routes(df), df).collect()}
    assert got == {"/x": (["q", "w"], "None", "a/views.py"), "/y": ([], "JWT", "a/extra.py"), "/z": ([], "None", None)}


def test_request_of_an_endpoint(spark):
    cases = [("GET /a/b", "GET /a/b?x=1 HTTP/1.1\nHost: h", True), ("POST /a", "GET /a HTTP/1.1\nHost: h", False), ("/x/a", "GET /a HTTP/1.1\nHost: h", True), ("GET /z", "GET /a HTTP/1.1\nHost: h", False), ("ANY /q/a", "GET /b/a HTTP/1.1\nHost: h", True)]
    df = spark.createDataFrame([(i, e, p) for i, (e, p, _) in enumerate(cases)], "i int, e string, p string")
    got = {r["i"]: r["m"] for r in df.select("i", proofs.request_matches(F.col("e"), proofs.raw_request("p")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_budget_of_a_large_group(spark):
    rows = [("p", i, "x" * (i % 7)) for i in range(500)] + [("q", i, "y" * 50) for i in range(3)]
    df = spark.createDataFrame(rows, "project string, ordinal long, content string")
    got = {(r["project"], r["ordinal"]): r["content"] for r in planning.running_budget(df, ["project"], ["ordinal"], "content", 120).collect()}
    expected, used = {}, {"p": 0, "q": 0}
    for p, i, t in rows:
        if used[p] < 120:
            expected[p, i] = t[: 120 - used[p]]
        used[p] += len(t)
    assert got == expected


def test_runs_are_followed_as_a_stream(spark, tmp_path):
    """Batches of a stream give the state that all rows together give; a run that is over changes no more."""
    schema = "task_id long, run_id long, seq long, status string, message string, at timestamp"
    batches = [[(1, 1, 1, "running", "", "2024-01-01 00:00:00"), (1, 2, 2, "running", "", "2024-01-01 00:00:05")], [(1, 1, 3, "failed", "boom", "2024-01-01 00:01:00"), (1, 2, 4, "paused", "", "2024-01-01 00:02:00")], [(1, 1, 5, "completed", "", "2024-01-01 00:03:00"), (1, 2, 6, "completed", "", "2024-01-01 00:04:00")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = follow.follow_runs(stream).writeStream.format("memory").queryName("followed").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    last = {r["run_id"]: (r["status"], r["error_message"]) for r in spark.table("followed").collect() if r["status"] in ("failed", "completed", "cancelled")}
    whole = state.run_states(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    assert last == {r["run_id"]: (r["status"], r["error_message"]) for r in whole.collect()} == {1: ("failed", "boom"), 2: ("completed", "")}


def test_small_read_models(spark):
    assert spark.range(1).select(summaries.without_keys(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), ("a",)).alias("m")).first()["m"] == {"b": 2}
    rows = spark.createDataFrame([(1,), (2,)], "task_id int")
    assert summaries.without_orphans(rows, rows.limit(1), "task_id").count() == 1 and spark.range(1).select(project_dir.is_text_file(F.lit("A/B.PY")).alias("t")).first()["t"]
    one, other = (gate.submitted_routes(spark.createDataFrame([row], names)).collect() for row, names in ((("GET", "/a", "s", "h"), "method string, path string, source string, handler string"), (("get", " /a ", "s", "h"), "http_method string, url string, file string, function string")))
    assert one[0]["id"] == other[0]["id"] and len(one[0]["id"]) == 24


@pytest.mark.parametrize(("payload", "expected"), [({}, "已入队等待执行"), ({"mode": "full"}, "已入队等待执行"), ({"mode": "rerun"}, "已入队（重跑）")])
def test_sentences(spark, payload, expected):
    df = spark.createDataFrame([("run.queued", 2, json.dumps(payload))], "event_type string, stage_num int, payload string")
    assert df.select(state.sentence().alias("s")).first()["s"] == expected


def test_discovery(spark):
    files = [("p", 0, "a/api/views.py", "import a.api.auth\n@login_required\n@app.route('/x')\ndef x(): pass\n"), ("p", 1, "a/api/auth.py", "jwt.decode(1)\n"), ("p", 2, "go.mod", "module example.com/m\n"), ("p", 3, "cmd/main.go", 'import (\n\t"example.com/m/svc"\n)\n'), ("p", 4, "svc/s.go", "package svc\n")]
    df = spark.createDataFrame([(*f[:3], "." + f[2].rsplit(".", 1)[-1], len(f[3]), f[3]) for f in files], "project string, ordinal long, path string, extension string, size long, content string")
    found = {k: v.collect() for k, v in routes.discovery(df).items()}
    assert [(r["decorator"], r["route"]) for r in found["guards"]] == [("login_required", "/x")]
    assert {(r["src"], r["dst"]) for r in found["imports"]} == {("a/api/views.py", "a/api/auth.py"), ("cmd/main.go", "svc/s.go")}
    assert {r["directory"]: r["role"] for r in found["directories"]} == {"a": None, "a/api": "controller", "cmd": None, "svc": None}
    assert "a/api/auth.py" in {r["path"] for r in found["critical"]}


@pytest.mark.parametrize(("path", "content", "expected"), [
    ("v.py", '@action(detail=True, methods=["post", "get"], url_path="ban")\ndef ban(self): pass\n', {("POST", "/{pk}/ban", "ban"), ("GET", "/{pk}/ban", "ban")}),
    ("v.py", "@action(detail=False)\ndef all(self): pass\n", {("ANY", "/", "all")}), ("v.py", "@action(detail=True)\ndef one(self): pass\n", {("ANY", "/{pk}", "one")}),
    ("f.py", '@r.api_route("/x", methods=["GET", "PUT"])\nasync def x(): pass\n', {("GET", "/x", "x"), ("PUT", "/x", "x")}),
    ("C.java", '@RequestMapping("/base")\npublic class C {\n  @RequestMapping(value = "/m", method = RequestMethod.POST)\n  public User m(User u) { return u; }\n}\n', {("POST", "/base/m", "m")}),
    ("api/cron.php", "<?php class app {} $app->run();", {("ANY", "/api/cron.php", "cron::run")}), ("lib/cron.php", "<?php class app {} $app->run();", set()),
])
def test_routes_in_other_forms(path, content, expected):
    assert {(m, p, h) for m, p, h, *_ in routes.routes_of(path, content)} == expected
