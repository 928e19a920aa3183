"""Directories, archives, indexes, event logs and streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from auditloom.functions import chunks, proofs
from auditloom.operators import routes
from auditloom.sources import project_dir
from auditloom.sources.driver_tables import CODE
from auditloom.streaming import events as ev


def test_project_directory(spark, tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "app" / "run.py").write_text("import os\n")
    (tmp_path / "app" / "zh.py").write_bytes("名字 = '中文'".encode("gb18030"))
    (tmp_path / "node_modules" / "x.js").write_text("skipped")
    (tmp_path / ".git" / "y.py").write_text("skipped")
    (tmp_path / "logo.png").write_bytes(b"\x89PNG")
    got = {r["path"]: r for r in project_dir.read_project(spark, f"file://{tmp_path}", "p").collect()}
    assert set(got) == {"app/run.py", "app/zh.py"}
    assert got["app/run.py"]["content"] == "import os\n" and got["app/zh.py"]["content"] == "名字 = '中文'" and got["app/run.py"]["ordinal"] == 1


def test_archive_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("src/./a.py", "x")
        z.writestr("__MACOSX/._a", "x")
        z.writestr("../up.py", "x")
    got = project_dir.archive_members(spark, f"file://{tmp_path}/a.zip").collect()
    assert {r["member"]: r["path"] for r in got} == {"src/./a.py": "src/a.py", "../up.py": None} and all(r["within_limits"] for r in got)


def test_index_is_replaced_by_project(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert project_dir.read_index(spark, path) is None
    row = lambda p, n: spark.createDataFrame([(p, n, "f1")], "project string, n int, fingerprint string")
    project_dir.write_index(row("a", 1), path)
    project_dir.write_index(row("b", 2), path)
    project_dir.write_index(row("a", 3), path)
    assert sorted((r["project"], r["n"]) for r in project_dir.read_index(spark, path).collect()) == [("a", 3), ("b", 2)]
    assert project_dir.read_index(spark, path, "other") is None


LOG = [(i, 1 + i % 2, None, None, "done" if i % 3 else "task_failed", '{"tokens": 5}', f"2024-01-01 00:{i:02d}:00") for i in range(1, 21)]


def log(spark):
    df = spark.createDataFrame(LOG, "id long, task_id long, run_id long, stage_num int, event_type string, payload string, at string")
    return df.withColumn("created_at", F.to_timestamp("at")).drop("at")


def test_log_round_trip_and_stream_equal_batch(spark, tmp_path):
    path, events = f"file://{tmp_path}/log", log(spark)
    ev.append_log(events, path)
    (tmp_path / "log" / "broken.json").write_text('{"id": oops\n')
    assert {r["id"] for r in ev.read_log(spark, path, since=10, limit=3).collect()} == {15, 16, 17, 18, 19, 20}
    q = ev.follow(ev.stream_log(spark, path).filter("id IS NOT NULL"), "followed", f"file://{tmp_path}/ck")
    q.awaitTermination(60)
    streamed = {(r["task_id"], r["event_type"]): r["count"] for r in spark.table("followed").collect()}
    assert streamed == {(r["task_id"], r["event_type"]): r["count"] for r in events.groupBy("task_id", "event_type").count().collect()}


def test_cursor_and_binding(spark):
    events = log(spark)
    assert [r["id"] for r in ev.after_cursor(events, 16).filter("task_id = 1").orderBy("id").collect()] == [18, 20]
    runs = spark.createDataFrame([(100, 1, "2024-01-01 00:05:00", None), (101, 1, "2024-01-01 00:10:30", None)], "id long, task_id long, a string, b string").select("id", "task_id", F.to_timestamp("a").alias("started_at"), F.to_timestamp("b").alias("ended_at"))
    bound = {r["id"]: r["bound_run_id"] for r in ev.bind_runs(events, runs).filter("task_id = 1").collect()}
    assert bound[2] == 101 and bound[6] == 100 and bound[12] == 101
    seen = ev.unseen(events.filter("id > 8"), events.filter("id <= 10"), 4)
    assert sorted(r["id"] for r in seen.collect()) == list(range(13, 21))


@pytest.mark.parametrize(("task", "sub", "expected"), [("paused", [], "paused"), ("running", ["failed"], "failed"), ("running", ["blocked"], "blocked"), ("running", [], "stalled"), ("pending", [], "stalled"), ("completed", [], "completed")])
def test_diagnoses(spark, task, sub, expected):
    tasks = spark.createDataFrame([(1, task)], "task_id long, status string")
    runs = spark.createDataFrame([(7, 1, "running" if task == "running" else task)], "id long, task_id long, status string")
    subs = spark.createDataFrame([(1, s) for s in sub], "task_id long, status string")
    out = ev.diagnose(tasks, runs, subs, subs.limit(0), log(spark), "2024-01-02 00:00:00").first()
    assert out["focus_status"] == expected


def test_sample_routes():
    found = {(m, p, h) for path, content in CODE for m, p, h, *_ in routes.routes_of(path.replace("{i}", ""), content.replace("{i}", ""))}
    assert {
        ("POST", "/login", "login"), ("GET", "/items/<int:item_id>", "item"), ("GET", "/api/users/{user_id}", "user"), ("GET", "/users/{id}", "one"), ("POST", "/upload", "upload"),
        ("GET", "/v1/admin/users/:id", "listUsers"), ("ANY", "/health", "health"), ("DELETE", "/posts/:id", "destroy"), ("GET", "/ping", "ping"), ("GET", "/api/items/{id}", "Get"), ("POST", "/cats", "create"),
    } <= found


def test_commented_routes_and_group_cycles():
    assert not list(routes.routes_of("a.py", "# @app.route('/x')\n"))
    assert list(routes.routes_of("a.go", 'a := b.Group("/x")\nb := a.Group("/y")\na.GET("/z", h)\n'))


def test_mounts():
    py = "from shop.web import bp\nimport core.api as api\napp.register_blueprint(bp, url_prefix='/s')\napp.include_router(api.router)\npath('x/', include('blog.urls'))\n"
    assert set(routes.mounts_of("a.py", py)) == {("shop/web/bp", "/s"), ("shop/web", "/s"), ("core/api", ""), ("blog/urls", "/x")}
    assert list(routes.mounts_of("web/a.js", "import u from '../u/index.js'\napp.use('/u', guard, u)")) == [("u", "/u")]


def test_import_edges(spark):
    rows = [("p", "web/a.js", "import x from './lib/b'"), ("p", "web/lib/b.ts", "require('../a')"), ("p", "pkg/m.py", "from pkg.sub import n\nimport os"), ("p", "src/pkg/sub.py", ""), ("p", "e.py", None)]
    edges = {(r["src"], r["dst"]) for r in routes.import_edges(spark.createDataFrame(rows, "project string, path string, content string")).collect()}
    assert edges == {("web/a.js", "web/lib/b.ts"), ("web/lib/b.ts", "web/a.js"), ("pkg/m.py", "src/pkg/sub.py")}


def test_proofs_and_chunks(spark):
    df = spark.createDataFrame([("GET /a HTTP/1.1\r\nHost: x\r\n\r\nbody", "1. log in\n2. go on", "curl http://x", "[2, 3, 12, \"x\", 2]", "a.min.js")], "raw string, steps string, cmd string, nums string, path string")
    row = df.select(proofs.raw_request("raw").alias("r"), proofs.raw_request("cmd")["valid"].alias("bad"), proofs.is_stepwise("steps").alias("s"), proofs.is_command("cmd").alias("c"), chunks.int_list("nums").alias("n"), chunks.is_static("path").alias("st")).first()
    assert row["r"].asDict() == {"valid": True, "method": "GET", "target": "/a", "host": "x"} and not row["bad"] and row["s"] and row["c"] and row["n"] == [2, 3] and row["st"]


def test_localized_texts(spark):
    from auditloom.functions.localize import localize

    rows = spark.createDataFrame([("SQL Injection",), ("Sql_Injection",), ("SQL Injection via Header",), (None,)], "t string").select(localize("t").alias("v")).collect()
    assert [r["v"] for r in rows] == ["SQL 注入", "SQL 注入", "SQL 注入 来源 Header", ""]


def test_events_are_stored_and_compacted(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(i, 1, None, 2, "a" if i % 2 else "b", '{"t": "' + "x" * 600 + '", "n": null, "e": "", "k": 1}', "2024-01-01 00:00:0" + str(i)) for i in range(4)]
    df = spark.createDataFrame([*rows, rows[0]], ev.EVENT_SCHEMA.replace("timestamp", "string")).withColumn("created_at", F.to_timestamp("created_at"))
    small = ev.compacted(df).first()["payload"]
    assert small == '{"t":"' + "x" * 500 + '...[truncated]","k":"1"}'
    ev.append_log(df, f"{tmp_path}/log")
    ev.store(ev.stream_log(spark, f"{tmp_path}/log"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("event_type").count().orderBy("event_type").collect() == [("a", 2), ("b", 2)]
    got = ev.read_log(spark, f"{tmp_path}/log", kind="a", limit=1).collect()
    assert [(r["id"], r["total"], r["has_more"]) for r in got] == [(3, 2, True)]


def test_strategy_fingerprint(monkeypatch):
    from auditloom.operators import scan

    before = scan.strategy_fingerprint()
    monkeypatch.setattr(scan, "CHUNK", 1)
    assert scan.strategy_fingerprint() != before == before.lower() and len(before) == 64
