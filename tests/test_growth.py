"""Joins whose rows grow with the input only, and results where the input has ties or gaps."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from auditloom.functions import proofs
from auditloom.operators import findings, gate, routes
from auditloom.plans import catalog_audit  # noqa: F401 (registers queries)
from auditloom.plans.catalog import ORACLE_SQL, QUERIES
from auditloom.sources import driver_tables as dt
from auditloom.streaming import state

from .helpers import rows_of, same, tables


def most_join_rows(df) -> int:
    """The most rows that a join of an executed plan made."""
    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.finalPhysicalPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
        return max([own, *(walk(plan.children().apply(i)) for i in range(plan.children().size()))])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_files_of_one_receiver_dont_meet_in_pairs(spark):
    n = 150
    go = [("p", f"a{i}/main.go", f'v := r.Group("/v{i + 1000}")\nw := r.Group("/")\napi.UserApi.API(v)\napi.UserApi.API(w)\n') for i in range(n)]
    go += [("p", f"b{i}/user.go", "func (u *UserApi) API(g *gin.RouterGroup) {\n}\n") for i in range(n)]
    nest = [("p", f"n{i}/m.ts", f"@Module({{ imports: [RouterModule.register([{{ path: 'z{i + 1000}', module: CatsModule }}])], controllers: [CatsController] }})\nexport class CatsModule {{}}\n") for i in range(n)]
    nest += [("p", "c.ts", "export class CatsController {}\n")]
    out = routes.module_prefixes(spark.createDataFrame(go + nest, "project string, path string, content string"))
    assert {(r["path"], r["prefix"]) for r in out.collect()} == {(f"b{i}/user.go", "/v1000") for i in range(n)} | {("c.ts", "/z1000")}
    assert most_join_rows(out) <= 2 * n


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Tables in which line items of one number, of one root cause, name other parts; the one that stands first has the later title. One customer has no orders."""
    sf = str(tmp_path_factory.mktemp("tied"))
    part = [Row(p_partkey=k, p_name=f"t{9 - i}", p_brand="Brand#1", p_type="PROMO", p_size=1, p_retailprice=1.0) for i, k in enumerate((0, 350, 700))]
    line = [Row(l_orderkey=7, l_partkey=k, l_suppkey=1, l_linenumber=2, l_quantity=1.0, l_extendedprice=1.0, l_discount=0.0, l_tax=0.0, l_returnflag=f, l_linestatus="O") for k, f in ((0, "R" * 9), (350, "A"), (700, "N"))]
    orders = [Row(o_orderkey=k, o_custkey=c, o_orderstatus=s, o_orderpriority="x") for k, c, s in ((0, 0, "O"), (1, 3, "F"), (2, 4, "O"))]
    customer = [Row(c_custkey=k) for k in range(9)]
    for name, rows in (("part", part), ("lineitem", line), ("orders", orders), ("customer", customer)):
        spark.createDataFrame(rows).coalesce(1).write.parquet(f"{sf}/{name}.parquet")
    return sf


@pytest.mark.parametrize("name", ["upsert_findings", "merge_best_finding"])
def test_findings_of_one_number_keep_their_order_in_the_table(spark, tied, name):
    same(spark, tied, QUERIES[name], ORACLE_SQL[name])
    assert [r["title"] for r in QUERIES[name](spark, tied).collect()] == ["t9"]


def test_tasks_without_stages_are_as_in_the_sql(spark, tied):
    mine, theirs = QUERIES["recovered_tasks"](spark, tied).toPandas(), tables(tied).sql(ORACLE_SQL["recovered_tasks"]).df()
    assert rows_of(mine) == rows_of(theirs) and mine["queued"].isna().sum() == 2
    t = spark.createDataFrame([(6, True, "paused", [2, 3])], "task_id long, queued boolean, status string, selected_stage_nums array<int>")
    none = spark.createDataFrame([], "task_id long, stage_num int, status string")
    assert [(r["remaining"], r["queued"]) for r in state.recovered(t, none).collect()] == [([], False)]


def test_routes_of_one_file_stand_for_each_other(spark):
    """400 routes of one file and 400 of one last segment: no ask meets them all."""
    from auditloom.operators import coverage

    n = 400
    r = spark.createDataFrame([(1, f"a{i:03}", "GET", f"/a/p{i:03}{i * 7919 % 1000}", "x/views.py") for i in range(n)] + [(1, f"b{i:03}", "POST", f"/q{i * 31 % 1000}{i:03}/run", f"f{i}.py") for i in range(n)], "task_id long, route_id string, method string, path string, file_path string")
    asks = r.selectExpr("task_id", "monotonically_increasing_id() AS seq", "replace(file_path, 'x/', '') AS file_path", "method", "replace(path, 'p', 'z') AS path")
    out = coverage.best_route(asks, r).select("file_path", "method", "best_route_id", "best_score")
    got = out.collect()
    assert {tuple(x) for x in got if x["file_path"] == "views.py"} == {("views.py", "GET", "a000", 14)}
    assert [x["best_score"] for x in got if x["method"] == "POST"] == [38] * n
    assert most_join_rows(out) <= 20 * n


def test_findings_are_judged_once_and_on_all_cores(spark):
    """A table in one piece is spread before its findings are judged, and counts and names of a policy come from one merge."""
    sf = "/root/testdata/sf0.001"
    assert "RepartitionByExpression" in dt.findings(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    _, counts = gate.output_policy(dt.findings(spark, sf))
    assert "lineitem" not in counts._jdf.queryExecution().optimizedPlan().toString() and "ExistingRDD" in counts._jdf.queryExecution().executedPlan().toString()
    carried = QUERIES["review_carry_forward"](spark, sf)
    assert "keyword" not in carried._jdf.queryExecution().optimizedPlan().toString() and "Relation" not in carried._jdf.queryExecution().optimizedPlan().toString()


def test_judging_findings_is_compiled(spark):
    """No method that is generated for judging findings is longer than the JVM compiles (8,000 bytes)."""
    f = dt.findings(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (findings.root_cause(f), findings.normalize(f), findings.root_cause(proofs.with_proof(findings.normalize(f)))):
            made = df._jdf.queryExecution().debug().codegenToSeq()
            assert max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_line_numbers_are_read_alike_from_numbers_and_texts(spark):
    rows = [(None, None, None), (3, None, "5-9"), (None, 7, None), (0, -2, "L4~6"), (9, 2, ""), (None, None, "x"), (None, None, "007"), (None, None, "99999999999")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, line_start int, line_end int, line_range string")
    texts = df.withColumns({c: F.col(c).cast("string") for c in ("line_start", "line_end")})
    got, told = [[tuple(r) for r in findings.normalize(x).orderBy("seq").select("line_start", "line_end").collect()] for x in (df, texts)]
    assert got == told == [(None, None), (3, 9), (7, 7), (4, 6), (2, 9), (None, None), (7, None), (None, None)]


def test_routes_around_a_path_stand_for_each_other(spark):
    """400 asks of one path, each from a file of its own, inside 400 routes of other paths."""
    from auditloom.operators import coverage

    n = 400
    r = spark.createDataFrame([(1, f"r{i:03}", "GET", f"/shop/item{i:03}", f"f{i}.py") for i in range(n)], "task_id long, route_id string, method string, path string, file_path string")
    asks = r.selectExpr("task_id", "monotonically_increasing_id() AS seq", "file_path", "'GET' AS method", "'/shop' AS path")
    out = coverage.best_route(asks, r)
    assert {(x["file_path"], x["best_route_id"], x["best_score"]) for x in out.collect()} == {(f"f{i}.py", f"r{i:03}", 28) for i in range(n)}
    assert most_join_rows(out) <= 10 * n


def test_paths_inside_others_are_those_that_they_contain(spark):
    from auditloom.operators import coverage

    paths = ["/", "/a", "/ab", "/a/b", "/a/a", "/a/a/a", "/b", "/b/a/bc", "/é/ü", "/x/é/üü", "/a b", "/{id}/a"]
    out = coverage._contained(spark.createDataFrame([(t, p) for t in (0, 2) for p in paths[t:]], "task_id long, path string"))
    assert sorted(map(tuple, out.collect())) == sorted((t, x, y) for t in (0, 2) for x in paths[t:] for y in paths[t:] if x != y and y in x)


def exchanged(df) -> list[tuple[str, int, int]]:
    """Exchanges of an executed plan: keys, rows and bytes written."""
    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.finalPhysicalPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = []
        if name == "ShuffleExchangeExec":
            own = [(plan.outputPartitioning().toString(), plan.metrics().apply("shuffleRecordsWritten").value(), plan.metrics().apply("dataSize").value())]
        return own + [x for i in range(plan.children().size()) for x in walk(plan.children().apply(i))]

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_long_paths_arent_copied_for_each_of_their_parts(spark):
    from auditloom.operators import coverage

    paths = ["/" + "/".join(f"segment{(i * 7 + k) % 90}" for k in range(60)) for i in range(10)] + ["/segment8/segment9/seg", "/segment", "/segment8/segment9/segment10/se"]
    out = coverage._contained(spark.createDataFrame([(1, p) for p in paths], "task_id long, path string"))
    written = exchanged(out)
    assert sorted((x["outer"], x["inner"]) for x in out.collect()) == sorted((x, y) for x in paths for y in paths if x != y and y in x)
    assert written and max(size for _, _, size in written) <= 5_000_000


def test_asks_with_a_best_route_dont_gather_by_file(spark):
    """1,000 asks of one file: those that have a best route are not brought together by their file."""
    from auditloom.operators import coverage

    r = spark.createDataFrame([(1, f"r{i:04}", "GET", f"/p{i:04}/x{i}", "one.py") for i in range(1000)] + [(1, "only", "GET", "", "two.py")], "task_id long, route_id string, method string, path string, file_path string")
    asks = r.selectExpr("task_id", "monotonically_increasing_id() AS seq", "file_path", "CASE WHEN file_path = 'two.py' THEN '' ELSE method END AS method", "path")
    out = coverage.best_route(asks, r).select("file_path", "path", "best_route_id", "best_score")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where there are many files
    try:
        got = {(x["path"], x["best_route_id"], x["best_score"]) for x in out.collect()}
        written = exchanged(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(f"/p{i:04}/x{i}", f"r{i:04}", 38) for i in range(1000)} | {("", "only", None)}
    by_file = [rows for keys, rows, _ in written if "task_id#" in keys and "f_file#" in keys and keys.count("#") == 2]
    assert max(by_file, default=0) < 1000
