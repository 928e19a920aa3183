"""Driver tables as the entities that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files of a project per language."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.col("lang").alias("project"), F.col("doc_id").alias("ordinal"), path.alias("path"), F.lit(".txt").alias("extension"), F.col("n_chars").alias("size"), F.col("text").alias("content"))


def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as HTML files of one project."""
    p = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("pages/page_"), F.col("page_id").cast("string"), F.lit(".html"))
    return p.select(F.lit("web").alias("project"), F.col("page_id").alias("ordinal"), path.alias("path"), F.lit(".html").alias("extension"), F.length("html").cast("long").alias("size"), F.col("html").alias("content"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as routes of five tasks: the URL's path on its host, with verbs and handlers by id."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    bare = F.regexp_replace("url", r"^[a-z]+://", "")
    return p.select(
        (i % 5).alias("task_id"), (i % 2).alias("source_rank"), i.alias("ordinal"), F.element_at(F.array(*map(F.lit, ("GET", "post", "PUT", ""))), (i % 4 + 1).cast("int")).alias("method"),
        F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1).alias("path"), F.concat(F.lit("handler_"), (i % 7).cast("string")).alias("handler"), F.regexp_extract(bare, r"^([^/?#]*)", 1).alias("file_path"),
        F.element_at(F.array(*map(F.lit, ("None", "Unknown", "JWT"))), (i % 3 + 1).cast("int")).alias("auth"),
    )


ROUTES_SQL = r"""SELECT page_id % 5 AS task_id, page_id % 2 AS source_rank, page_id AS ordinal, ['GET', 'post', 'PUT', ''][page_id % 4 + 1] AS method,
  regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^[^/?#]*([^?#]*)', 1) AS path, 'handler_' || page_id % 7 AS handler,
  regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^([^/?#]*)', 1) AS file_path, ['None', 'Unknown', 'JWT'][page_id % 3 + 1] AS auth FROM pages"""


def findings(spark: SparkSession, sf_dir: str, row: bool = False) -> DataFrame:
    """Line items as findings in 97 tasks; parts are files and kinds, so root causes repeat. Line items of one order and number have one seq; ``row``, where they stand in the table, tells them apart."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    placed = [F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")).alias("row")] if row else []
    # A finding costs far more to judge than to move: spread over all cores first, however the table is cut.
    li = li.select("*", *placed).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "l_orderkey")
    j = li.join(part, li["l_partkey"] == part["p_partkey"])
    line = F.col("l_linenumber")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    null = F.lit(None).cast("string")
    return j.select(
        (F.col("l_orderkey") % 97).alias("task_id"), (F.col("l_orderkey") * 10 + line).alias("seq"), (F.col("l_suppkey") % 8 + 2).cast("int").alias("stage_num"), F.col("p_name").alias("title"),
        pick(("Critical", "high", "高危", "Low", "", "bogus", "Info"), F.col("l_partkey") % 7).alias("severity"), F.col("p_type").alias("vuln_type"),
        F.concat(F.lit("src/App/"), "p_brand", F.lit("/m"), (F.col("l_partkey") % 50).cast("string"), F.lit(".py")).alias("file_path"), F.when(line <= 4, (line * 10).cast("int")).alias("line_start"), F.lit(None).cast("int").alias("line_end"),
        F.when(line % 2 == 1, F.concat(F.lit("call("), F.col("l_suppkey").cast("string"), F.lit(")"))).alias("code_snippet"), F.when(line >= 5, F.concat(F.lit("GET /api/"), (F.col("l_partkey") % 20).cast("string"))).alias("endpoint"),
        null.alias("poc_raw"), F.when(F.col("l_tax") > 0.06, "valid").otherwise("").alias("poc_validation_status"), F.concat_ws(" ", "p_type", "l_returnflag").alias("description"), null.alias("fix_suggestion"),
        pick(("high", "LOW", "?"), F.col("l_suppkey") % 3).alias("confidence"), (F.col("l_discount") >= 0.1).alias("salvaged"), *(["row"] if row else []),
    )


FINDINGS_SQL = """SELECT l_orderkey % 97 AS task_id, l_orderkey * 10 + l_linenumber AS seq, CAST(l_suppkey % 8 + 2 AS INTEGER) AS stage_num, p_name AS title,
  ['Critical', 'high', '高危', 'Low', '', 'bogus', 'Info'][l_partkey % 7 + 1] AS severity, p_type AS vuln_type, 'src/App/' || p_brand || '/m' || l_partkey % 50 || '.py' AS file_path,
  CASE WHEN l_linenumber <= 4 THEN l_linenumber * 10 END AS line_start, CASE WHEN l_linenumber % 2 = 1 THEN 'call(' || l_suppkey || ')' END AS code_snippet,
  CASE WHEN l_linenumber >= 5 THEN 'GET /api/' || l_partkey % 20 END AS endpoint, CASE WHEN l_tax > 0.06 THEN 'valid' ELSE '' END AS poc_validation_status, p_type || ' ' || l_returnflag AS description,
  ['high', 'LOW', '?'][l_suppkey % 3 + 1] AS confidence, l_discount >= 0.1 AS salvaged FROM lineitem JOIN part ON l_partkey = p_partkey"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stages of tasks (customers)."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(F.col("o_custkey").alias("task_id"), (F.col("o_orderkey") % 8 + 2).cast("int").alias("stage_num"), F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("priority"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as an audit log of tasks (users)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), F.lit(None).cast("long").alias("run_id"), F.lit(None).cast("int").alias("stage_num"), "event_type", F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("created_at"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signup starts a run of its user's task; one in three runs is over within a day."""
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    at = F.col("ts").cast("timestamp")
    over = F.col("event_id") % 3 == 0
    status = F.when(over, "completed").when(F.col("event_id") % 3 == 1, "running").otherwise("pending")
    return e.select((F.col("event_id") + 1).alias("id"), F.col("user_id").alias("task_id"), at.alias("started_at"), F.when(over, at + F.expr("INTERVAL 1 DAY")).alias("ended_at"), status.alias("status"))


#: A small project in several frameworks; {i} is a page's number. Each page becomes these files, so paths, module names and routes follow from the table.
CODE = (
    ("m{i}/requirements.txt", "flask\npsycopg2\npyjwt\n"),
    ("m{i}/app{i}.py", "from flask import Flask\nfrom pkg{i} import views{i}\napp = Flask(__name__)\n\n@app.route('/login/{i}', methods=['POST'])\ndef login():\n    name = request.form.get('name')\n    return jwt.encode({'n': name})\n\n@app.route('/items/<int:item_id>')\n@login_required\ndef item(item_id):\n    page = request.args['page']\n    return cursor.execute('SELECT 1')\n"),
    ("pkg{i}/views{i}.py", "from fastapi import APIRouter\nrouter = APIRouter(prefix='/api')\n\n@router.get('/users/{user_id}')\nasync def user(user_id: int):\n    return 1\n\n# @router.get('/hidden')\n"),
    ("pkg{i}/admin{i}.py", "from flask import Blueprint\nbp = Blueprint('admin', __name__)\n\n@bp.route('/stats')\ndef stats():\n    return 1\n"),
    ("m{i}/wsgi{i}.py", "from pkg{i}.admin{i} import bp\nfrom pkg{i} import views{i}\nserver.register_blueprint(bp, url_prefix='/admin')\nserver.include_router(views{i}.router, prefix='/v2')\n"),
    ("dj{i}/handlers{i}.py", "def detail{i}(request, pk):\n    token = request.GET.get('token')\n    return jwt.decode(token)\n"),
    ("dj{i}/urls{i}.py", "from dj{i} import handlers{i}\nurlpatterns = [\n    path('detail/<int:pk>', handlers{i}.detail{i}),\n]\n"),
    ("src{i}/UserController.java", 'package src{i};\nimport src{i}.dao.UserDao;\n@RestController\n@RequestMapping("/users{i}")\npublic class UserController {\n  @GetMapping("/{id}")\n  public User one(@PathVariable Long id) { return null; }\n}\n'),
    ("src{i}/dao/UserDao.java", "package src{i}.dao;\npublic class UserDao { }\n"),
    ("web{i}/server.js", "const files = require('./routes')\napp.use('/static', files)\n"),
    ("web{i}/routes.js", "const helper = require('./helper')\nconst router = express.Router()\nrouter.post('/upload', upload)\n"),
    ("web{i}/helper.js", "import x from './routes'\nmodule.exports = 1\n"),
    ("go{i}/main.go", 'package main\nimport (\n\t"net/http"\n\t"go{i}/svc"\n)\nfunc mount() {\n\tv1 := r.Group("/v1")\n\tadmin := v1.Group("/admin")\n\tadmin.GET("/users/:id", listUsers)\n\thttp.HandleFunc("/health", health)\n\tapi.UserApi.API(admin)\n}\nfunc listUsers(c *gin.Context) {\n\tname := c.Query("name")\n}\n'),
    ("go{i}/svc/user.go", 'package svc\nfunc (u *UserApi) API(g *gin.RouterGroup) {\n\tg.POST("/create", u.Create)\n}\n'),
    ("config{i}/routes.rb", "Rails.application.routes.draw do\n  resources :posts{i}\n  get '/about', to: 'pages#about'\nend\n"),
    ("rs{i}/main.rs", '#[get("/ping/{i}")]\nasync fn ping() -> impl Responder { "pong" }\n'),
    ("api{i}/web.php", "Route::get('/orders', [OrderController::class, 'index']);\n"),
    ("api{i}/ItemsController.cs", '[Route("api/items")]\npublic class ItemsController {\n  [HttpGet("{id}")]\n  public Item Get(int id) { return null; }\n}\n'),
    ("nest{i}/cats.controller.ts", "@Controller('cats')\nexport class Cats{i}Controller {\n  @Post()\n  create(@Body() dto: Dto) { return 1; }\n}\n"),
    ("nest{i}/cats.module.ts", "@Module({ imports: [RouterModule.register([{ path: 'zoo', children: [{ path: 'wing', module: Cats{i}Module }] }])], controllers: [Cats{i}Controller] })\nexport class Cats{i}Module {}\n"),
)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the files of CODE with its number, in four projects."""
    made = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("path"), F.lit(c).alias("content")) for k, (p, c) in enumerate(CODE)])
    number = F.col("page_id").cast("string")
    # Numbers are few bytes and become twenty files each: spread over all cores first, however the table is cut.
    pages = table(spark, sf_dir, "pages").select("page_id").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "page_id")
    each = pages.select("page_id", F.explode(made).alias("f"))
    named = each.select(
        F.concat(F.lit("p"), (F.col("page_id") % 4).cast("string")).alias("project"), (F.col("page_id") * len(CODE) + F.col("f.k")).alias("ordinal"),
        F.replace("f.path", F.lit("{i}"), number).alias("path"), F.replace("f.content", F.lit("{i}"), number).alias("content"),
    )
    return named.select("project", "ordinal", "path", F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("extension"), F.length("content").cast("long").alias("size"), "content")


def form_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as files of six route forms, nested or repeated one to four times, with a word made of the page's text."""
    pages = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 4 + 1).cast("int").alias("depth"), F.concat(F.lit("w"), F.substring(F.md5(F.col("html").cast("binary")), 1, 6)).alias("word"), F.col("page_id").cast("string").alias("i"))
    word, i, depth = F.col("word"), F.col("i"), F.col("depth")
    lit = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    each = lambda make: F.array_join(F.transform(F.sequence(F.lit(1), depth), lambda k: make(k.cast("string"), k)), "")
    contents = (
        (lit("f", i, "/group.go"), lit("package f\n", each(lambda k, n: lit(F.when(n % 2 == 1, "v := r").otherwise("v = v"), '.Group("/', word, k, '")\n', 'v.GET("/one', k, '", h', k, ")\n")))),
        (lit("config", i, "/routes.rb"), lit("Rails.application.routes.draw do\n", each(lambda k, n: lit("namespace :", word, k, ' do # do\nget "/x', k, '", to: "c#a', k, '"\n')), F.expr("repeat('end\n', depth + 1)"))),
        (
            lit("nest", i, "/app.module.ts"),
            lit("configure(consumer) {\nconsumer.apply(Log, Check(')')).exclude(", F.when(depth > 2, lit("'", word, "/p1'")).otherwise(""), ")\n.forRoutes(", each(lambda k, n: lit("{ path: '", word, "/p", k, "', method: RequestMethod.GET, handler: h", k, " }, ")), "CatsController)\n}\n"),
        ),
        (
            lit("app/m", word, "/controller/c", i, ".api.php"),
            lit("<?php class action {\npublic function display() { $action = $this->ev->url(3); if (!method_exists($this, $action)) $action = 'x'; $this->$action(); }\n", each(lambda k, n: lit("private function act", k, "() {}\n")), "}\n"),
        ),
        (lit("jax", i, "/Users.java"), lit('@Path("/', word, '")\npublic class Users {\n', each(lambda k, n: lit("@GET\n", F.when(n % 2 == 0, lit('@Path("/m', k, '")\n')).otherwise(""), "public Response m", k, "(Long id) {}\n")), "}\n")),
        (lit("chi", i, "/chi.go"), lit("package c\n", each(lambda k, n: lit('r.Route("/', word, k, '", func(r chi.Router) { // {\nr.Get("/y', k, '", g', k, ")\n")), F.expr("repeat('})\n', depth)"))),
    )
    files = F.array(*[F.struct(F.lit(k).alias("k"), p.alias("path"), c.alias("content")) for k, (p, c) in enumerate(contents)])
    out = pages.select("page_id", F.explode(files).alias("f"))
    return out.select(F.concat(F.lit("p"), (F.col("page_id") % 4).cast("string")).alias("project"), (F.col("page_id") * len(contents) + F.col("f.k")).alias("ordinal"), "f.path", F.length("f.content").cast("long").alias("size"), "f.content")
