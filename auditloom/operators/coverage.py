"""Routes, their coverage by stages, gaps and follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import endpoint_anchor, http_path, route_id, route_match_path
from ..functions.severity import AUDITED, GAPS, coverage_status, status_of_route
from ..functions.text import any_in, contains_any, count_in, count_present, fixed, text_or_empty
from .findings import merge_rows

#: What makes a route worth looking at first.
PATH_MARKERS = (
    "/admin", "/auth", "/login", "/token", "/oauth", "/callback", "/webhook", "/upload", "/download", "/export", "/import", "/payment", "/order", "/user", "/account", "/password",
    "/reset", "/debug", "/internal",
)
FILE_MARKERS = ("/controller", "/controllers/", "/routes/", "/router", "urls.py", "route.ts", "route.js", "view", "handler", "gateway", "proxy")
HANDLER_MARKERS = ("login", "auth", "token", "upload", "download", "export", "import", "callback", "webhook", "admin", "delete", "update", "create")
ROUTE_COLUMNS = ("route_id", "method", "path", "handler", "file_path", "auth")


def with_route_id(routes: DataFrame) -> DataFrame:
    has = "route_id" in routes.columns
    verb = F.upper(F.trim(text_or_empty("method")))
    return routes.withColumn("route_id", route_id(F.col("method"), F.col("path"), F.col("handler"), F.col("file_path"), F.col("route_id") if has else None)).withColumn("method", F.when(verb == "", "UNKNOWN").otherwise(verb)).withColumn("path", F.trim(text_or_empty("path")))


def merge_routes(routes: DataFrame) -> DataFrame:
    """One row a route_id; of rows in order of (source_rank, ordinal) the earlier values that aren't missing count."""
    return merge_rows(with_route_id(routes), "route_id", ["source_rank", "ordinal"], later_wins=False)


def route_priority() -> Column:
    path, handler, file, auth, method = (F.lower(text_or_empty(c)) for c in ("path", "handler", "file_path", "auth", "method"))
    return (
        4 * count_present(path, PATH_MARKERS) + 2 * count_present(file, FILE_MARKERS) + 2 * count_present(handler, HANDLER_MARKERS) + F.when(auth.isin("none", ""), 2).when(auth == "unknown", 1).otherwise(0)
        + F.when(method.isin("post", "put", "patch", "delete", "any"), 2).otherwise(0) + F.when(contains_any(path, (":", "{", "<")), 1).otherwise(0)
    )


def coverage_items(items: DataFrame) -> DataFrame:
    """Distinct (task_id, stage_num, route_id, status, reason) of attestations; those without an id are ignored."""
    return items.filter(F.trim(text_or_empty("route_id")) != "").select(
        "task_id", "stage_num", F.trim("route_id").alias("route_id"), coverage_status("status").alias("status"), F.substring(F.trim(text_or_empty("reason")), 1, 500).alias("reason")
    ).distinct()


def endpoint_keys(routes: DataFrame) -> DataFrame:
    """Keys that an endpoint may name a route by, with their rank; a key belongs to one route, the first by id."""
    path = route_match_path("path")
    keys = F.transform(F.expr("sequence(1, 4)"), lambda i: F.struct(i.alias("rank"), F.when(i == 1, F.concat("method", F.lit(" "), "p")).when(i == 2, F.concat(F.lit("ANY "), "p")).when(i == 3, F.concat(F.lit("UNKNOWN "), "p")).otherwise(F.col("p")).alias("key")))
    made = routes.withColumn("p", path).filter("p <> ''").select("task_id", "route_id", F.explode(keys).alias("k"))
    return made.groupBy("task_id", F.col("k.key").alias("key")).agg(F.min("route_id").alias("route_id"))


def resolve_routes(findings: DataFrame, routes: DataFrame) -> DataFrame:
    """Findings with matched_route_id: their own route_id if that route exists, else the route their endpoint names; exact, ANY, UNKNOWN, bare, in this order."""
    own = routes.select(F.col("task_id").alias("own_task"), F.col("route_id").alias("own_id")).distinct()
    anchor = endpoint_anchor("endpoint")
    tail = route_match_path(F.regexp_extract("anchor", r"^\S+ (.*)$", 1))
    keys = F.transform(F.expr("sequence(1, 4)"), lambda i: F.struct(i.alias("rank"), F.when(i == 1, F.col("anchor")).when(i == 2, F.concat(F.lit("ANY "), "t")).when(i == 3, F.concat(F.lit("UNKNOWN "), "t")).otherwise(F.col("t")).alias("key")))
    asked = findings.withColumn("anchor", anchor).withColumn("t", tail).select("task_id", "seq", F.explode(F.filter(keys, lambda k: (k["key"] != "") & ~k["key"].isin("ANY ", "UNKNOWN "))).alias("k"))
    best = asked.select("task_id", "seq", "k.rank", "k.key").join(endpoint_keys(routes), ["task_id", "key"]).groupBy("task_id", "seq").agg(F.min(F.struct("rank", "route_id"))["route_id"].alias("by_endpoint"))
    has = findings.columns
    mine = F.trim(text_or_empty("route_id")) if "route_id" in has else F.lit("")
    return findings.withColumn("_mine", mine).join(own, (F.col("task_id") == F.col("own_task")) & (F.col("_mine") == F.col("own_id")), "left").join(best, ["task_id", "seq"], "left").withColumn("matched_route_id", F.coalesce("own_id", "by_endpoint")).drop("_mine", "own_task", "own_id", "by_endpoint")


def coverage_by_route(routes: DataFrame, items: DataFrame, findings: DataFrame) -> DataFrame:
    """Per known route (task_id, route_id): statuses, stages, attested, audited, finding, status, gap_reason (null if audited)."""
    keyed = items.select("task_id", "route_id", "stage_num", "status", F.lit(True).alias("attested"))
    found = findings.filter(F.col("matched_route_id").isNotNull()).select("task_id", F.col("matched_route_id").alias("route_id"), "stage_num", F.lit("finding").alias("status"), F.lit(False).alias("attested"))
    state = keyed.unionByName(found).groupBy("task_id", "route_id").agg(F.array_sort(F.collect_set("status")).alias("statuses"), F.array_sort(F.collect_set("stage_num")).alias("stage_nums"), F.max("attested").alias("attested"))
    out = routes.join(state, ["task_id", "route_id"], "left")
    some = lambda names: F.coalesce(F.arrays_overlap("statuses", F.array(*map(F.lit, names))), F.lit(False))
    out = out.withColumns({"attested": F.coalesce("attested", F.lit(False)), "audited": some(AUDITED), "finding": some(("finding", "confirmed_finding")), "status": status_of_route(F.coalesce("statuses", F.array().cast("array<string>")))})
    return out.withColumn("gap_reason", F.when(~F.col("attested") & ~F.col("audited"), "not_model_attested").when(~F.col("audited"), "attested_but_not_audited"))


def stage_coverage(items: DataFrame, focus: DataFrame) -> DataFrame:
    """Per (task_id, stage_num): how many focus routes, and of them attested, audited, missing, unattested and attested with a gap."""
    audited = F.col("status").isin(*AUDITED)
    state = items.groupBy("task_id", "stage_num", "route_id").agg(F.max(audited).alias("audited"))
    both = focus.select("task_id", "stage_num", "route_id").distinct().withColumn("focus", F.lit(True)).join(state, ["task_id", "stage_num", "route_id"], "full")
    n = lambda c: F.sum(c.cast("long"))
    is_focus, attested, ok = F.coalesce("focus", F.lit(False)), F.col("audited").isNotNull(), F.coalesce("audited", F.lit(False))
    return both.groupBy("task_id", "stage_num").agg(
        n(is_focus).alias("focus_route_count"), n(attested).alias("attested_route_count"), n(ok).alias("audited_route_count"), n(is_focus & ~ok).alias("missing_focus_route_count"),
        n(is_focus & ~attested).alias("unattested_focus_route_count"), n(is_focus & attested & ~ok).alias("gap_focus_route_count"),
    )


def coverage_summary(by_route: DataFrame, stages: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Per task: counts of known, audited, attested, found and missing routes, the ratio, and whether there are gaps. ``scanned``: task_id, route_count that the scan reported."""
    n = lambda c: F.sum(c.cast("long"))
    per = by_route.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("known_route_count"), n(F.col("audited")).alias("audited_route_count"), n(F.col("attested")).alias("attested_route_count"), n(F.col("finding")).alias("finding_route_count"),
        n(~F.col("audited")).alias("_missing_known"), n(F.coalesce(F.col("gap_reason") == "not_model_attested", F.lit(False))).alias("unattested_route_count"), n(F.coalesce(F.col("gap_reason") == "attested_but_not_audited", F.lit(False))).alias("attested_gap_route_count"),
    )
    focus = stages.groupBy("task_id").agg(F.sum("missing_focus_route_count").alias("focus_gap_count"), F.sum("unattested_focus_route_count").alias("focus_unattested_count"))
    out = per.join(focus, "task_id", "full").na.fill(0)
    out = out.join(scanned, "task_id", "left") if scanned is not None else out.withColumn("route_count", F.lit(0))
    total = F.greatest("known_route_count", F.coalesce("route_count", F.lit(0)))
    out = out.withColumn("total_routes", total.cast("long")).withColumn("missing_route_count", F.greatest(F.col("total_routes") - F.col("audited_route_count"), F.lit(0)).cast("long"))
    ratio = F.when(F.col("total_routes") > 0, F.round(F.col("audited_route_count") / F.col("total_routes"), 4)).otherwise(1.0)
    return out.withColumn("unknown_missing_route_count", F.greatest(F.col("missing_route_count") - F.col("_missing_known"), F.lit(0)).cast("long")).withColumn("coverage_ratio", ratio).withColumn("has_route_gaps", (F.col("missing_route_count") > 0) | (F.col("focus_gap_count") > 0)).drop("_missing_known", "route_count")


def _contained(paths: DataFrame) -> DataFrame:
    """Of paths (task_id, path): those inside others, as task_id, outer, inner.

    A path inside another one goes from one of that one's slashes over whole segments to a
    beginning of a further segment. So the runs of whole segments meet those before the last
    segments of paths, and only where such a run is known the beginnings of the segment
    after it, as long as last segments there are, meet these. Runs and outer paths are carried
    as hashes, so long paths are not copied for each of their parts; the texts decide.
    """
    segment, run = "substring_index({0}, '/', -1)", "xxhash64(left({0}, length({0}) - length(substring_index({0}, '/', -1))))"
    ends = paths.select("task_id", F.col("path").alias("inner"), F.expr(run.format("path")).alias("run"), F.expr(segment.format("path")).alias("segment"))
    runs = ends.groupBy("task_id", "run").agg(F.min(F.length("segment")).alias("least"), F.max(F.length("segment")).alias("most"))
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    tails = paths.withColumn("i", F.explode(F.sequence(F.lit(1), slashes))).select("task_id", F.xxhash64("path").alias("whole"), "i", F.expr("concat('/', substring_index(path, '/', -i))").alias("tail"))
    heads = tails.withColumn("k", F.explode(F.sequence(F.lit(1), "i"))).select("task_id", "whole", F.expr("substring_index(tail, '/', k + 1)").alias("head"))
    asked = heads.select("task_id", "whole", F.expr(run.format("head")).alias("run"), F.expr(segment.format("head")).alias("after")).distinct()
    known = asked.join(runs, ["task_id", "run"]).filter(F.length("after") >= F.col("least"))
    begun = known.withColumn("n", F.explode(F.sequence("least", F.least("most", F.length("after"))))).select("task_id", "whole", "run", F.expr("left(after, n)").alias("segment"))
    pairs = begun.join(ends, ["task_id", "run", "segment"]).select("task_id", "whole", "inner")
    outer = paths.select("task_id", F.xxhash64("path").alias("whole"), F.col("path").alias("outer"))
    return pairs.join(outer, ["task_id", "whole"]).filter("inner <> outer AND contains(outer, inner)").select("task_id", "outer", "inner").distinct()


def _ends(path: str) -> Column:
    """A path and what follows each of its slashes."""
    parts = F.split(path, "/")
    return F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")), lambda x: x != ""))


def best_route(findings: DataFrame, routes: DataFrame) -> DataFrame:
    """Findings with best_route_id and best_score: the route that suits best by file, path and verb.

    Points: the file 12, its end 8 (where the finding names a path or verb); the path 20,
    one inside the other 10, the same last segment 4; the verb 6, a route for any verb 2,
    another verb -4. Ties by path and verb. Where no route has more than 0 points, the only
    route of the file, with a null score. Routes of one verb that an ask reaches for the same
    reasons (the file or its end, a last segment or one path inside another, or nothing but
    the verb) are all alike but for their order, so the first of them stands for them; if it
    has more points than the reasons give, those it stands for lose to it anyway.
    """
    low = lambda c: F.lower(F.trim(text_or_empty(c)))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    asks = (findings.select("task_id", low("file_path").alias("f_file"), F.upper(F.trim(text_or_empty("method"))).alias("f_method"), http_path("path").alias("f_path")).distinct())
    verb_of = F.upper(F.trim(text_or_empty("method")))
    known = (routes.select("task_id", "route_id", low("file_path").alias("r_file"), F.when(verb_of == "", "UNKNOWN").otherwise(verb_of).alias("r_method"), http_path("path").alias("r_path"), F.col("path").alias("r_raw")).distinct())
    pathed = known.filter("r_path <> ''")
    place = F.struct(F.col("r_raw").alias("path"), F.col("r_method").alias("method"), "route_id")
    f_path, r_path = F.col("f_path"), F.col("r_path")
    tag = lambda name, c: F.concat(F.lit(name), c)
    some = lambda *keys: F.array_compact(F.array(*keys))
    # A file is told by no key, by its whole name where it is the other's end, or by an end that is the other's whole name.
    r_files = F.concat(F.array(F.lit("")), F.when(F.col("r_file") != "", F.concat(F.transform(_ends("r_file"), lambda x: tag("a:", x)), F.array(tag("b:", F.col("r_file"))))).otherwise(F.array()))
    f_files = F.concat(F.array(F.lit("")), F.when(F.col("f_file") != "", F.concat(F.array(tag("a:", F.col("f_file"))), F.transform(_ends("f_file"), lambda x: tag("b:", x)))).otherwise(F.array()))
    filed = pathed.withColumn("file", F.explode(r_files))

    def stand_ins(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy("task_id", *by, "file", "r_method").agg(F.min(F.struct(place.alias("place"), "r_file", "r_path")).alias("r")).select("task_id", *by, "file", "r.place.route_id", "r_method", "r.r_file", "r.r_path", F.col("r.place.path").alias("r_raw"))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.withColumn("file", F.explode(f_files)).join(right, ["task_id", "key", "file"]).select(*asks.columns, "route_id", "r_method", "r_file", "r_path", "r_raw")

    named = lambda path: F.concat(F.array(F.lit("")), some(F.when(last(path) != "", tag("s:", last(path)))))
    by_name = stand_ins(filed.withColumn("key", F.explode(named(r_path))).filter("key <> '' OR file <> ''"), "key")
    by_path = stand_ins(filed.withColumn("key", r_path), "key")
    asked = asks.filter("f_path <> ''")
    inside = _contained(asked.select("task_id", f_path.alias("path")).union(pathed.select("task_id", r_path)).distinct())
    by_part = stand_ins(filed.join(inside.select("task_id", F.col("outer").alias("r_path"), F.col("inner").alias("key")), ["task_id", "r_path"]), "key")
    pairs = (
        meet(asks.withColumn("key", F.explode(named(f_path))), by_name).unionByName(meet(asked.withColumn("key", f_path), by_path.unionByName(by_part)))
        .unionByName(meet(asked.join(inside.select("task_id", F.col("outer").alias("f_path"), F.col("inner").alias("key")), ["task_id", "f_path"]), by_path))
    )
    verb = ~F.col("f_method").isin("", "UNKNOWN", "ANY")
    file_score = (
        F.when((f_path == "") & ~verb, 0).when((F.col("f_file") == "") | (F.col("r_file") == ""), 0).when(F.col("f_file") == F.col("r_file"), 12)
        .when(F.endswith("r_file", F.concat(F.lit("/"), "f_file")) | F.endswith("f_file", F.concat(F.lit("/"), "r_file")), 8).otherwise(0)
    )
    path_score = F.when(f_path == "", 0).when(f_path == r_path, 20).when(F.contains(f_path, r_path) | F.contains(r_path, f_path), 10).when((last(r_path) != "") & (last(r_path) == last(f_path)), 4).otherwise(0)
    verb_score = F.when(~verb, 0).when(F.col("f_method") == F.col("r_method"), 6).when(F.col("r_method") == "ANY", 2).otherwise(-4)
    key = ["task_id", "f_file", "f_method", "f_path"]
    scored = pairs.withColumn("score", file_score + path_score + verb_score).select(*key, "score", place.alias("place"))
    first = pathed.groupBy("task_id", "r_method").agg(F.min(place).alias("place"))
    same = asks.filter(verb).join(first.withColumnRenamed("r_method", "f_method"), ["task_id", "f_method"]).select(*key, F.lit(6).alias("score"), "place")
    any_ = asks.filter(verb).join(first.filter("r_method = 'ANY'").drop("r_method"), "task_id").select(*key, F.lit(2).alias("score"), "place")
    top = scored.unionByName(same).unionByName(any_).filter("score > 0").groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), "place")).alias("b"))
    alone = known.groupBy("task_id", F.col("r_file").alias("f_file")).agg(F.count(F.lit(1)).alias("n"), F.min("route_id").alias("only")).filter("n = 1")
    # Only asks without a best route need the only one of the file, whose n is 1; the others are spread instead of gathering by file.
    spread = F.when(F.col("b").isNull(), 1).otherwise(F.abs(F.xxhash64(*key) % 1_000_000) + 2)
    chosen = asks.join(top, key, "left").withColumn("n", spread).join(alone, ["task_id", "f_file", "n"], "left").select(*key, F.coalesce("b.place.route_id", "only").alias("best_route_id"), (-F.col("b.s")).alias("best_score"))
    out = findings.withColumns({"f_file": low("file_path"), "f_method": F.upper(F.trim(text_or_empty("method"))), "f_path": http_path("path")})
    return out.join(chosen, key, "left").drop("f_file", "f_method", "f_path")


def merge_known_routes(told: DataFrame, scanned: DataFrame) -> DataFrame:
    """Routes that a response tells and those that a scan found, once each by verb, path, handler and file (what is told first), the most important first: adds place."""
    both = told.withColumn("_from", F.lit(0)).unionByName(scanned.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    named = both.withColumns({"method": F.upper(F.coalesce("method", F.lit("UNKNOWN"))), "path": text_or_empty("path"), "handler": F.coalesce("handler", F.lit("Unknown")), "file_path": text_or_empty("file_path"), "auth": F.coalesce("auth", F.lit("Unknown"))})
    rest = [c for c in named.columns if c not in ("task_id", "method", "path", "handler", "file_path", "_from", "ordinal")]
    once = named.groupBy("task_id", "method", "path", "handler", "file_path").agg(F.min(F.struct("_from", "ordinal", *rest)).alias("_r"))
    out = once.select("task_id", "method", "path", "handler", "file_path", *[F.col(f"_r.{c}").alias(c) for c in rest]).withColumn("priority", route_priority())
    order = [F.desc("priority"), F.col("path"), F.col("method"), F.col("handler"), F.col("file_path")]
    return out.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy(*order)))


#: Words of a route that speak for a stage; words that do so more, and by how much; stages in order of preference.
STAGE_WORDS = {
    2: ("exec", "shell", "cmd", "command", "template", "deserialize", "script"),
    3: ("sql", "query", "search", "filter", "datasource", "promql", "clickhouse", "ldap", "redis", "raw", "where"),
    4: ("xss", "html", "render", "template", "redirect", "callback", "comment"),
    5: ("login", "auth", "token", "session", "password", "jwt", "oidc", "apikey", "api_key", "register", "captcha"),
    6: ("user", "role", "tenant", "permission", "admin", "owner", "authz", "acl", "policy", "scope", "team", "project"),
    7: ("config", "setting", "secret", "key", "webhook", "callback", "url", "cors", "debug"),
    8: ("upload", "download", "file", "path", "import", "export", "template", "attachment", "backup"),
    9: ("create", "update", "delete", "reset", "bind", "assign", "approve", "workflow", "order", "payment", "balance"),
}
STAGE_MORE = {6: (2, ("user", "role", "tenant", "permission")), 5: (5, ("login", "token", "password", "session")), 3: (2, ("query", "search", "datasource")), 8: (2, ("upload", "download", "file"))}
STAGE_ORDER = (5, 6, 3, 9, 8, 2, 7, 4)


def suggest_stage(routes: DataFrame, completed: DataFrame) -> DataFrame:
    """Routes with suggested_stage: of their task's completed stages (task_id, stage_num) the one that their words speak for most, ties in the order of preference; null without any."""
    text = F.lower(F.concat_ws("\n", *[text_or_empty(c) for c in ("method", "path", "handler", "file_path", "auth")]))
    done = completed.filter(F.col("stage_num").between(2, 9)).groupBy("task_id").agg(F.collect_set("stage_num").alias("_done"))
    made = fixed(routes.join(done, "task_id", "left"), _text=text)

    def score(stage: int) -> Column:
        n, words = STAGE_MORE.get(stage, (0, ()))
        return count_in("_text", STAGE_WORDS[stage]) + (F.when(any_in("_text", words), n).otherwise(0) if words else F.lit(0))

    each = F.array(*[F.struct(score(s).alias("score"), F.lit(-i).alias("order"), F.lit(s).alias("stage")) for i, s in enumerate(STAGE_ORDER)])
    best = F.array_max(F.filter(each, lambda x: F.array_contains(F.coalesce("_done", F.array().cast("array<int>")), x["stage"])))
    return made.withColumn("suggested_stage", best["stage"]).drop("_text", "_done")


def followup_batches(missing: DataFrame, most: int = 48, size: int = 6, batches: int = 2) -> DataFrame:
    """Per task, missing routes (suggested_stage, priority, route_id) dealt round-robin over their stages in batches: batch_no, stage, route_id, place.

    The best ``most`` candidates; a stage's routes by priority, ``size`` a batch; batches of
    all stages' first rounds come before second ones.
    """
    first = Window.partitionBy("task_id").orderBy(F.desc("priority"), "route_id")
    kept = missing.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most)
    place = F.row_number().over(Window.partitionBy("task_id", "suggested_stage").orderBy(F.desc("priority"), "route_id")) - 1
    queued = kept.withColumn("_round", F.floor(place / size)).withColumn("place", place % size)
    lead = Window.partitionBy("task_id", "suggested_stage")
    queued = queued.withColumn("_lead", F.min("_r").over(lead))
    no = F.dense_rank().over(Window.partitionBy("task_id").orderBy("_round", "_lead"))
    return queued.withColumn("batch_no", no).filter(F.col("batch_no") <= batches).select("task_id", "batch_no", F.col("suggested_stage").alias("stage_num"), "route_id", "priority", "place")
