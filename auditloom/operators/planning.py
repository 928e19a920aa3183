"""Evidence, plans under a budget, and selections of chunks and routes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.severity import SEVERITIES
from ..functions.text import count_in, fixed, text_or_empty
from .graph import checkpointed
from .rule_hits import top
from .running import running_totals

#: Stages that every plan has, and those that are planned at all.
BASELINE, STAGES = (2, 7, 9), tuple(range(2, 10))


def stage_evidence(*signals: DataFrame) -> DataFrame:
    """Per project and stage: how many hits and hints concern it."""
    all_of = None
    for s in signals:
        one = s.select("project", F.explode("stage_nums").alias("stage_num"))
        all_of = one if all_of is None else all_of.unionByName(one)
    return all_of.groupBy("project", "stage_num").agg(F.count(F.lit(1)).alias("evidence"))


def plan(projects: DataFrame, evidence: DataFrame, most: int | None = None) -> DataFrame:
    """Per project all stages 2 to 9: evidence, baseline, selected, priority (in stage order, null if skipped) and why one is skipped.

    Baseline stages and those with evidence are candidates; a budget keeps the baseline and then the most evidence.
    """
    every = projects.select("project").distinct().withColumn("stage_num", F.explode(F.array(*map(F.lit, STAGES))))
    full = every.join(evidence, ["project", "stage_num"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)).cast("long")).withColumn("baseline", F.col("stage_num").isin(*BASELINE))
    wanted = F.col("baseline") | (F.col("evidence") > 0)
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("_wanted"), F.desc("baseline"), F.desc("evidence"), "stage_num"))
    full = full.withColumn("_wanted", wanted).withColumn("_r", rank)
    full = full.withColumn("selected", F.col("_wanted") & (F.lit(True) if most is None else F.col("baseline") | (F.col("_r") <= most)))
    order = F.sum(F.col("selected").cast("int")).over(Window.partitionBy("project").orderBy("stage_num"))
    why = F.when(~F.col("selected"), F.when(F.col("evidence") > 0, "Skipped by fallback agent budget").otherwise("No supporting static evidence"))
    return full.withColumn("priority", F.when(F.col("selected"), order)).withColumn("skip_reason", why).drop("_wanted", "_r")


def with_focus(plans: DataFrame, focus: DataFrame) -> DataFrame:
    """A plan with what a model says on the same stage (guidance, files); its other stages are dropped."""
    extra = [c for c in focus.columns if c not in ("project", "stage_num", "seq")]
    first = focus.groupBy("project", "stage_num").agg(F.min(F.struct("seq", *extra)).alias("_f"))
    return plans.join(first, ["project", "stage_num"], "left").select(plans["*"], *[F.col(f"_f.{c}").alias(c) for c in extra])


def guard(planned: DataFrame, stages: DataFrame) -> DataFrame:
    """Per task: planned stages by what became of them, and whether all are done ('ok') or not ('blocked')."""
    state = planned.join(stages.select("task_id", "stage_num", "status"), ["task_id", "stage_num"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    of = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("stage_num"))))
    out = state.groupBy("task_id").agg(of(F.col("status").isin("completed", "skipped")).alias("done"), of(F.col("status") == "failed").alias("failed"), of(F.col("status") == "missing").alias("missing"), of(~F.col("status").isin("completed", "skipped", "failed", "missing")).alias("unresolved"))
    return out.withColumn("guard_status", F.when((F.size("failed") == 0) & (F.size("missing") == 0) & (F.size("unresolved") == 0), "ok").otherwise("blocked"))


def severity_counts(findings: DataFrame, by: list[str], column: str = "severity", otherwise: str = "Info") -> DataFrame:
    """A count of each severity, zeros included; null counts as ``otherwise``."""
    s = F.coalesce(column, F.lit(otherwise))
    return findings.groupBy(*by).agg(*[F.count_if(s == v).alias(v.lower()) for v in SEVERITIES])


def select_with_backfill(chunks: DataFrame, by: list[str], score: str, tie: list[str], most: int = 24, least: int = 12) -> DataFrame:
    """The best with a score over 0; if these are fewer than ``least``, the next best up to it. One rank serves both."""
    ranked = top(chunks, by, [F.desc(score), *map(F.col, tie)], max(most, least))
    good = F.sum((F.col(score) > 0).cast("int")).over(Window.partitionBy(*by))
    return ranked.withColumn("_good", good).filter(F.when(F.col(score) > 0, F.col("rank") <= most).otherwise(F.col("rank") <= least)).drop("_good")


def ranked_pools(pools: DataFrame, by: list[str], item: str, limits: dict[str, int], most: int = 24) -> DataFrame:
    """Distinct items of ranked pools (pool, pool_rank): the pools in the order of ``limits``, each up to its own limit, ``most`` in all."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(limits) for x in (k, i)])
    room = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    kept = pools.filter(F.col("pool_rank") <= room[F.col("pool")]).withColumn("_p", place[F.col("pool")])
    once = kept.groupBy(*by, item).agg(F.min(F.struct("_p", "pool_rank", "pool")).alias("_m"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_m._p", "_m.pool_rank", item))).filter(F.col("place") <= most).select(*by, item, F.col("_m.pool").alias("pool"), "place")


def shards(df: DataFrame, by: list[str], order: list[str], n: int = 8) -> DataFrame:
    """Rows of each group dealt to shards in turn."""
    return df.withColumn("shard", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) % n)


def ordered_union(rows: DataFrame, by: list[str], order: list[str], item: str, most: int | None = None) -> DataFrame:
    """Distinct trimmed items of each group in the order they first come, with their place."""
    t = F.trim(item)
    first = rows.withColumn("_t", t).filter(F.col("_t") != "").groupBy(*by, "_t").agg(F.min(F.struct(*order)).alias("_o"))
    out = first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_o", "_t")))
    return (out if most is None else out.filter(F.col("place") <= most)).select(*by, F.col("_t").alias(item), "place")


def running_budget(rows: DataFrame, by: list[str], order: list[str], text: str, limit: int, spread: int = 64) -> DataFrame:
    """The first texts of each group within a budget of characters; the one that crosses it is cut.

    ``order`` tells the rows of a group apart. Lengths are dealt by range of (group, order),
    so a group of any size is many tasks' work: sums of ranges give each its start, and only
    rows near the budget are left for the last sum. Texts don't move for it; those within
    the budget are joined back.
    """
    kept = running_totals(rows, by, order, {"_b": F.length(text)}, {"_b": limit}, spread)
    out = rows.join(kept, [*by, *order])
    return out.withColumn(text, F.substring(text, F.lit(1), (limit - F.col("_b")).cast("int"))).drop("_b")


def pass_fold(passes: DataFrame, by: list[str], order: list[str], scalars: list[str], arrays: list[str]) -> DataFrame:
    """Passes folded in order: a scalar's first value that isn't missing, an array's distinct items in the order they came."""
    pick = {c: F.min(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(*order, F.col(c).alias("v"))))["v"] for c in scalars}
    lists = {c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(c, F.array().cast(passes.schema[c].dataType)).alias("v")))), lambda x: x["v"]))) for c in arrays}
    return passes.groupBy(*by).agg(*[v.alias(k) for k, v in {**pick, **lists}.items()], F.count(F.lit(1)).alias("n_passes"))


def stage_samples(signals: DataFrame, sample: int = 5) -> DataFrame:
    """Per project and stage: how many signals, and the first files by name."""
    each = signals.select("project", "file_path", F.explode("stage_nums").alias("stage_num"))
    files = each.groupBy("project", "stage_num", "file_path").agg(F.count(F.lit(1)).alias("n"))
    first = top(files, ["project", "stage_num"], [F.col("file_path")], sample)
    names = first.groupBy("project", "stage_num").agg(F.array_sort(F.collect_list("file_path")).alias("files"))
    return files.groupBy("project", "stage_num").agg(F.sum("n").alias("n")).join(names, ["project", "stage_num"])


def token_usage(runs: DataFrame, by: list[str]) -> DataFrame:
    """Sums of tokens and the number of calls."""
    return runs.groupBy(*by).agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.count(F.lit(1)).alias("n_calls"))


def pass_progress(passes: DataFrame, by: list[str], order: str, item: str, total: DataFrame, enough: float = 0.995) -> DataFrame:
    """Per pass: distinct items so far, how many were new, the ratio to ``total`` (by, n_total), and whether that is enough to stop.

    An item counts where it first comes, so a running sum of firsts replaces running sets.
    """
    first = passes.groupBy(*by, item).agg(F.min(order).alias(order)).groupBy(*by, order).agg(F.count(F.lit(1)).alias("n_new"))
    every = passes.select(*by, order).distinct().join(first, [*by, order], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    seen = every.withColumn("n_seen", F.sum("n_new").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return seen.join(total, by, "left").withColumn("ratio", F.when(F.col("n_total") > 0, F.col("n_seen") / F.col("n_total")).otherwise(1.0)).withColumn("stop", F.col("ratio") >= enough)


def rescored(rows: DataFrame, by: list[str], score: str, bonuses: dict[str, tuple[Column, int]], tie: list[str], most: int) -> DataFrame:
    """The best rows of each group after bonuses (name -> condition, points), those over 0 only."""
    total = F.col(score)
    for condition, points in bonuses.values():
        total = total + F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0)
    return top(rows.withColumn("total", total).filter("total > 0"), by, [F.desc("total"), *map(F.col, tie)], most)


def pack_batches(items: DataFrame, batches: int = 8) -> DataFrame:
    """Components (project, comp, n) in batches: the largest first, each to the batch that holds least. Sequential, so a project is one task's; its components are bounded by its file limit."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "comp"], ascending=[False, True], ignore_index=True)
        load, place = [0] * batches, []
        for n in pdf["n"]:
            k = min(range(batches), key=lambda i: (load[i], i))
            load[k] += int(n)
            place.append(k)
        pdf["batch"] = place
        return pdf

    out = items.select("project", "comp", F.col("n").cast("long").alias("n"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.groupBy("project").applyInPandas(run, kinds + ", batch long")


def rerun_stages(requested: DataFrame, stages: DataFrame) -> DataFrame:
    """Per task, requested stages 2 to 9 with their last status and what follows: 'done', 'retry' or 'not_found'."""
    last = stages.groupBy("task_id", "stage_num").agg(F.max_by("status", "id").alias("status"))
    asked = requested.filter(F.col("stage_num").between(2, 9)).select("task_id", "stage_num").distinct()
    return asked.join(last, ["task_id", "stage_num"], "left").withColumn("outcome", F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "completed", "done").otherwise("retry"))


def salvaged_plan(responses: DataFrame, evidence: DataFrame, most: int | None = None) -> DataFrame:
    """Plans read from responses (project, content) that broke off: project, stage_num, reason, evidence, priority.

    The stages of its list of selected agents that can be read whole come first, then those
    that the list names in what is broken, then those that evidence calls for, baseline
    included, each as long as the budget lasts. Responses without a readable agent give no plan.
    """
    import pyarrow as pa

    from .responses import cleaned, list_objects

    def run(batches):
        for batch in batches:
            keep, nums, reasons = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                whole = [n for n in (_stage_of(x.get("stage_num")) for x in list_objects(text or "", "selected_agents")) if n]
                if not whole:
                    continue
                mark = text.find("[", text.find('"selected_agents"'))
                named = [int(n) for n in re.findall(r'"stage_num"\s*:\s*(\d+)', text[mark : _list_end(text, mark)])]
                for n, reason in dict.fromkeys([(n, "selected") for n in whole] + [(n, "partial_selected_agents_fragment") for n in named if 2 <= n <= 9 and n not in whole]):
                    keep.append(i)
                    nums.append(n)
                    reasons.append(reason)
            yield pa.RecordBatch.from_arrays([batch.column("project").take(pa.array(keep, pa.int64())), pa.array(nums, pa.int32()), pa.array(reasons, pa.string()), pa.array(range(len(keep)), pa.int32())], names=["project", "stage_num", "reason", "seq"])

    kind = responses.schema["project"].dataType.simpleString()
    read = responses.select("project", cleaned("content").alias("text")).mapInArrow(run, f"project {kind}, stage_num int, reason string, seq int")
    told = read.groupBy("project", "stage_num").agg(F.min(F.struct("seq", "reason")).alias("t")).select("project", "stage_num", F.lit(0).alias("pool"), F.col("t.seq").cast("long").alias("seq"), F.col("t.reason").alias("reason"))
    wanted = plan(told.select("project"), evidence, most).filter("selected").select("project", "stage_num", F.lit(1).alias("pool"), F.col("priority").cast("long").alias("seq"), F.lit("static_evidence_backfill").alias("reason"))
    each = told.unionByName(wanted).groupBy("project", "stage_num").agg(F.min(F.struct("pool", "seq", "reason")).alias("p"))
    placed = each.withColumn("priority", F.row_number().over(Window.partitionBy("project").orderBy("p.pool", "p.seq", "stage_num")))
    # What was read whole is never dropped; the rest fills the budget.
    placed = placed if most is None else placed.filter((F.col("priority") <= most) | (F.col("p.reason") == "selected"))
    return placed.join(evidence, ["project", "stage_num"], "left").select("project", "stage_num", F.col("p.reason").alias("reason"), F.coalesce("evidence", F.lit(0)).cast("long").alias("evidence"), "priority")


def _stage_of(value: object) -> int | None:
    try:
        n = int(value)
    except (TypeError, ValueError):
        return None
    return n if 2 <= n <= 9 else None


def _list_end(text: str, start: int) -> int:
    """Where the JSON list that begins at ``start`` ends; the text's end if it breaks off."""
    import json

    try:
        return json.JSONDecoder().raw_decode(text, start)[1]
    except ValueError:
        return len(text)


def review_context(findings: DataFrame, stages: DataFrame) -> DataFrame:
    """Per task what a review begins with: stages that ran (completed or with findings), findings in all and by severity, and a line a stage."""
    n = findings.groupBy("task_id", "stage_num").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    ran = stages.groupBy("task_id", "stage_num").agg(F.max_by("status", "id").alias("status"))
    both = ran.join(n, ["task_id", "stage_num"], "left").na.fill(0).filter((F.col("n") > 0) | (F.col("status") == "completed"))
    line = F.concat(F.lit("Stage "), F.col("stage_num").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" findings"))
    lists = F.array_sort(F.collect_list(F.struct("stage_num", line.alias("line"))))
    out = both.groupBy("task_id").agg(lists.alias("_l"), F.sum("n").alias("total_vulns"), *[F.sum(s.lower()).alias(s.lower()) for s in SEVERITIES])
    distribution = F.concat_ws(", ", *[F.concat(F.lit(f"{s}:"), F.col(s.lower()).cast("string")) for s in SEVERITIES])
    executed = F.array_join(F.transform("_l", lambda x: F.concat(F.lit("Stage "), x["stage_num"].cast("string"))), ", ")
    return out.select("task_id", executed.alias("executed_agents"), "total_vulns", distribution.alias("severity_distribution"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("agent_results_summary"))


#: Advice for the next scan, by what calls for it.
ADVICE = {
    "severe": "优先复核新增的严重和高危问题，先处理可直接形成利用链的入口点。",
    "compacted": "本轮存在大文件补偿切片，建议对相关大文件做人工抽查，避免关键信息落在切片边界之外。",
    "truncated": "存在审计文件数、代码块或总代码截断，建议针对核心入口文件单独精扫，降低上下文截断带来的漏报风险。",
    "dense": "规则命中数明显高于入库漏洞数，建议把规则命中最集中的目录作为下一轮定向审计范围。",
    "stable": "当前扫描覆盖和结果结构较稳定，下一轮可优先关注新增代码区域和新增高危问题。",
}


def recommendations(tasks: DataFrame) -> DataFrame:
    """Of rows (task_id, n_findings, critical, high, rule_hit_count, oversized_files_compacted, truncated): adds recommendations, at least one."""
    dense = F.col("rule_hit_count") >= F.greatest(F.col("n_findings") * 2, F.lit(20))
    some = F.array_compact(F.array(
        F.when(F.col("critical") + F.col("high") > 0, ADVICE["severe"]), F.when(F.col("oversized_files_compacted") > 0, ADVICE["compacted"]), F.when(F.col("truncated"), ADVICE["truncated"]), F.when(dense, ADVICE["dense"]),
    ))
    return tasks.withColumn("recommendations", F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(ADVICE["stable"]))))


def merged_batches(batches: DataFrame, soft_cap: int = 8) -> DataFrame:
    """Batches (project, batch, n_chars, n_chunks) merged, the smallest into the next smallest, until ``soft_cap`` are left: adds merged, the batch it went to. Sequential, so a project is one task's; its batches are bounded by its chunk limit."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("batch", ignore_index=True)
        live = {int(b): [int(c), int(n)] for b, c, n in zip(pdf["batch"], pdf["n_chars"], pdf["n_chunks"], strict=True)}
        into = {b: b for b in live}
        while len(live) > soft_cap:
            small, target = sorted(live, key=lambda b: (*live[b], b))[:2]
            chars, chunks = live.pop(small)
            live[target][0] += chars
            live[target][1] += chunks
            into = {b: target if t == small else t for b, t in into.items()}
        pdf["merged"] = [into[int(b)] for b in pdf["batch"]]
        return pdf

    out = batches.select("project", F.col("batch").cast("long").alias("batch"), F.col("n_chars").cast("long").alias("n_chars"), F.col("n_chunks").cast("long").alias("n_chunks"))
    return out.groupBy("project").applyInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields) + ", merged long")


#: Paths and contents that bring a chunk forward at the first look.
FORWARD_PATHS = (
    "main.py", "app.py", "server.js", "index.js", "manage.py", "/router", "/routers/", "/routes/", "/api/", "/controller", "/controllers/", "/middleware", "/auth", "/security", "urls.py", "package.json",
    "requirements.txt", "pyproject.toml", ".env",
)
FORWARD_CONTENT = ("include_router", "apirouter", "@router.", "@app.", "fastapi(", "jwt", "oauth", "session", "middleware", "auth", "login", "router.get(", "router.post(", "app.get(", "app.post(")
MAX_ENTRIES = 120


def skeleton(chunks: DataFrame, hubs: DataFrame | None = None, must_cover: DataFrame | None = None, roles: DataFrame | None = None) -> DataFrame:
    """Chunks for a first look at a project, one a path, with their place: up to 120 entry files by how much their path and text bring them forward, then the rest by hubs (project, path, hub_score), files that must be covered (project, path) and roles (project, path, role), ties by path.

    Chunks of little value are left out, unless a project has no others or must cover them.
    """
    from ..functions.chunks import is_entry, is_low_value

    c = chunks.withColumn("_low", F.lower(text_or_empty("file_path")))
    lower = lambda df: df.withColumn("_low", F.lower("path")).drop("path")
    c = c.join(lower(must_cover.select("project", "path").distinct()).withColumn("_must", F.lit(True)), ["project", "_low"], "left") if must_cover is not None else c.withColumn("_must", F.lit(False))
    c = c.join(lower(hubs.groupBy("project", "path").agg(F.max("hub_score").alias("_hub"))), ["project", "_low"], "left") if hubs is not None else c.withColumn("_hub", F.lit(0))
    c = c.join(lower(roles.groupBy("project", "path").agg(F.min("role").alias("_role"))), ["project", "_low"], "left") if roles is not None else c.withColumn("_role", F.lit(""))
    made = fixed(c, _head=F.lower(F.substring(text_or_empty("content"), 1, 4000)), _dull=is_low_value("file_path", "content", F.col("_must")), _entry=is_entry("file_path", "content"))
    forward = 3 * count_in("_low", FORWARD_PATHS) + 2 * count_in("_head", FORWARD_CONTENT) - F.least(F.floor(F.length("content") / 4000), F.lit(9))
    more = 2 * F.least(F.coalesce("_hub", F.lit(0)), F.lit(10)) + F.when(F.coalesce("_must", F.lit(False)), 50).otherwise(0)
    more = more + F.when(F.col("_role").isin("auth", "middleware", "config", "route"), 15).when(F.col("_role").isin("controller", "service"), 8).otherwise(0)
    scored = fixed(made, _forward=forward.cast("long"), _more=more.cast("long")).drop("_head")
    useful = scored.groupBy("project").agg(F.count_if(~F.col("_dull")).alias("_useful"))
    kept = scored.join(useful, "project").filter((F.col("_useful") == 0) | ~F.col("_dull"))
    order = F.struct((-F.col("_forward")).alias("f"), "chunk_ordinal")
    best = kept.groupBy("project", "_low").agg(F.min(F.when(F.col("_entry"), order)).alias("_as_entry"), F.min(F.struct((-F.col("_more")).alias("m"), (-F.col("_forward")).alias("f"), "chunk_ordinal")).alias("_as_other"))
    entries = top(best.filter("_as_entry IS NOT NULL"), ["project"], [F.col("_as_entry.f"), F.desc("_low")], MAX_ENTRIES, "_entry_place").select("project", "_low", "_entry_place")
    joined = best.join(entries, ["project", "_low"], "left")
    chosen = joined.select("project", "_low", "_entry_place", "_as_other", F.when(F.col("_entry_place").isNotNull(), F.col("_as_entry.chunk_ordinal")).otherwise(F.col("_as_other.chunk_ordinal")).alias("chunk_ordinal"))
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.col("_entry_place").asc_nulls_last(), "_as_other.m", "_low"))
    ranked = chosen.withColumn("place", place).select("project", "chunk_ordinal", "place", F.col("_entry_place").isNotNull().alias("is_entry"))
    return chunks.join(ranked, ["project", "chunk_ordinal"])


def second_pass(chunks: DataFrame, scanned: DataFrame, by: list[str], score: str, tie: list[str], most: int) -> DataFrame:
    """Of chunks whose path no pass has scanned (project, file_path) and that aren't of low signal the best ``most``."""
    from ..functions.chunks import is_low_signal

    path = lambda df: df.withColumn("_p", F.lower(F.trim(text_or_empty("file_path"))))
    left = path(chunks).join(path(scanned).select("project", "_p").filter("_p <> ''").distinct(), ["project", "_p"], "left_anti").drop("_p")
    base = F.coalesce(F.nullif("base_file_path", F.lit("")), F.col("file_path"))
    return top(left.filter(~is_low_signal(base)), by, [F.desc(score), *map(F.col, tie)], most)


#: Limits of what a stage is told, roomy and tight: characters of code and earlier context, routes and their text, rule hits, files in focus.
BUDGETS = {
    "exploit": ((18000, 1200, 8, 2200, 6, 24), (12000, 700, 5, 1400, 4, 16)), "auth": ((14000, 900, 6, 1600, 5, 18), (9000, 500, 4, 1000, 3, 12)),
    "access": ((24000, 1600, 10, 2800, 10, 28), (16000, 900, 6, 1800, 6, 20)), "light": ((14000, 1000, 6, 1800, 4, 18), (9000, 500, 4, 1200, 4, 12)),
}
BUDGET_OF = {2: "exploit", 3: "exploit", 4: "exploit", 8: "exploit", 9: "exploit", 5: "auth", 6: "access"}


def within_prompt_budget(contexts: DataFrame, tight: bool = False) -> DataFrame:
    """Of rows (stage_num, code, earlier, routes, rule_hits, focus_files): texts and lists cut to the stage's limits, adds route_chars."""
    names = ("code", "earlier", "routes", "route_chars", "rule_hits", "focus_files")
    rows = {s: dict(zip(names, BUDGETS[BUDGET_OF.get(s, "light")][tight], strict=True)) for s in range(1, 10)}
    limit = lambda k: F.create_map(*[F.lit(x) for s, v in rows.items() for x in (s, v[k])])[F.col("stage_num")]
    cut = lambda c: F.when(F.length(text_or_empty(c)) <= limit(c), text_or_empty(c)).otherwise(F.concat(F.substring(F.col(c), F.lit(1), F.greatest(limit(c) - 32, F.lit(0))), F.lit("\n... (truncated)\n")))
    first = lambda c: F.slice(F.coalesce(c, F.array().cast("array<string>")), F.lit(1), limit(c))
    return contexts.withColumns({"code": cut("code"), "earlier": cut("earlier"), "routes": first("routes"), "rule_hits": first("rule_hits"), "focus_files": first("focus_files"), "route_chars": limit("route_chars")})
