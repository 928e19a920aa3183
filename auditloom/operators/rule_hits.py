"""Rule hits and source-to-sink hints over chunks (project, chunk_ordinal, file_path, base_file_path, chunk_type, content, risk_score, risk_labels)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keywords import keyword_counts, keywords_first, keywords_held
from ..functions.paths import is_noise_path
from ..functions.rules import ACCEPT, DEFAULT_RULES, DEFAULT_SINKS, DEFAULT_SOURCES, LABEL_EVIDENCE, LABEL_PATHS, TRANSLATED, TRANSLATIONS, Rule
from ..functions.text import LINE_BREAK, any_in, ends_with_any, fixed, split_lines, strip_comments, text_or_empty, window_around


def _choose(label: Column, by_label: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for k, v in by_label.items():
        out = F.when(label == k, v) if out is None else out.when(label == k, v)
    return otherwise if out is None else out.otherwise(otherwise)


def _holds(test: tuple, path: str, evidence: str, hits: Column) -> Column:
    if test[0] == "hits":
        return hits >= test[1]
    what, wanted, markers = test
    found = ends_with_any(path, markers) if what == "ends" else any_in(path if what == "path" else evidence, markers)
    return found if wanted else ~found


def accepted(label: Column, path: str, evidence: str, hits: Column) -> Column:
    """Whether a hit of a label stands, by the lists of ACCEPT; ``path`` and ``evidence`` name fixed columns in lower case. Labels without a list stand, but in translations only one does."""
    kinds = {}
    for name, lines in ACCEPT.items():
        kinds[name] = F.lit(True)
        for line in lines:
            kinds[name] &= reduce(lambda a, b: a | b, (_holds(test, path, evidence, hits) for test in line))
    return F.when(any_in(path, TRANSLATIONS), label == TRANSLATED).otherwise(_choose(label, kinds, F.lit(True)))


def hit_score(label: Column, chunk_type: Column, base_risk: Column, path: str, hits: Column, weight: Column, evidence: str) -> Column:
    """Risk of the chunk, three a point of weight, two a hit; more for signal windows and a label's usual paths, less where a label's evidence is missing."""
    kind = F.when(chunk_type.startswith("oversized_signal"), 4).when(chunk_type.startswith("oversized_"), 2).otherwise(0)
    by_path = F.when(_choose(label, {k: any_in(path, v) for k, v in LABEL_PATHS.items()}, F.lit(False)), 4).otherwise(0)
    poor = {k: F.when(any_in(evidence, v), 0).otherwise(n) for k, (n, v) in LABEL_EVIDENCE.items()} | {"business": F.when(hits < 2, 8).otherwise(0)}
    return base_risk + 3 * weight + 2 * hits + kind + by_path - _choose(label, poor, F.lit(0))


def rule_hits(chunks: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, most: int | None = 120, accept: bool = True) -> DataFrame:
    """The best hit per (project, path, label), and of those the ``most`` of each project (None: all).

    A label counts only if the chunk has it. Hits are counted in the stripped text and
    evidence is taken from the text as it is. Equal scores: the earlier chunk wins. The
    stripped text is read once for all keywords of all labels, and the text itself once
    more, where any label has enough, for the first place of each.
    """
    made = chunks.filter(F.coalesce(F.trim("base_file_path") != "", F.lit(False)) & F.coalesce(F.col("content") != "", F.lit(False)) & (F.size("risk_labels") > 0))
    made = fixed(made.filter(~is_noise_path("base_file_path")), _low=F.lower(strip_comments(F.col("content"))), _path=F.lower("base_file_path"), _labels=F.transform("risk_labels", lambda x: F.lower(x)))
    counted = fixed(made, _n=keyword_counts("_low", [words for r in rules for words in (r.hits, r.strong, r.medium)])).drop("_low")

    def found(i: int, r: Rule) -> Column:
        n, weight = F.col("_n")[3 * i], 3 * F.col("_n")[3 * i + 1] + F.col("_n")[3 * i + 2]
        hit = F.struct(F.lit(r.label).alias("label"), F.lit(r.title).alias("title"), n.alias("n"), weight.alias("w"), F.array(*map(F.lit, r.stages)).cast("array<int>").alias("stage_nums"), F.lit(i).alias("rule"))
        return F.when(F.array_contains("_labels", r.label) & (n >= r.min_hits) & (weight >= r.min_weight), hit)

    hits = fixed(counted, _hits=F.array_compact(F.array(*[found(i, r) for i, r in enumerate(rules)]))).filter(F.size("_hits") > 0).drop("_n")
    raw = fixed(hits, _raw=F.lower("content"))
    placed = fixed(raw, _first=keywords_first("_raw", [r.hits for r in rules]), _lines=split_lines("content"))
    each = placed.withColumn("_h", F.explode("_hits")).drop("_hits").withColumn("_at", F.col("_first")[F.col("_h.rule")].cast("int")).filter("_at IS NOT NULL")
    line = F.size(F.split(F.substring(F.col("_raw").cast("binary"), F.lit(1), F.col("_at")).cast("string"), LINE_BREAK))
    shown = fixed(each, _evidence=window_around(F.col("_lines"), line, 2)).filter("_evidence <> ''").drop("_lines", "_raw", "_first", "_at")
    shown = fixed(shown, _e=F.lower("_evidence"))
    label = F.col("_h.label")
    if accept:
        shown = shown.filter(accepted(label, "_path", "_e", F.col("_h.n")))
    scored = shown.select(
        "project", label.alias("label"), "_h.title", F.trim("base_file_path").alias("file_path"), F.col("file_path").alias("chunk_path"), "chunk_type",
        hit_score(label, F.col("chunk_type"), F.col("risk_score"), "_path", F.col("_h.n"), F.col("_h.w"), "_e").alias("risk_score"),
        F.col("_h.n").alias("keyword_hit_count"), F.col("_h.w").cast("double").alias("weighted_score"), "_h.stage_nums", F.substring("_evidence", 1, 280).alias("evidence"), "chunk_ordinal",
    )
    best = Window.partitionBy("project", F.lower("file_path"), "label").orderBy(F.desc("risk_score"), "chunk_ordinal")
    out = scored.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r", "chunk_ordinal")
    return out if most is None else top(out, ["project"], [F.desc("risk_score"), F.col("file_path"), F.col("label")], most)


def top(df: DataFrame, by: list[str], order: list[Column], most: int, rank: str = "rank", spread: int = 32) -> DataFrame:
    """The first rows of each group; salted first, so a large group is no single task's work."""
    salted = df.withColumn("_s", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if df.schema[c].dataType.typeName() != "map"]), F.lit(spread)))
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order))).filter(F.col("_r") <= most).drop("_r", "_s")
    return near.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= most)


def source_sink_hints(chunks: DataFrame, routes: DataFrame, sources: dict[str, Sequence[str]] = DEFAULT_SOURCES, sinks: dict[str, tuple[str, Sequence[int], Sequence[str]]] = DEFAULT_SINKS, most: int | None = 120) -> DataFrame:
    """Chunks where a source and a sink of a label meet, with the routes of their file.

    ``sinks``: label -> (title, stages, keywords). The first chunk counts of those with the
    same path, label, first three routes and first three sinks (sorted).
    """
    own = routes.filter(F.coalesce(F.trim("file_path") != "", F.lit(False)) & F.coalesce(F.trim("path") != "", F.lit(False))).groupBy("project", F.trim("file_path").alias("base_file_path")).agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.trim("path").alias("path")))), lambda x: x["path"])).alias("route_paths")
    )
    low = fixed(chunks.filter(F.coalesce(F.trim("base_file_path") != "", F.lit(False))), _low=F.lower(strip_comments(F.substring(text_or_empty("content"), 1, 16_000)))).filter("_low <> ''")
    counts = fixed(low, _n=keyword_counts("_low", list(sources.values())))
    some = fixed(counts, source_types=F.array_compact(F.array(*[F.when(F.col("_n")[i] > 0, F.lit(k)) for i, k in enumerate(sources)]))).filter(F.size("source_types") > 0).drop("_n")
    found = fixed(some, _held=keywords_held("_low", [kws for _, _, kws in sinks.values()]))
    each = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(t).alias("title"), F.array(*map(F.lit, st)).cast("array<int>").alias("stage_nums"), F.col("_held")[i].alias("sinks")) for i, (k, (t, st, _)) in enumerate(sinks.items())])
    counted = found.withColumn("_h", F.explode_outer(each)).filter(F.size("_h.sinks") > 0).drop("_low", "_held")
    met = fixed(counted, _lines=split_lines(text_or_empty("content"))).join(own, ["project", "base_file_path"], "left").withColumn("route_paths", F.coalesce("route_paths", F.array().cast("array<string>")))
    label, labels = F.col("_h.label"), F.transform(F.coalesce("risk_labels", F.array().cast("array<string>")), lambda x: F.lower(x))
    agrees = F.exists(labels, lambda x: x == label) | ((label == "auth") & F.array_contains(labels, "business"))
    at = F.array_position(F.transform("_lines", lambda line: F.exists("_h.sinks", lambda k: F.contains(F.lower(line), k))), F.lit(True)).cast("int")
    window = F.when(at > 0, F.trim(F.array_join(F.slice("_lines", F.greatest(at - 3, F.lit(1)), at + 4 - F.greatest(at - 3, F.lit(1))), "\n"))).otherwise("")
    out = met.select(
        "project", F.col("_h.title").alias("title"), label.alias("label"), "_h.stage_nums", F.trim("base_file_path").alias("file_path"), F.trim("file_path").alias("chunk_path"), "source_types",
        F.slice("_h.sinks", 1, 8).alias("sink_keywords"), F.slice("route_paths", 1, 8).alias("route_paths"),
        (F.col("risk_score") + 4 * F.size("source_types") + 5 * F.size("_h.sinks") + F.when(F.size("route_paths") > 0, 4).otherwise(0) + F.when(agrees, 5).otherwise(0)).alias("risk_score"),
        F.substring(window, 1, 360).alias("evidence"), "chunk_ordinal",
    )
    first = Window.partitionBy("project", F.lower("file_path"), "label", F.array_join(F.slice("route_paths", 1, 3), ","), F.array_join(F.array_sort(F.slice("sink_keywords", 1, 3)), ",")).orderBy("chunk_ordinal")
    out = out.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "chunk_ordinal")
    return out if most is None else top(out, ["project"], [F.desc("risk_score"), F.col("file_path"), F.col("label")], most)
