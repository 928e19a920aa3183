"""Files of projects: priority, roles, fingerprints, chunks and budgets.

Files are (project, ordinal, path, extension, size, content); ``ordinal`` is the listing's order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keywords import keyword_counts
from ..functions.paths import file_role, is_noise_path
from ..functions.rules import CODE_ENDINGS, DEFAULT_RULES, RISK_KEYWORDS, RISK_PATHS
from ..functions.text import contains_any, count_in, ends_with_any, fixed, split_lines, strip, strip_comments, text_or_empty, truncate, truncate_head
from .graph import checkpointed
from .running import running_totals

#: Worth of an extension, and terms of a path that raise a file's priority.
EXTENSION_SCORES = {
    ".py": 10, ".java": 10, ".php": 10, ".go": 10, ".rb": 10, ".cs": 10, ".js": 9, ".ts": 9, ".jsx": 8, ".tsx": 8, ".vue": 8, ".xml": 7, ".yaml": 7, ".yml": 7, ".json": 6,
    ".toml": 6, ".ini": 6, ".cfg": 6, ".env": 7, ".sql": 7, ".html": 5, ".htm": 5, ".css": 2, ".md": 1, ".txt": 1,
}
HIGH_TERMS = (
    "controller", "controllers", "action", "actions", "route", "router", "routes", "api", "endpoint", "handler", "view", "views", "auth", "login", "logout", "session", "cookie",
    "jwt", "token", "captcha", "security", "permission", "authorize", "authorization", "role", "roles", "acl", "middleware", "interceptor", "filter", "guard", "policy", "upload",
    "download", "file", "template", "attachment", "storage", "dao", "repository", "mapper", "model", "entity", "service", "manager", "admin", "member", "user", "account", "tenant",
    "owner", "config", "settings", "struts", "spring", "hibernate", "applicationcontext", "pom.xml", "package.json", "requirements.txt", "composer.json", "gemfile",
)
MEDIUM_TERMS = (
    "create", "update", "delete", "save", "edit", "search", "query", "execute", "order", "payment", "amount", "price", "workflow", "approve", "reject", "cache", "serializer",
    "deserialize", "crypto", "password", "secret",
)
MAX_FILE, MAX_FILES, MAX_CHUNKS, MAX_CHARS, CHUNK = 500_000, 1200, 2000, 2_000_000, 3000
HEAD_LINES, TAIL_LINES, HEAD_CHARS, TAIL_CHARS, RADIUS, MAX_WINDOWS = 45, 35, 1400, 1000, 18, 6


def file_priority(path: str, extension: Column, size: Column) -> Column:
    """How much a file is worth looking at; ``path`` names a fixed column in lower case with forward slashes."""
    worth = F.create_map(*[F.lit(x) for kv in EXTENSION_SCORES.items() for x in kv])[F.lower(text_or_empty(extension))]
    named = F.coalesce(worth, F.lit(0)) + 4 * count_in(path, HIGH_TERMS) + 2 * count_in(path, MEDIUM_TERMS)
    return F.when(is_noise_path(path), -30).otherwise(0) + named + F.when(size > MAX_FILE, 3).when(size <= 4096, 1).otherwise(0)


def select_files(files: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """Per project the files of highest priority, ties in listing order; adds score and file_rank.

    The best of each hash bucket are taken first, so that no task ranks a whole project.
    """
    low = fixed(files, _low=F.lower(F.replace(text_or_empty("path"), F.lit("\\"), F.lit("/"))))
    scored = fixed(low, score=file_priority("_low", F.col("extension"), F.col("size"))).drop("_low")
    order = [F.desc("score"), F.col("ordinal"), F.col("path")]
    near = scored.withColumn("_bucket", F.pmod(F.xxhash64("path", "ordinal"), F.lit(64)))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("project", "_bucket").orderBy(*order))).filter(F.col("_r") <= most).drop("_r", "_bucket")
    return near.withColumn("file_rank", F.row_number().over(Window.partitionBy("project").orderBy(*order))).filter(F.col("file_rank") <= most)


def fingerprint(files: DataFrame) -> DataFrame:
    """Per project: a hash of its sorted path|extension|size lines. Projects are bounded by their file limit."""
    line = F.concat_ws("|", text_or_empty("path"), text_or_empty("extension"), F.coalesce(F.col("size").cast("string"), F.lit("0")))
    return files.groupBy("project").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n_files"))


def strategy_fingerprint() -> str:
    """A hash of everything that tunes a scan: what was made under another one is stale."""
    parts = {
        "files": (MAX_FILE, MAX_FILES, MAX_CHUNKS, MAX_CHARS, CHUNK), "oversized": (HEAD_LINES, TAIL_LINES, HEAD_CHARS, TAIL_CHARS, RADIUS, MAX_WINDOWS), "extensions": EXTENSION_SCORES,
        "terms": (HIGH_TERMS, MEDIUM_TERMS), "keywords": RISK_KEYWORDS, "rules": [(r.label, r.hits, r.strong, r.medium, r.min_hits, r.min_weight, r.stages) for r in DEFAULT_RULES],
    }
    return hashlib.sha256(json.dumps(parts, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def file_index(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Files with role, content hash and the sum of their rule hits' scores."""
    risk = hits.groupBy("project", F.col("file_path").alias("path")).agg(F.sum("risk_score").alias("risk"))
    has = F.coalesce(F.col("content") != "", F.lit(False))
    return files.join(risk, ["project", "path"], "left").select(
        "project", "path", "size", "extension", F.when(has, F.coalesce(file_role(F.col("path"), F.substring("content", 1, 2000)), F.lit(""))).otherwise("").alias("role"),
        F.coalesce("risk", F.lit(0)).cast("long").alias("risk_score"), F.when(has, F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 16)).otherwise("").alias("content_hash"),
    )


def with_risk(chunks: DataFrame, keywords: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Chunks with risk_score and risk_labels. The text is stripped once and each label counted once; nothing is shuffled."""
    words = RISK_KEYWORDS if keywords is None else keywords
    low = F.lower(text_or_empty("base_file_path"))
    hay = fixed(chunks, _path=low, _hay=F.concat(low, F.lit("\n"), F.lower(strip_comments(F.substring(text_or_empty("content"), 1, 12_000)))))
    counted = fixed(hay, _n=keyword_counts("_hay", list(words.values())))
    score = F.aggregate("_n", F.lit(0), lambda acc, n: acc + F.least(n, F.lit(4)) * 3) + 2 * count_in("_path", RISK_PATHS) + ends_with_any("_path", CODE_ENDINGS).cast("int")
    labels = F.array_compact(F.array(*[F.when(F.col("_n")[i] > 0, F.lit(k)) for i, k in enumerate(words)]))
    return fixed(counted, risk_score=score, risk_labels=labels).drop("_path", "_hay", "_n")


def pack_lines(content: str, most: int) -> list[tuple[int, int, str]]:
    """Greedy chunks of whole lines: first and last line number and text. A line that is too long is a chunk of its own."""
    out, lines, start, held = [], content.split("\n"), 0, 0
    for i, line in enumerate(lines):
        if held and i > start and held + len(line) + 1 > most:
            out.append((start + 1, i, "\n".join(lines[start:i])))
            start, held = i, 0
        held += len(line) + 1
    out.append((start + 1, len(lines), "\n".join(lines[start:])))
    return out


def split_chunks(files: DataFrame, most: int = CHUNK) -> DataFrame:
    """Chunks of files: whole if short, else packed line by line. Packing starts anew after each chunk, so it runs over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"at": [], "chunk_idx": [], "file_path": [], "chunk_type": [], "content": []}
            for i, (path, content) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                content = content or ""
                if len(content) <= most:
                    parts = [(path, "full", content)] if content else []
                else:
                    parts = [(f"{path}#L{a}-{b}", "split", t) for a, b, t in pack_lines(content, most)]
                for k, (name, kind, t) in enumerate(parts):
                    for key, v in zip(rows, (i, k, name, kind, t), strict=True):
                        rows[key].append(v)
            at = pa.array(rows.pop("at"), pa.int64())
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
            cols = [batch.column(c).take(at) for c in ("project", "file_rank", "path")] + [pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=["project", "file_rank", "base_file_path", *rows])

    return files.select("project", F.col("file_rank").cast("long").alias("file_rank"), "path", "content").mapInArrow(
        run, f"project {files.schema['project'].dataType.simpleString()}, file_rank long, base_file_path string, chunk_idx int, file_path string, chunk_type string, content string"
    )


def oversized_chunks(files: DataFrame, keywords: tuple[str, ...] | None = None) -> DataFrame:
    """Chunks of oversized files: head, up to six windows around lines with keywords, tail; an excerpt if all are blank."""
    words = keywords or tuple(k for v in RISK_KEYWORDS.values() for k in v)
    lined = fixed(files, lines=split_lines(text_or_empty("content"))).filter(F.size("lines") > 0)
    hits = fixed(lined, hits=F.array_compact(F.transform("lines", lambda line, i: F.when(contains_any(F.lower(line), words), i))))
    spans = merge_windows(F.transform("hits", lambda i: F.struct(F.greatest(i - RADIUS, F.lit(0)).alias("lo"), F.least(i + RADIUS + 1, F.size("lines")).alias("hi"))), 3)
    spanned = fixed(hits, spans=F.slice(spans, 1, MAX_WINDOWS))
    part = lambda kind, suffix, text: F.struct(F.lit(kind).alias("chunk_type"), F.concat("path", suffix).alias("file_path"), text.alias("content"))
    head = strip(F.array_join(F.slice("lines", 1, HEAD_LINES), "\n"))
    tail = strip(F.array_join(F.slice("lines", F.greatest(F.size("lines") - TAIL_LINES + 1, F.lit(1)), TAIL_LINES), "\n"))
    windows = F.transform("spans", lambda s, i: part("oversized_signal", F.concat(F.lit("#signal"), (i + 1).cast("string"), F.lit(":L"), (s["lo"] + 1).cast("string"), F.lit("-"), s["hi"].cast("string")), strip(F.array_join(F.slice("lines", s["lo"] + 1, s["hi"] - s["lo"]), "\n"))))
    found = F.filter(F.concat(F.array(part("oversized_head", F.lit("#head"), truncate(head, HEAD_CHARS))), windows, F.array(part("oversized_tail", F.lit("#tail"), truncate_head(tail, TAIL_CHARS)))), lambda p: p["content"] != "")
    chosen = F.when(F.size("found") > 0, F.array_distinct("found")).otherwise(F.array(part("oversized_excerpt", F.lit("#excerpt"), truncate("content", HEAD_CHARS))))
    return fixed(spanned, found=found).select("project", F.col("file_rank").cast("long").alias("file_rank"), F.col("path").alias("base_file_path"), F.posexplode(chosen).alias("chunk_idx", "c")).select("project", "file_rank", "base_file_path", "chunk_idx", "c.file_path", "c.chunk_type", "c.content")


def merge_windows(windows: Column, gap: int) -> Column:
    """Ordered windows (lo, hi), those joined that begin no more than ``gap`` after the last ends."""
    start = F.array().cast("array<struct<lo:int,hi:int>>")
    last = lambda acc: F.element_at(acc, -1)
    grow = lambda acc, w: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["lo"].alias("lo"), F.greatest(last(acc)["hi"], w["hi"]).alias("hi"))))
    return F.aggregate(windows, start, lambda acc, w: F.when((F.size(acc) == 0) | (w["lo"] > F.coalesce(F.try_element_at(acc, F.lit(-1))["hi"], F.lit(-1)) + gap), F.concat(acc, F.array(F.struct(w["lo"].cast("int").alias("lo"), w["hi"].cast("int").alias("hi"))))).otherwise(grow(acc, w)))


def code_chunks(files: DataFrame, most: int = CHUNK, keywords: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Chunks with risk of selected files (with file_rank), within the project's budgets."""
    big = F.coalesce(F.col("size") > MAX_FILE, F.lit(False))
    words = None if keywords is None else tuple(k for v in keywords.values() for k in v)
    parts = split_chunks(files.filter(~big), most).unionByName(oversized_chunks(files.filter(big), words))
    return with_risk(within_budgets(parts), keywords)


def within_budgets(chunks: DataFrame, most_chunks: int = MAX_CHUNKS, most_chars: int = MAX_CHARS) -> DataFrame:
    """The first chunks of each project within both budgets; the last one is cut. Texts don't move to be counted; those within the budgets are joined back."""
    order = ["file_rank", "chunk_idx"]
    chunks = checkpointed(chunks)  # read twice, packed once
    kept = running_totals(chunks, ["project"], order, {"_n": F.lit(1), "_before": F.length("content")}, {"_n": most_chunks, "_before": most_chars})
    out = chunks.join(kept, ["project", *order]).withColumn("chunk_ordinal", (F.col("_n") + 1).cast("int"))
    return out.withColumn("content", F.substring("content", F.lit(1), (most_chars - F.col("_before")).cast("int"))).drop("_before", "_n")
