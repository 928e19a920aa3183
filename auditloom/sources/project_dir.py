"""Project directories and archives as files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import archive_member, is_noise_member
from ..functions.text import ends_with_any
from ..operators.rule_hits import top

#: Endings of source files, and directories that are left out beside those that begin with a dot.
EXTENSIONS = (
    ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".pyw", ".java", ".kt", ".scala", ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".rb", ".php", ".cs", ".swift", ".vue", ".svelte", ".sh",
    ".bash", ".zsh", ".sql", ".graphql", ".html", ".htm", ".css", ".scss", ".less", ".sass", ".json", ".yaml", ".yml", ".toml", ".xml", ".ini", ".cfg", ".md", ".txt", ".env",
)
SKIPPED = ("node_modules", "__pycache__", "dist", "build", "out", "target", "vendor", "venv", "env")
#: Encodings tried after UTF-8; the last takes any bytes.
ENCODINGS = ("gb18030", "gbk", "big5", "latin-1")
MAX_TREE, MAX_DEPTH = 10_000, 10
MAX_MEMBERS, MAX_MEMBER, MAX_TOTAL, MAX_RATIO = 20_000, 50 << 20, 1 << 30, 200
#: Bytes of members that are sent on at a time.
SENT = 8 << 20


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for data in batch.column("raw").to_pylist():
            for name in ENCODINGS:
                try:
                    out.append(data.decode(name))
                    break
                except UnicodeDecodeError:
                    continue
        at = batch.schema.get_field_index("raw")
        yield batch.set_column(at, "raw", pa.array(out, pa.string()))


def decode(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Bytes as text in column ``content``: UTF-8 where valid, in Spark itself; other encodings over Arrow."""
    fine = files.filter(F.expr(f"is_valid_utf8({raw})"))
    rest = files.filter(~F.coalesce(F.expr(f"is_valid_utf8({raw})"), F.lit(False)) & F.col(raw).isNotNull()).withColumnRenamed(raw, "raw")
    schema = rest.schema
    schema = T.StructType([T.StructField("raw", T.StringType()) if f.name == "raw" else f for f in schema.fields])
    text = rest.mapInArrow(_decoded, schema).withColumnRenamed("raw", "content")
    return fine.withColumn("content", F.regexp_replace(F.decode(F.col(raw), "UTF-8"), "^﻿", "")).drop(raw).unionByName(text)


def read_project(spark: SparkSession, path: str, project: str) -> DataFrame:
    """Source files below a directory: project, ordinal (listing order), path, extension, size, content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    named = raw.select(F.lit(project).alias("project"), F.substring("path", F.lit(len(root) + 1), F.length("path")).alias("path"), F.col("length").alias("size"), F.col("content").alias("raw"))
    return decode(listed(named))


def listed(files: DataFrame) -> DataFrame:
    """Of files with a path those of source, with extension and listing order; the first 10,000 of each project. Salted parts are ranked first, so no task lists a whole project."""
    dirs = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    kept = files.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    kept = kept.filter(F.col("extension").isin(*EXTENSIONS) & (F.size(dirs) <= MAX_DEPTH) & ~F.exists(dirs, lambda d: d.startswith(".") | d.isin(*SKIPPED)))
    first = top(kept.select("project", "path"), ["project"], [F.col("path")], MAX_TREE, "ordinal").withColumn("ordinal", F.col("ordinal").cast("long"))
    return kept.join(first, ["project", "path"])


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of ZIP files: archive, member, size, packed_size, raw. Each archive is one task's; limits are checked before anything is unpacked."""

    kinds = {"archive": pa.string(), "member": pa.string(), "size": pa.int64(), "packed_size": pa.int64(), "within_limits": pa.bool_(), "raw": pa.binary()}

    def rows(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                    total, packed = sum(i.file_size for i in infos), max(1, sum(i.compress_size for i in infos))
                    fits = len(infos) <= MAX_MEMBERS and total <= MAX_TOTAL and total <= MAX_RATIO * packed and all(i.file_size <= MAX_MEMBER for i in infos)
                    held, size = [], 0
                    for i in infos:
                        held.append((name, i.filename, i.file_size, i.compress_size, fits, z.read(i) if fits else None))
                        size += i.file_size if fits else 0
                        if size >= SENT or len(held) >= 1000:
                            yield rows(held)
                            held, size = [], 0
                    if held:
                        yield rows(held)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInArrow(run, "archive string, member string, size long, packed_size long, within_limits boolean, raw binary")
    return out.filter(~is_noise_member("member")).withColumn("path", archive_member("member"))


def write_index(df: DataFrame, path: str) -> None:
    """Overwrite the partitions of the projects in ``df`` and leave others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


def read_index(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame | None:
    """An index that was written; null if there is none or, where a fingerprint is asked for, it holds another."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return None if fingerprint and df.filter(F.col("fingerprint") == fingerprint).isEmpty() else df


def is_text_file(path: Column | str) -> Column:
    return ends_with_any(F.lower(F.col(path) if isinstance(path, str) else path), EXTENSIONS)
