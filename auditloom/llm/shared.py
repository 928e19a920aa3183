"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of rows that may be broadcast, both checked.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Bytes of text that a Python worker handles at a time, and of rows that it is sent at a time.
BLOCK_BYTES, BATCH_ROWS, BATCH_BYTES = 1 << 20, 1000, 8 << 20

_local_dirs: list[tempfile.TemporaryDirectory] = []
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or our own where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local_dirs:
            _local_dirs.append(tempfile.TemporaryDirectory(prefix="auditloom-"))
        found = f"file://{_local_dirs[0].name}"
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; the folder's owner clears what is left
            return


class Cut:
    """A written and reread table; ``drop()`` removes its files once nothing reads it any more."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/auditloom-{uuid.uuid4().hex}"
        _written.append((self.spark, self.path))
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)
        release(self.spark)

    def drop(self) -> None:
        _remove(self.spark, self.path)
        _written.remove((self.spark, self.path))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again, so a lost executor costs no recomputation."""
    return Cut(df).df


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def within(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes. Every task sums up its own rows, so none reads what others hold.

    A row counts 16 bytes, 8 for each of its columns, and what its strings, arrays and structs hold.
    """
    wide = [F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))) for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    wide += [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    held = F.lit(16 + 8 * len(df.columns))
    for w in wide:
        held = held + F.coalesce(w, F.lit(0))
    n, total = df.select(held.cast("long").alias("held")).agg(F.count(F.lit(1)), F.sum("held")).first()
    return n <= rows and (total or 0) <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, with a broadcast hint if it is measured and found small; otherwise Spark's own joins apply."""
    return F.broadcast(df) if within(df, rows) else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't got: ``name``, with as many underscores as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_keys(docs: DataFrame, doc_id: str = "doc_id") -> bool:
    """Whether ids are whole numbers, on one row each and never null, so that they can be keys as they are."""
    if not isinstance(docs.schema[doc_id].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return False
    return docs.select(F.col(f"`{doc_id}`").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("id").isNull()).isEmpty()


def keyed(docs: DataFrame, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """Texts (doc_id, text, also) as (k, text, also), k being unique and ordered as the ids are; and, where k isn't the id, the table (k, doc_id, h, n).

    ``h`` is xxhash64 of the text and ``n`` how many rows have both; these are one document,
    with the ``also`` of that whose hash is least. Documents of one id are in the order of
    ``h``; a null id comes last.
    """
    if own_keys(docs):
        return docs.select(F.col("doc_id").cast("long").alias("k"), "text", *also), None
    # Sorted by range, the running number of a partition's rows after those of earlier partitions keeps the order.
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), *also)
    ids = Cut(marked.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("doc_id").asc_nulls_last(), "h").withColumn("k", F.monotonically_increasing_id())).df
    one = marked.groupBy("doc_id", "h").agg(F.min_by(F.struct("text", *also), F.xxhash64(*also) if also else F.lit(0)).alias("one"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h"))
    return Cut(one.alias("a").join(ids.alias("b"), same).select("k", "a.one.*")).df, ids


def small_batches(spark: SparkSession) -> None:
    """Let Spark send smaller Arrow batches where its defaults hold: 10,000 texts at once fill several times their size."""
    for key, default, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", None, BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if default is None or now == default:
            try:
                spark.conf.set(key, str(ours))
            except Exception as e:  # a version without this setting
                if "maxBytesPerBatch" not in key:
                    raise e


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (size.cumsum() - size) // limit
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)
    trim()


def gathered(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """As in_blocks, but small batches are put together up to the limit as well."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in in_blocks(batches, text, limit):
        own = batch.column(text).nbytes
        if held and size + own > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def trim() -> None:
    """Give freed memory back: workers are used again, and what one stage held would add to the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not a GNU C library
        return


def texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    most = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x7F4A7C15F39CC060)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each ordered pair."""
    x = (a * _M1) ^ (b + _M3)
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive values, by doubling; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out, have, power, width = None, 0, h, 1
    while True:
        if k & width:
            part = power[have : have + n]
            out = part[:n] if out is None else mix(out[:n], part)
            have += width
        if have == k:
            return mix(out, np.uint64(k) * _M2) if k == 1 else out
        power = mix(power[:-width], power[width:])
        width *= 2


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))
