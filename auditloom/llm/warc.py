"""WARC: records read and written, and not-modified revisits resolved.

A revisit (a 304 answer) stores no body. It is resolved to the latest earlier full
response of the same canonical URL, if the validators agree; the stored headers are then
updated by those that a 304 answer may carry.

The as-of join sorts all records by (URL, time) into ranges, so a URL with a third of all
records is spread over many of them. Within a range a window carries the last response
forward; only URLs that reach over a range's edge, one a range at most, need the last
response of earlier ranges.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Cut

#: Records of a file that are sent on at a time.
RECORDS = 64

#: Headers that a 304 answer updates.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Host lower-cased without www., scheme, user and default port; path without trailing slash; query; no fragment."""
    clean = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    tail = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    path, query = F.regexp_extract(tail, r"^([^?]*)", 1), F.regexp_extract(tail, r"(\?.*)$", 1)
    return F.concat(host, F.regexp_replace(path, r"/+$", ""), query)


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then are equal the last counts."""
    each = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(each, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(each, lambda e: e["key"] == n), -1)["value"]))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, with the permitted ones of the 304 answer in their place."""
    new = F.map_filter(fresh, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(new, k)), new)


def resolve_revisits(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """Of records (record_id, warc_type, url, warc_date, status, headers, payload_digest): a row per revisit.

    record_id, canonical_url, warc_date, refers_to, refers_to_date, outcome, headers. A full
    response has type 'response' and status 200 (null: 200); a revisit has type 'revisit'.
    Earlier is strictly earlier in time; of responses at the same time the greatest
    record_id counts. Outcome: 'resolved' if the entity tags agree (weakly), or without
    both tags the modification dates, or without both of these the payload digests;
    'mismatch' if they don't; 'unverified' if there is nothing to compare; 'no_earlier'
    without an earlier response, a URL or a date. Headers are merged where the outcome is
    'resolved', else null; null headers are none. Repeated revisits get a row each; a repeated
    response counts once. Extra columns are ignored.
    """
    n = ranges or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    no_headers = F.create_map().cast("map<string,string>")
    full = (F.col("warc_type") == "response") & (F.coalesce("status", F.lit(200)) == 200)
    # Records are brought to form once; finding the ranges, dealing by them and what has no place all read that.
    rows = Cut(records.filter(full | (F.col("warc_type") == "revisit")).select(
        canonical_url(F.col("url")).alias("canonical_url"), "record_id", "warc_date", full.alias("full"), _lowered(F.coalesce("headers", no_headers)).alias("headers"), "payload_digest"
    )).df
    usable = F.col("canonical_url").isNotNull() & (F.col("canonical_url") != "") & F.col("warc_date").isNotNull()
    # At the same time revisits come first, so that they see earlier responses only.
    placed = Cut(rows.filter(usable).repartitionByRange(n, "canonical_url", "warc_date", "full", "record_id").withColumn("range", F.spark_partition_id()))
    answer = F.when(F.col("full"), F.struct("warc_date", "record_id", "headers", "payload_digest"))
    before = Window.partitionBy("range", "canonical_url").orderBy("warc_date", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.df.withColumn("last", F.last(answer, ignorenulls=True).over(before)).filter("NOT full")
    # The last response of each range, for the URLs that several ranges have.
    edges = placed.df.groupBy("canonical_url").agg(F.min("range").alias("lo"), F.max("range").alias("hi")).filter("lo < hi").select("canonical_url")
    pieces = placed.df.join(edges, "canonical_url").groupBy("canonical_url", "range").agg(F.max(F.when(F.col("full"), F.struct("warc_date", "record_id"))).alias("top"))
    carry = pieces.withColumn("top", F.last("top", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).filter("top IS NOT NULL")
    whole = placed.df.filter("full").dropDuplicates(["canonical_url", "warc_date", "record_id"]).select("canonical_url", F.struct("warc_date", "record_id").alias("top"), F.struct("warc_date", "record_id", "headers", "payload_digest").alias("carried"))
    carried = carry.join(whole, ["canonical_url", "top"]).select("canonical_url", "range", "carried")
    asof = near.join(carried, ["canonical_url", "range"], "left").withColumn("source", F.coalesce("last", "carried"))
    lost = rows.filter("NOT full").filter(~F.coalesce(usable, F.lit(False))).withColumn("source", F.lit(None).cast(asof.schema["source"].dataType))
    both = asof.select(*lost.columns).unionByName(lost)

    tag = lambda h: F.regexp_replace(h["etag"], r"^W/", "")
    old, new = F.col("source.headers"), F.col("headers")
    same = F.coalesce(tag(old) == tag(new), old["last-modified"] == new["last-modified"], F.col("source.payload_digest") == F.col("payload_digest"))
    outcome = F.when(F.col("source").isNull(), "no_earlier").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    return both.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "warc_date", F.col("source.record_id").alias("refers_to"), F.col("source.warc_date").alias("refers_to_date"), "outcome",
        F.when(F.col("outcome") == "resolved", merged_headers(old, new)).alias("headers"),
    )


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or with members compressed: headers (lower case), http status and headers, body."""
    at = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        at = gzip.GzipFile(fileobj=at)  # unpacked as it is read
    while line := at.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        head = _fields(at)
        body = at.read(int(head.get("content-length", "0")))
        http, status = {}, None
        if head.get("content-type", "").replace(" ", "").startswith("application/http;msgtype=response"):
            inner = io.BytesIO(body)
            first = inner.readline().split(None, 2)
            status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
            http, body = _fields(inner), inner.read()
        yield {"warc": head, "status": status, "http": http, "body": body}


def _fields(at: io.BufferedIOBase) -> dict[str, str]:
    out = {}
    while (line := at.readline().rstrip(b"\r\n")):
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def format_record(warc_type: str, url: str, date: str, record_id: str, status: int | None = None, http: dict[str, str] | None = None, body: bytes = b"", extra: dict[str, str] | None = None) -> bytes:
    """One record, with an HTTP response as its block where a status is given."""
    block = body
    kind = "application/octet-stream"
    if status is not None:
        kind = "application/http;msgtype=response"
        block = f"HTTP/1.1 {status} -\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in (http or {}).items()) + b"\r\n" + body
    head = {"WARC-Type": warc_type, "WARC-Target-URI": url, "WARC-Date": date, "WARC-Record-ID": record_id, "Content-Type": kind, **(extra or {}), "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files as resolve_revisits takes them. A file is read by one task, so files should be of usual size (1 GB); its records are sent on a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                records = iter(parse_records(data))
                while rows := list(islice(records, RECORDS)):
                    cols = [
                        pa.array([r["warc"].get("warc-record-id") for r in rows], pa.string()), pa.array([r["warc"].get("warc-type") for r in rows], pa.string()),
                        pa.array([r["warc"].get("warc-target-uri") for r in rows], pa.string()), pa.array([r["warc"].get("warc-date") for r in rows], pa.string()),
                        pa.array([r["status"] for r in rows], pa.int32()), pa.array([list(r["http"].items()) for r in rows], pa.map_(pa.string(), pa.string())),
                        pa.array([r["warc"].get("warc-payload-digest") for r in rows], pa.string()), pa.array([r["body"] for r in rows], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["record_id", "warc_type", "url", "warc_date", "status", "headers", "payload_digest", "body"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    out = files.mapInArrow(run, "record_id string, warc_type string, url string, warc_date string, status int, headers map<string,string>, payload_digest string, body binary")
    return out.withColumn("warc_date", F.to_timestamp("warc_date"))
