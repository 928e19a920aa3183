"""URL filters by a temporal list join, in DataFrame operations only.

Dated list changes (a key is added to or removed from a list on a date) become validity
intervals. A capture matches an entry if the entry's key is its host, a parent domain of
the host, or the host with a prefix of the path's segments, and the entry was valid when
the page was fetched: an equi-join on the key with the interval as a further condition,
which is the as-of join of each capture with each key's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BROADCAST_ROWS, small


def host_of(url: Column) -> Column:
    """The host, lower-cased, without port, user and a last dot; an address in brackets with these; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@]*)", 1)
    return F.lower(F.regexp_replace(found, r"\.+$", ""))


def path_of(url: Column) -> Column:
    """The path, without query and fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """All keys that can match: d:domain for the host and its parents, h:host, u:host/path prefix by segment."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.array_remove(F.split(path_of(url), "/"), "")
    count = F.size(parts)
    prefixes = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat(F.lit("u:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(domains, F.array(F.concat(F.lit("h:"), host)), prefixes))


def intervals(changes: DataFrame) -> DataFrame:
    """Of changes (list_name, key, action 'add' or 'remove', changed_on): list_name, key, valid_from, valid_to.

    An entry is valid from an addition, inclusive, to the next change of its key, exclusive;
    an addition to a key that is on the list goes on with it. Of changes on the same day
    a removal comes last. Without a later change valid_to is null. Rows with null key,
    list, date or other actions are ignored; repeated rows count once.
    """
    clean = changes.filter(F.col("action").isin("add", "remove")).select("list_name", "key", "action", "changed_on").dropna().distinct()
    by = Window.partitionBy("list_name", "key").orderBy("changed_on", "action")
    return clean.withColumn("valid_to", F.lead("changed_on").over(by)).filter((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("changed_on")))).select("list_name", "key", F.col("changed_on").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, changes: DataFrame, capture_id: str = "page_id", url: str = "url", fetched: str = "fetched_on", broadcast_rows: int = BROADCAST_ROWS // 10) -> DataFrame:
    """Per capture: page_id, host, fetched_on, n_active (entries that match and were valid), lists (sorted array), blocked.

    Null or unusable URLs and captures without a date match nothing and are kept, not
    blocked. Captures that share id, URL and date get a row each. Extra columns are
    ignored; an empty list blocks nothing. A hot host's captures are joined with the few
    intervals of its keys: broadcast if counted and small, else by a sort-merge join that
    Spark splits where it is skewed.
    """
    caps = captures.select(F.col(capture_id).alias("page_id"), F.col(url).alias("url"), F.col(fetched).alias("fetched_on"))
    valid = small(intervals(changes), broadcast_rows)
    key = F.struct("page_id", F.xxhash64("url").alias("u"), "fetched_on").alias("capture")
    keyed = caps.select(key, "fetched_on", F.explode_outer(keys_of(F.col("url"))).alias("key")).distinct()
    active = keyed.join(valid, "key").filter((F.col("valid_from") <= F.col("fetched_on")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))))
    found = active.groupBy("capture").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("list_name")).alias("lists"))
    out = caps.select(key, host_of(F.col("url")).alias("host")).join(found, "capture", "left")
    return out.select("capture.page_id", "host", "capture.fetched_on", F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), F.col("n").isNotNull().alias("blocked"))
