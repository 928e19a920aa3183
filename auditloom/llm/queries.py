"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fim, jpeg, licenses, lm, mixing, neardup, quality, ranked, substrings, urlfilter, vectors, warc
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: how many words lie in windows of items, and which items."""
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remainder(n: int):
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, by whole text and by line."""
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))
    return out.withColumn("line_licenses", F.array_join("line_licenses", ","))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods of all documents, learnt from nine in ten of them."""
    docs = table(spark, sf_dir, "documents")
    out = lm.score_documents(docs, remainder(10) != 0)
    return out.select("doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as JPEG images, read back, with features of their thumbnails."""
    return jpeg.store_texts(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the labels of three in four."""
    docs = table(spark, sf_dir, "documents")
    usable = F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2
    model = quality.train_model(docs, table(spark, sf_dir, "labels"), usable)
    out = quality.score_quality(docs.select("doc_id", "text"), model, "score")
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, on shingles of four words."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def _number(text, salt: str, n: int):
    """A number under n that follows from the text."""
    return F.conv(F.substring(F.md5(F.concat(text, F.lit(salt)).cast("binary")), 1, 6), 16, 10).cast("int") % n


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures over two years, against lists that add and remove hosts, domains and paths of theirs on dates of their own."""
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") * 37 % 730).cast("int")).alias("fetched_on"))
    hosts = captures.select(urlfilter.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    keys = hosts.select(
        F.explode(F.array(
            F.struct(F.lit("hosts").alias("list_name"), F.concat(F.lit("h:"), "host").alias("key")),
            F.struct(F.lit("domains").alias("list_name"), F.concat(F.lit("d:"), F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)).alias("key")),
            F.struct(F.lit("paths").alias("list_name"), F.concat(F.lit("u:"), "host", F.lit("/de")).alias("key")),
        )).alias("e")
    ).select("e.list_name", "e.key").distinct().filter(_number(F.col("key"), "x", 3) > 0)
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n)
    added = _number(F.col("key"), "a", 400)
    removed = added + 1 + _number(F.col("key"), "r", 200)
    changes = keys.select("list_name", "key", F.explode(F.array(
        F.struct(F.lit("add").alias("action"), day(added).alias("changed_on")), F.struct(F.lit("remove").alias("action"), day(removed).alias("changed_on")), F.struct(F.lit("add").alias("action"), day(removed + _number(F.col("key"), "b", 100)).alias("changed_on")),
    )).alias("c")).select("list_name", "key", "c.action", "c.changed_on")
    out = urlfilter.filter_urls(captures, changes)
    return out.withColumn("lists", F.array_join("lists", ",")).withColumn("fetched_on", F.col("fetched_on").cast("string"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the windows of 20 words that start earlier elsewhere."""
    return substrings.drop_repeats(table(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as crawl records: each page a response, and two later 304 answers and an earlier one for its URL, spelt otherwise."""
    # The page's digest is worked out once: what a generator yields is not put into the expressions above it.
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(F.md5(F.col("html").cast("binary")))).alias("digest"))
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    at = lambda minutes: F.timestamp_seconds(F.unix_timestamp(start) + minutes * 60)
    minute = F.col("page_id") * 7919 % 100_000
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit('"'))
    text = lambda c: c.cast("string")
    made = []
    for k, (kind, status, turn) in enumerate([("response", 200, 0), ("revisit", 304, 0), ("revisit", 304, 1), ("revisit", 304, 2)]):
        own = {"Content-Type": F.lit("text/html"), "ETag": tag, "Date": text(minute), "X-Cache": F.lit("miss")}
        when, url = minute, F.col("url")
        if kind == "revisit":
            when = minute + F.lit((-5, 30, 3000)[turn])
            url = F.regexp_replace(F.regexp_replace(url, r"^https?://(www\.)?", "HTTP://WWW."), "#.*$", "") if turn == 1 else F.concat(url, F.lit("#again"))
            seen = F.when(F.col("page_id") % 4 == turn, F.lit('"other"')).when(F.col("page_id") % 4 == 3, F.concat(F.lit("W/"), tag)).otherwise(tag)
            own = {"etag": seen, "date": text(when), "Cache-Control": F.concat(F.lit("max-age="), text(F.col("page_id") % 100)), "x-cache": F.lit("hit")}
        made.append(F.struct(
            (F.col("page_id") * 4 + k).alias("record_id"), F.lit(kind).alias("warc_type"), url.alias("url"), at(when).alias("warc_date"), F.lit(status).alias("status"),
            F.create_map(*[x for h, v in own.items() for x in (F.lit(h), v)]).alias("headers"), F.col("digest").alias("payload_digest"),
        ))
    records = pages.select(F.inline(F.array(*made)))
    out = warc.resolve_revisits(records)
    h = F.col("headers")
    return out.select("record_id", "canonical_url", "refers_to", "outcome", h["content-type"].alias("content_type"), h["etag"].alias("etag"), h["date"].alias("date"), h["cache-control"].alias("cache_control"), h["x-cache"].alias("x_cache"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights of their sources."""
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, linked within their labels."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and rearranged, with digests of the outputs and of the texts rebuilt from them."""
    out = fim.with_restored(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_media_jpeg": op3_media_jpeg,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_near_dedup": op5_near_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_source_mixing": op9_source_mixing,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_ranked_search": op11_ranked_search,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}

def _license_sql() -> str:
    def canonical(x: str) -> str:
        out = f"regexp_replace(coalesce({x}, ''), '{licenses.COPYRIGHT.replace('(?md)', '(?m)')}', '', 'g')"
        marks = licenses._UPPER + licenses._MARKS, (licenses._LOWER + licenses._PLAIN).replace("'", "''")
        out = f"translate({out}, '{marks[0]}', '{marks[1]}')"
        out = f"regexp_replace({out}, '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')"
        out = f"regexp_replace({out}, '[ \\n]*\\n[ \\n]*', chr(10), 'g')"
        for a, b in licenses.EQUIVALENT.items():
            out = f"replace({out}, '{a}', '{b}')"
        return f"trim(trim(regexp_replace({out}, '^\\n|\\n$', '', 'g')))"

    quoted = lambda table: ", ".join("({}, {})".format(*("'" + v.replace("'", "''") + "'" for v in (k, t))) for k, ts in table for t in ts)
    known, made = quoted([*licenses.KNOWN.items(), *licenses.FORMS.items()]), quoted(licenses.DIGESTS.items())
    return f"""
WITH raw(license_id, text) AS (VALUES {known}), made(license_id, h) AS (VALUES {made}),
every AS (SELECT sha256(replace({canonical("text")}, chr(10), ' ')) AS h, license_id FROM raw UNION ALL SELECT h, license_id FROM made),
known AS (SELECT h, min(license_id) AS license_id FROM every GROUP BY h),
d AS (SELECT doc_id, {canonical("text")} AS c FROM documents),
lines AS (SELECT doc_id, sha256(trim(unnest(string_split(c, chr(10))))) AS h FROM d),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM lines JOIN known USING (h) GROUP BY doc_id)
SELECT d.doc_id, sha256(replace(c, chr(10), ' ')) AS text_digest, k.license_id AS text_license, coalesce(f.n, 0) AS n_license_lines, coalesce(f.ids, '') AS line_licenses
FROM d LEFT JOIN known k ON k.h = sha256(replace(c, chr(10), ' ')) LEFT JOIN found f ON f.doc_id = d.doc_id
"""


ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op6_url_filters": r"""
WITH caps AS (SELECT page_id, url, DATE '2023-01-01' + CAST(page_id * 37 % 730 AS INTEGER) AS fetched_on,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS parts FROM pages),
hosts AS (SELECT DISTINCT host FROM caps WHERE host <> ''),
allkeys AS (SELECT 'hosts' AS list_name, 'h:' || host AS key FROM hosts UNION SELECT 'domains', 'd:' || regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) FROM hosts UNION SELECT 'paths', 'u:' || host || '/de' FROM hosts),
nums AS (SELECT *, CAST('0x' || md5(key || 'x')[1:6] AS INTEGER) % 3 AS x, CAST('0x' || md5(key || 'a')[1:6] AS INTEGER) % 400 AS a, CAST('0x' || md5(key || 'r')[1:6] AS INTEGER) % 200 AS r, CAST('0x' || md5(key || 'b')[1:6] AS INTEGER) % 100 AS b FROM allkeys),
valid AS (SELECT list_name, key, DATE '2023-01-01' + a AS lo, DATE '2023-01-01' + (a + 1 + r) AS hi FROM nums WHERE x > 0 AND b > 0
  UNION ALL SELECT list_name, key, DATE '2023-01-01' + (a + 1 + r + b), NULL FROM nums WHERE x > 0 AND b > 0
  UNION ALL SELECT list_name, key, DATE '2023-01-01' + a, DATE '2023-01-01' + (a + 1 + r) FROM nums WHERE x > 0 AND b = 0),
keyed AS (SELECT page_id, fetched_on, 'h:' || host AS key FROM caps WHERE host <> ''
  UNION SELECT page_id, fetched_on, 'd:' || array_to_string(string_split(host, '.')[i:], '.') FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM caps WHERE host <> '')
  UNION SELECT page_id, fetched_on, 'u:' || host || '/' || array_to_string(parts[1:i], '/') FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM caps WHERE host <> '')),
active AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists FROM keyed JOIN valid USING (key) WHERE fetched_on >= lo AND (hi IS NULL OR fetched_on < hi) GROUP BY page_id)
SELECT c.page_id, host, CAST(c.fetched_on AS VARCHAR) AS fetched_on, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, n IS NOT NULL AS blocked FROM caps c LEFT JOIN active USING (page_id)
""",
    "op8_warc_revisits": r"""
WITH p AS (SELECT page_id, url, '"' || md5(html)[1:12] || '"' AS tag, page_id * 7919 % 100000 AS m,
  regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS rest FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
  regexp_extract(rest, '^[^/?]*(.*)$', 1) AS tail FROM p),
u AS (SELECT *, host || regexp_replace(regexp_extract(tail, '^([^?]*)', 1), '/+$', '') || regexp_extract(tail, '(\?.*)$', 1) AS canonical_url FROM c),
rev AS (SELECT page_id, page_id * 4 + 1 + t.turn AS record_id, canonical_url, m + t.shift AS minute, page_id % 100 AS age,
  CASE WHEN page_id % 4 = t.turn THEN '"other"' WHEN page_id % 4 = 3 THEN 'W/' || tag ELSE tag END AS seen FROM u, (VALUES (0, -5), (1, 30), (2, 3000)) t(turn, shift)),
latest AS (SELECT r.*, u.page_id AS src, u.tag AS old, row_number() OVER (PARTITION BY r.record_id ORDER BY u.m DESC, u.page_id DESC) AS k FROM rev r LEFT JOIN u ON u.canonical_url = r.canonical_url AND u.m < r.minute),
o AS (SELECT *, CASE WHEN src IS NULL THEN 'no_earlier' WHEN regexp_replace(seen, '^W/', '') = old THEN 'resolved' ELSE 'mismatch' END AS outcome FROM latest WHERE k = 1)
SELECT record_id, canonical_url, src * 4 AS refers_to, outcome, CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type, CASE WHEN outcome = 'resolved' THEN seen END AS etag,
  CASE WHEN outcome = 'resolved' THEN CAST(minute AS VARCHAR) END AS date, CASE WHEN outcome = 'resolved' THEN 'max-age=' || age END AS cache_control, CASE WHEN outcome = 'resolved' THEN 'miss' END AS x_cache FROM o
""",
    "op5_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN n < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, len(w) AS n, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
same AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM same JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM c LEFT JOIN n USING (doc_id)
""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM wins) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_removed, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op10_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (SELECT item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS win FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(win) AS n FROM wins),
spots AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
cand AS (SELECT s.doc_id, s.n, s.i, d.w[s.i:s.i + s.n - 1] AS win FROM spots s JOIN d USING (doc_id)),
hit AS (SELECT c.doc_id, c.i, c.n, x.item FROM cand c JOIN wins x ON c.win = x.win),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)),
np AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(np.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(np.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN np USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op11_ranked_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
size AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
tot AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // l)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN size USING (doc_id), tot GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
""",
    "op12_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM link GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
r AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS pre, CASE WHEN b > a THEN array_to_string(u[a + 1:b], '') ELSE '' END AS mid,
  CASE WHEN n > b THEN array_to_string(u[b + 1:n], '') ELSE '' END AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
""",
}
