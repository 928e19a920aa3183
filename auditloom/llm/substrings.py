"""Substring de-duplication over a compacted De Bruijn graph of word k-mers.

Edges are the windows of 20 consecutive words, nodes the 19 words that two consecutive
edges share; an edge that starts earlier elsewhere is a repeat. Shuffling every edge would
cost many times the text, so edges leave their document in pieces: consecutive edges that
share their least 6-mer (by hash, the anchor), at most 15. The same edge has the same anchor
at the same offset wherever it occurs, so equal edges are always in pieces that meet on
the anchor.

1. Pieces are joined with the anchors that occur twice or more; the others end here. Pieces
   of equal content are one; its source is the earliest (document, start), all other
   occurrences are repeats whole.
2. Where an anchor has several contents, their sources, one a content, are opened into
   edges at their source coordinates, and equal edges found among them.
3. Repeated pieces and edges are the graph. Nodes get their in- and out-degrees, and what
   meets at a node with one in and one out is linked; links are followed by pointer
   doubling in joins, so every nonbranching path has a name and its parts an offset in it.
4. Occurrences of a path's parts that lie side by side, in the document and at the source,
   are one long span. A digest of the source's words, read at the source coordinates, goes
   to the span's document, where its own words must have the same; only then do they go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Cut, WordHashes, grams, in_blocks, keyed, mix, signed, small, small_batches, texts, within

#: Words of an anchor. A window of w words has w - ANCHOR + 1 of them.
ANCHOR = 6
#: Spans that a task is asked for of one source at a time, about.
SPANS = 4096
#: Words handled at a time; the low bits of a sort key that hold a position.
PIECE, LOW = 1 << 21, np.uint64((1 << 24) - 1)
_B1, _B2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_CHECK = (1 << 26) - 1


def _powers(base: int, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006 - kept between calls on purpose
    if len(_kept.get(base, ())) < n:
        out = np.full(max(n, 1 << 17), base, np.uint64)
        out[0] = 1
        _kept[base] = np.multiply.accumulate(out)
    return _kept[base][:n]


def _ranges(h: np.ndarray, base: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of h[a:b], wherever they are, as polynomials modulo 2^64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(base, len(h)), dtype=np.uint64)])
    return (total[b] - total[a]) * _powers(pow(base, -1, 1 << 64), len(h))[a]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, have = len(x) - w + 1, 1
    while have * 2 <= w:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[:n], x[w - have : w - have + n])


def segments(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of word hashes and the documents they belong to: anchor, content, check bits, first word and edges of each segment."""
    none = np.zeros(0, np.uint64)
    if len(h) < window:
        return none, none, none, none.astype(np.int64), none.astype(np.int64)
    g = grams(h, ANCHOR)
    least = _sliding_min((g & ~LOW) | np.arange(len(g), dtype=np.uint64), window - ANCHOR + 1)
    edge = np.flatnonzero(doc[: len(h) - window + 1] == doc[window - 1 :])
    at = (least[edge] & LOW).astype(np.int64)
    if not len(edge):
        return none, none, none, edge, edge
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (edge[1:] != edge[:-1] + 1)])
    first, count, at = edge[new], np.diff(np.r_[new, len(edge)]), at[new]
    end = first + count + window - 1
    shape = (count * 64 + at - first).astype(np.uint64)
    return g[at], mix(_ranges(h, _B1, first, end), shape), mix(_ranges(mix(h, h), _B2, first, end), shape) >> np.uint64(38), first, count


def _firsts(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether a row, in order of position, is the first of its document with these keys."""
    order = np.lexsort((*keys, doc))  # stable: equal ones stay in order
    same = doc[order][1:] == doc[order][:-1]
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.ones(len(doc), bool)
    out[order[1:][same]] = False
    return out


def _concatenated(docs: list[bytes], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    words = [x.split() for x in docs]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    h = np.concatenate([cache.of(w) for w in words]) if words else np.zeros(0, np.uint64)
    return h, lengths


def _segment_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in in_blocks(batches):
            h, lengths = _concatenated(texts(batch), cache)
            starts = lengths.cumsum() - lengths
            doc = np.repeat(np.arange(len(lengths)), lengths)
            found = []
            for a in range(0, max(len(h) - window + 1, 1), PIECE):  # pieces overlap by less than a window
                *keys, first, count = segments(h[a : a + PIECE + window - 1], doc[a : a + PIECE + window - 1], window)
                found.append((*keys, first + a, count))
            anchor, content, check, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
            own = doc[first] if len(first) else first
            leads = _firsts(own, content, anchor)
            place = ((first - starts[own]) << 32) | (check.astype(np.int64) << 5) | (count << 1) | leads
            yield pa.RecordBatch.from_arrays([signed(anchor), signed(content), batch.column("k").take(pa.array(own)), pa.array(place)], names=["anchor", "content", "k", "place"])

    return run


def _opened(window: int):
    """Of texts with pieces (anchor, content, pos, edges, whole, open): a row for each whole one, and rows for the edges of each open one, with their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in in_blocks(batches):
            h, lengths = _concatenated(texts(batch), cache)
            begins = lengths.cumsum() - lengths
            edge_hash, node = grams(h, window), grams(h, window - 1)
            listed = batch.column("parts")
            n = np.diff(listed.offsets.to_numpy())
            flat = listed.flatten()
            anchor, content, pos, count = (flat.field(i).to_numpy() for i in range(4))
            whole, opened = (flat.field(i).to_numpy(zero_copy_only=False).astype(bool) for i in (4, 5))
            doc = np.repeat(np.arange(len(n)), n)
            split = np.flatnonzero(opened)
            rows = np.repeat(split, count[split])
            start = pos[rows] + np.arange(len(rows)) - np.repeat(count[split].cumsum() - count[split], count[split])
            order = np.lexsort((start, doc[rows]))
            rows, start = rows[order], start[order]
            edge = edge_hash[begins[doc[rows]] + start]
            lead = _firsts(doc[rows], edge, anchor[rows])
            kept = np.flatnonzero(whole)
            own, at, size = np.concatenate([doc[kept], doc[rows]]), np.concatenate([pos[kept], start]), np.concatenate([count[kept], np.ones(len(rows), count.dtype)])
            cols = {
                "anchor": pa.array(np.concatenate([anchor[kept], anchor[rows]])), "part": pa.array(np.concatenate([content[kept], edge.view(np.int64)])),
                "is_edge": pa.array(np.arange(len(own)) >= len(kept)), "k": batch.column("k").take(pa.array(own)), "pos": pa.array(at.astype(np.int32)), "edges": pa.array(size.astype(np.int32)),
                "lead": pa.array(np.concatenate([np.ones(len(kept), bool), lead])), "u": signed(node[begins[own] + at]), "v": signed(node[begins[own] + at + size]),
            }
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def met_by(rows: DataFrame, table: DataFrame, on: list[str], hot: int = 256) -> DataFrame:
    """Rows joined with ``table`` (on, n, more), whose ``n`` says how many rows a key has. Keys of over ``hot`` rows are broadcast if they are few, so none of them fills a task."""
    frequent = Cut(table.filter(F.col("n") > hot)).df
    if not within(frequent) or frequent.isEmpty():
        return rows.join(table, on)  # nothing is hot, or the adaptive planner splits what is skewed
    rest = rows.join(F.broadcast(frequent.select(*on)), on, "left_anti").join(table.filter(F.col("n") <= hot), on)
    return rows.join(F.broadcast(frequent), on).unionByName(rest)


def nonbranching_paths(elements: DataFrame) -> DataFrame:
    """Of graph elements (id, u, v, edges), paths between nodes u and v: id, path (its first element), at (edges before it in the path).

    Two elements are linked where a node has one in and one out. The links are followed by
    pointer doubling: what an element points to points on for it, so a path of n elements
    takes log2(n) joins, two of them a round; each round is written, and only elements not
    yet at their path's start are joined. Elements of a circle have no start and stay
    paths of their own.
    """
    one = lambda node, name: elements.groupBy(F.col(node).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(name), F.min("edges").alias(f"{name}_edges")).filter("n = 1").drop("n")
    links = one("v", "before").join(one("u", "id"), "node").filter("before <> id").select("id", F.col("before").alias("path"), F.col("before_edges").cast("long").alias("at"))
    own = [F.coalesce("path", "id").alias("path"), F.coalesce("at", F.lit(0).cast("long")).alias("at"), F.col("path").isNotNull().alias("more")]
    state, left = Cut(elements.select("id").join(links, "id", "left").select("id", *own)), None

    def doubled(df: DataFrame) -> DataFrame:
        ahead = df.select(F.col("id").alias("path"), F.col("path").alias("far"), F.col("at").alias("beyond"), F.col("more").alias("further"))
        moved = df.filter("more").join(ahead, "path").select("id", F.col("far").alias("path"), (F.col("at") + F.col("beyond")).alias("at"), F.col("further").alias("more"))
        return df.filter("NOT more").unionByName(moved)

    while True:
        was, left = left, state.df.filter("more").count()
        if left in (0, was):  # all are at their starts, or only circles are left
            break
        after = Cut(doubled(doubled(state.df)))
        state.drop()
        state = after
    return state.df.select("id", F.when(F.col("more"), F.col("id")).otherwise(F.col("path")).alias("path"), F.when(F.col("more"), 0).otherwise(F.col("at")).alias("at"))


def _keyed(documents: DataFrame, doc_id: str, text: str, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []
    docs, ids = keyed(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *more), ("carry",) * bool(carry))
    return docs, None if ids is None else ids.select("k", "doc_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")


def repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Of texts (k, text): rows k, pos, words, digest; the words of document k from pos on are those of a place that starts earlier, whose digest this is."""
    docs = docs.select("k", "text")
    key = ["anchor", "content", "check"]
    check, lead = F.shiftright("place", 5).bitwiseAND(_CHECK).cast("int"), F.col("place").bitwiseAND(1) == 1
    pos, edges = F.shiftright("place", 32).cast("int"), F.shiftright("place", 1).bitwiseAND(15).cast("int")
    all_of = Cut(docs.mapInArrow(_segment_rows(window), "anchor long, content long, k long, place long"))
    twice = Cut(all_of.df.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("content") != F.max("content")).alias("a"), (F.min(check) != F.max(check)).alias("b")).filter("n > 1").select("anchor", "n", (F.col("a") | F.col("b")).alias("branching")))
    met = Cut(met_by(all_of.df, twice.df, ["anchor"]).drop("n").withColumn("check", check))
    all_of.drop()
    twice.drop()
    # The source is the least document's first occurrence: its lead.
    contents = Cut(met.df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("source"), F.min_by("place", F.when(lead, F.col("k"))).alias("source_place"), F.max("branching").alias("branching")).filter("n > 1 OR branching"))
    name = F.xxhash64("anchor", F.col("content").alias("part"), F.lit(False)).alias("id")
    sources = contents.df.select("anchor", "content", F.col("source").alias("k"), F.shiftright("source_place", 32).cast("int").alias("pos"), F.shiftright("source_place", 1).bitwiseAND(15).cast("int").alias("edges"), (F.col("n") > 1).alias("whole"), "branching")
    parts = sources.groupBy("k").agg(F.collect_list(F.struct("anchor", "content", "pos", "edges", "whole", "branching")).alias("parts"))
    opened = Cut(parts.join(docs, "k").select("k", "text", "parts").mapInArrow(_opened(window), "anchor long, part long, is_edge boolean, k long, pos int, edges int, lead boolean, u long, v long"))
    shared = Cut(opened.df.filter("is_edge").groupBy("anchor", "part").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("source"), F.min_by("pos", F.when(F.col("lead"), F.col("k"))).alias("source_pos"), F.min("u").alias("u"), F.min("v").alias("v")).filter("n > 1"))
    edge_name = F.xxhash64("anchor", "part", F.lit(True)).alias("id")
    elements = opened.df.filter("NOT is_edge").select(F.xxhash64("anchor", "part", "is_edge").alias("id"), "u", "v", "edges").unionByName(shared.df.select(edge_name, "u", "v", F.lit(1).alias("edges")))
    paths = Cut(nonbranching_paths(elements.dropDuplicates(["id"])))
    # The path of each piece and edge and its offset go where their sources are, so the many occurrences meet both at once.
    of_contents = Cut(contents.df.filter("n > 1").select(*key, "n", "source", F.shiftright("source_place", 32).cast("int").alias("source_pos"), name).join(paths.df, "id").drop("id"))
    of_edges = shared.df.select("anchor", "part", "n", "source", "source_pos", edge_name).join(paths.df, "id").drop("id")
    again = met_by(met.df, of_contents.df, key).filter((F.col("k") != F.col("source")) | ~lead).select("k", "path", "at", pos.alias("pos"), edges.alias("edges"), "source", "source_pos")
    later = opened.df.filter("is_edge").select("anchor", "part", "k", "pos", "lead").join(of_edges, ["anchor", "part"]).filter((F.col("k") != F.col("source")) | ~F.col("lead")).select("k", "path", "at", "pos", F.lit(1).alias("edges"), "source", "source_pos")
    # What lies side by side on one path, here and at the source, is one span. A part is its start and, in the low bits, its edges.
    part = F.shiftleft(F.col("pos").cast("long"), 8).bitwiseOR(F.col("edges").cast("long"))
    runs = again.unionByName(later).groupBy("k", "path", (F.col("pos") - F.col("at")).alias("shift"), "source", (F.col("pos") - F.col("source_pos")).alias("apart")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    parts = F.transform("parts", lambda x: F.struct(F.shiftright(x, 8).cast("int").alias("pos"), x.bitwiseAND(255).cast("int").alias("edges")))
    joined = F.when(F.size("parts") == 1, parts).otherwise(_joined(parts))
    spans = Cut(runs.select("k", "source", "apart", F.explode(joined).alias("s")).select("k", F.col("s.pos").alias("pos"), (F.col("s.edges") + window - 1).alias("words"), "source", (F.col("s.pos") - F.col("apart")).alias("source_pos")))
    for table in (met, contents, opened, shared, paths, of_contents):
        table.drop()
    asked = spans.df.groupBy("source", "source_pos", "words").agg(F.count(F.lit(1)).alias("n"))
    # A source that is asked for very many spans is read by several tasks, each with so many of them.
    asked = Cut(asked).df
    crowded = small(asked.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / SPANS).alias("turns")).filter("turns > 1"))
    dealt = asked.join(crowded, "source", "left").withColumn("turn", F.pmod(F.xxhash64("source_pos", "words"), F.coalesce("turns", F.lit(1))))
    read = dealt.groupBy(F.col("source").alias("k"), "turn").agg(F.collect_list(F.struct(F.col("source_pos").alias("pos"), "words", "n")).alias("asked"))
    digests = Cut(read.join(docs, "k").select("k", "text", "asked").mapInArrow(_digests, "source long, source_pos int, words int, n long, digest binary"))
    return met_by(spans.df, digests.df, ["source", "source_pos", "words"]).select("k", "pos", "words", "digest")


def _joined(parts: Column) -> Column:
    """Ordered (pos, edges), those put together that begin where the last end or before."""
    end = lambda x: x["pos"] + x["edges"]
    one = lambda pos, edges: F.struct(pos.cast("int").alias("pos"), edges.cast("int").alias("edges"))

    def add(acc: Column, x: Column) -> Column:
        open_ = acc["open"]
        return (
            F.when(open_["edges"] == 0, F.struct(acc["done"].alias("done"), one(x["pos"], x["edges"]).alias("open")))
            .when(x["pos"] <= end(open_), F.struct(acc["done"].alias("done"), one(open_["pos"], F.greatest(end(open_), end(x)) - open_["pos"]).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(open_)).alias("done"), one(x["pos"], x["edges"]).alias("open")))
        )

    start = F.struct(F.array().cast("array<struct<pos:int,edges:int>>").alias("done"), one(F.lit(0), F.lit(0)).alias("open"))
    return F.aggregate(parts, start, add, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


def words_digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts with places that are asked for: the digest of the words at each."""
    for batch in in_blocks(batches):
        rows = []
        for k, text, asked in zip(batch.column("k").to_pylist(), texts(batch), batch.column("asked").to_pylist(), strict=True):
            words = text.split()
            rows += [(k, a["pos"], a["words"], a["n"], words_digest(words[a["pos"] : a["pos"] + a["words"]])) for a in asked]
        cols = list(zip(*rows, strict=True))
        kinds = {"source": pa.int64(), "source_pos": pa.int32(), "words": pa.int32(), "n": pa.int64(), "digest": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def _kept_rows(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches):
            listed = batch.column("gone").to_pylist()
            n_words, n_removed, digest, kept_text, spans = [], [], [], [], []
            for text, gone in zip(texts(batch), listed, strict=True):
                words = text.split()
                n, cut_out, edges = len(words), 0, []
                if gone:
                    depth = np.zeros(n + 1, np.int64)
                    for g in gone:
                        end = g["pos"] + g["words"]
                        if words_digest(words[g["pos"] : end]) == g["digest"]:  # the words themselves, not only their hashes, are the source's
                            depth[g["pos"]] += 1
                            depth[end] -= 1
                    covered = depth.cumsum()[:n] > 0
                    cut_out = int(covered.sum())
                    turns = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
                    edges = [{"start": int(a), "len": int(b - a)} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                joined = b" ".join(words)
                n_words.append(n)
                n_removed.append(cut_out)
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept_text.append((joined if cut_out else text).decode())
                    spans.append(edges)
            cols = [batch.column("k"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["k", "n_words", "n_removed", "kept_sha256"]
            if "carry" in batch.schema.names:
                cols.append(batch.column("carry"))
                names.append("carry")
            if with_text:
                cols += [pa.array(kept_text, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32())])))]
                names += ["kept_text", "spans"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def drop_repeats(documents: DataFrame, window: int = 20, doc_id: str | Column = "doc_id", text: str = "text", with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256[, carry, a struct of these columns][, kept_text, spans].

    A word goes if a window of ``window`` words that covers it starts earlier as well: in
    a document with a smaller id, or earlier in the same one. Windows are judged on the
    input. Null and empty texts have no words; shorter texts than a window lose none.
    ``kept_text`` is the text itself if nothing was removed, else the kept words joined
    by one space; ``spans`` are the removed words (start, len). Rows that share an id and
    text are one document and get a row each; those that share the id alone are
    documents in the order of their texts' hashes; a null id comes last. Extra columns are
    ignored. ``window`` is from 7 to 20.
    """
    if not ANCHOR < window <= ANCHOR + 14:
        raise ValueError(f"window must be {ANCHOR + 1} to {ANCHOR + 14}")
    small_batches(documents.sparkSession)
    docs, ids = _keyed(documents, doc_id, text, carry)
    gone = repeats(docs, window).groupBy("k").agg(F.collect_list(F.struct("pos", "words", "digest")).alias("gone"))
    kinds = "".join(f"`{f.name}`:{f.dataType.simpleString()}," for f in (documents.schema[c] for c in carry))
    schema = "k long, n_words long, n_removed long, kept_sha256 string" + f", carry struct<{kinds[:-1]}>" * bool(carry) + ", kept_text string, spans array<struct<start:int,len:int>>" * with_text
    out = docs.join(gone, "k", "left").select(*docs.columns, "gone").mapInArrow(_kept_rows(with_text), schema)
    out = out.withColumnRenamed("k", "doc_id") if ids is None else ids.join(out, "k").drop("k")
    return out
