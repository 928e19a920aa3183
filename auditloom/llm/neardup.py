"""MinHash near-duplicates with sequential Bayesian verification and exact confirmation.

1. Every text becomes its set of distinct word shingles, a signature of 128 minima and a
   digest of the set; equal sets are one class, represented by the smallest id.
2. Representatives that agree on one of 32 bands of 4 minima meet in a bucket. A pair at
   the threshold 0.8 misses all bands with probability 0.5904^32 = 5e-8.
3. In each bucket all are compared with one of them, its centre: first on signatures, a
   batch of 16 minima at a time, dropping a pair as soon as the posterior probability of
   a similarity of the threshold or more falls under ``miss`` (uniform prior), then on
   the full sets. Confirmed links are joined into components.
4. Only buckets that hold several components are left. There each representative outside
   the bucket's largest component is compared with those of other components, in blocks
   of bounded size, by the same sequential test. Those of a cell of two blocks that take
   part in a pair that survives are named once each, however many pairs they are in;
   their texts meet on full sets in that cell again, and of the links found there only
   those are told that connect something new. So no group is ever expanded into its
   pairs, neither of texts nor of components, and no link between components is missed
   but at the two probabilities above.

A pair whose sets differ too much in size to be linked is dropped beforehand, exactly.

Components are found by alternating large-star and small-star steps with Spark joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Cut, WordHashes, grams, in_blocks, mix, signed, small, small_batches, texts

HASHES, BANDS, ROWS, BATCH = 128, 32, 4, 16
#: Representatives compared at a time within a bucket or a component.
BLOCK = 1024
#: Texts of either side that are compared at a time on full sets, and their shingles, about.
TEXT_BLOCK, SHINGLE_BLOCK = 256, 1_000_000
_rng = np.random.default_rng(20_240_607)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MUL = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingles(words: list[bytes], size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence is one if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = cache.of(words)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(grams(h, size))


def signature(s: np.ndarray) -> np.ndarray:
    low, out = (s ^ (s >> np.uint64(32))).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(out, ((low[i : i + 512, None] ^ _XOR) * _MUL).min(0), out=out)
    return out


def least_matches(threshold: float, miss: float) -> list[int]:
    """For 16, 32, .. minima: the fewest matches at which P(similarity >= threshold) is still ``miss`` or more.

    With a uniform prior the posterior is Beta(m+1, n-m+1), and its upper tail is the
    chance that n+1 draws at the threshold give m or fewer hits.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def sequential(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Indices of the rows of two signature arrays that no batch rules out."""
    live, seen = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, need in enumerate(least):
        cols = slice(i * BATCH, (i + 1) * BATCH)
        seen += (a[live, cols] == b[live, cols]).sum(1)
        ok = seen >= need
        live, seen = live[ok], seen[ok]
    return live


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in in_blocks(batches):
            n, key, sig = [], [], []
            for x in texts(batch):
                s = shingles(x.lower().split(), size, cache)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        if batch.num_rows:
            words = _matrix(batch.column("sig")).view(np.uint64).reshape(-1, BANDS, ROWS // 2)
            key = mix(mix(words[:, :, 0], words[:, :, 1]), np.broadcast_to(salt, words.shape[:2]))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            band = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([signed(key.reshape(-1)), band, batch.column("rep").take(rows)], names=["bucket", "band", "rep"])


def _pruned(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(sequential(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), least))
                names = ["a", "b", "n_a", "n_b"]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in names], names=names)

    return run


def _sized(na, nb, percent: int):
    """Whether sets of these sizes can be linked: they share the smaller one at most, and make up the larger one at least."""
    return 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)


def _linked(inter: np.ndarray | int, na, nb, percent: int):
    return 100 * inter >= percent * (na + nb - inter)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of equal key, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and held[0].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _crossed(least: list[int], percent: int):
    """Of each cell (query block x data block of a bucket): who may be linked with another component there, once each as what it is.

    Pairs of two queries are looked at from the smaller one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "cell"):
            t = t.combine_chunks()
            query, asks = (t[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("query", "asks"))
            sig, rep, comp, n = _matrix(t["sig"].combine_chunks()), t["rep"].to_numpy(), t["comp"].to_numpy(), t["n"].to_numpy()
            data = np.flatnonzero(~query)
            met = np.zeros(len(rep), bool)
            bands = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS // 2)
            own = t["band"][0].as_py()
            for i in np.flatnonzero(query):
                other = data[(comp[data] != comp[i]) & (~asks[data] | (rep[data] > rep[i])) & _sized(n[data], n[i], percent)]
                if not len(other):
                    continue
                live = other[sequential(np.broadcast_to(sig[i], (len(other), HASHES)), sig[other], least)]
                if own:  # a pair that shares several buckets counts in that of its first common band only
                    live = live[~(bands[live, :own] == bands[i, :own]).all(2).any(1)]
                met[live] = True
                met[i] = len(live) > 0
            if met.any():
                yield t.select(["cell", "rep", "n", "query"]).filter(pa.array(met)).combine_chunks().to_batches()[0]

    return run


def _compared(size: int, percent: int):
    """Of each cell (block of a target's queries x block of its members): links on full sets, but for those between what others connect already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for t in _groups(batches, "cell"):
            rep, query = t["rep"].to_numpy(), t["query"].to_numpy().astype(bool)
            text = t["text"].cast(pa.binary()).to_pylist()
            members = np.flatnonzero(~query)
            if not len(members) or not query.any():
                continue
            sets = [shingles(text[i].lower().split(), size, cache) for i in members]
            sizes = np.array([len(s) for s in sets])
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            a, b, above = [], [], {}

            def top(x: int) -> int:
                while x in above:  # noqa: B023
                    x = above[x]  # noqa: B023
                return x

            for i in np.flatnonzero(query):
                mine = shingles(text[i].lower().split(), size, cache)
                lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
                n = hi - lo
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
                inter = np.bincount(owner[at], minlength=len(sets))
                for other in rep[members[_linked(inter, len(mine), sizes, percent)]].tolist():
                    x, y = top(int(rep[i])), top(other)
                    if x != y:
                        above[max(x, y)] = min(x, y)
                        a.append(int(rep[i]))
                        b.append(other)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """Of undirected edges (a, b): node, comp (its component's smallest node).

    Large-star and small-star steps alternate; every step is joins and aggregations, and
    each round is written, so nothing is ever gathered and a lost executor loses a round.
    """
    now = Cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: a node's greater neighbours go to the least of them all.
        large = Cut(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: the smaller neighbours and the node itself go to the least one.
        pairs = large.df.join(large.df.groupBy("a").agg(F.min("b").alias("m")), "a")
        step = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(pairs.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = Cut(step)
        mark = tuple(after.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        large.drop()
        now.drop()
        now = after
        if mark == state:
            break
        state = mark
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.df.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _cells(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a cell together and in sequence; a cell is bounded, so is what a task holds of it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key)


def _spread(n: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _own(n: str):
    return F.pmod(F.xxhash64("rep"), F.col(n))


def exact_links(asks: DataFrame, members: DataFrame, with_text: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of asks and members (rep, target, n: their shingles): links (a, b) between those of one target, found on full sets of texts (rep, text), as many as connect what is linked.

    Queries and members of a target are dealt into blocks of bounded number and size and
    meet block by block. Only targets with several blocks are looked up, so most rows,
    and all those of a hot target, go straight to their cells.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        n, words = F.count(F.lit(1)) / TEXT_BLOCK, F.sum("n") / SHINGLE_BLOCK
        return df.groupBy("target").agg(F.ceil(F.greatest(n, words)).alias(name)).filter(F.col(name) > 1)

    many = Cut(blocks(asks, "q_blocks").join(blocks(members, "m_blocks"), "target", "full").na.fill(1))
    look = small(many.df)
    of = lambda df: df.join(look, "target", "left").na.fill(1, ["q_blocks", "m_blocks"])
    rows = of(members).select("target", "rep", _own("m_blocks").alias("m"), "q_blocks").select("target", "rep", "m", _spread("q_blocks").alias("q"), F.lit(False).alias("query"))
    rows = rows.unionByName(of(asks).select("target", "rep", _own("q_blocks").alias("q"), "m_blocks").select("target", "rep", "q", _spread("m_blocks").alias("m"), F.lit(True).alias("query")))
    cells = rows.join(with_text, "rep").select(F.xxhash64("target", "m", "q").alias("cell"), "rep", "text", "query")
    return _cells(cells, "cell").mapInArrow(_compared(shingle, percent), "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id linked with it, over any number of links), kept (it is the smallest).

    Words are runs of other than ASCII white space, A-Z lower-cased. Two documents are
    linked if the intersection of their shingle sets is ``percent`` per cent of the union
    or more. A text with fewer words than a shingle is one shingle; null, empty and blank
    texts have none and are linked with nothing. Rows that share an id are one node and
    get a row each; rows with a null id are linked with nothing, have a null component
    and are kept. Ids are integers. Extra columns are ignored; an empty table gives an
    empty result. Groups of any size are whole.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed_ = Cut(docs.mapInArrow(_sign(shingle), "doc_id long, n_shingles long, set_key binary, sig binary")).df
    usable = signed_.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    rep_of = Cut(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"))).df
    reps = Cut(usable.join(rep_of.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "sig", "n_shingles").dropDuplicates()).df
    least = least_matches(percent / 100, miss)

    banded = reps.select("rep", "sig").mapInArrow(_bands, "bucket long, band int, rep long")
    buckets = Cut(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("c")).filter("n > 1").select("bucket", "c"))
    shared = Cut(banded.join(buckets.df, "bucket")).df
    pairs = shared.filter("rep <> c").select(F.col("c").alias("a"), F.col("rep").alias("b")).distinct()
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    alike = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    likely = Cut(pairs.join(side("a"), "a").join(side("b"), "b").filter(alike).mapInArrow(_pruned(least), "a long, b long, n_a long, n_b long").distinct()).df
    met = Cut(shared.select("rep").distinct()).df
    involved = Cut(docs.select(F.col("doc_id").alias("rep"), "text").join(small(met), "rep", "left_semi")).df
    asks = likely.select(F.col("b").alias("rep"), F.col("a").alias("target"), F.col("n_b").alias("n"))
    centres = likely.select(F.col("a").alias("rep"), F.col("a").alias("target"), F.col("n_a").alias("n")).distinct()
    first = Cut(components(exact_links(asks, centres, involved, shingle, percent))).df

    # What is left: buckets with several components.
    named = shared.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "band", "rep", F.coalesce("comp", "rep").alias("comp"))
    parts = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    several = Cut(parts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("bucket", F.col("top.comp").alias("top"), F.ceil(F.col("all") / BLOCK).alias("d_blocks"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("q_blocks"))).df
    placed = named.join(several, "bucket").join(reps.select("rep", "sig", F.col("n_shingles").alias("n")), "rep").withColumn("asks", F.col("comp") != F.col("top"))
    # Each is data for every block of queries, and those outside the largest component ask every block of data; both are dealt from one row.
    dealt = lambda query, q, d: F.struct(F.lit(query).alias("query"), q.alias("q"), d.alias("d"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_data = F.transform(every("q_blocks"), lambda q: dealt(False, q, _own("d_blocks")))
    as_query = F.when(F.col("asks"), F.transform(every("d_blocks"), lambda d: dealt(True, _own("q_blocks"), d))).otherwise(F.array().cast("array<struct<query:boolean,q:bigint,d:bigint>>"))
    cells = placed.withColumn("at", F.explode(F.concat(as_data, as_query))).select(F.xxhash64("bucket", "at.q", "at.d").alias("cell"), "band", "rep", "comp", "sig", "n", "asks", "at.query")
    met_there = Cut(_cells(cells, "cell").mapInArrow(_crossed(least, percent), "cell long, rep long, n long, query boolean")).df
    asks, data = (met_there.filter(c).select("rep", F.col("cell").alias("target"), "n") for c in ("query", "NOT query"))
    more = exact_links(asks, data, involved, shingle, percent)
    found = more.join(first.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(first.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    second = Cut(components(found.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))).df

    upper = second.select(F.col("node").alias("comp"), F.col("comp").alias("upper"))
    of_rep = rep_of.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("comp", "rep").alias("comp")).join(upper, "comp", "left").select("set_key", F.coalesce("upper", "comp").alias("component"))
    out = signed_.join(of_rep, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
