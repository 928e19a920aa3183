"""Embedding near-duplicates over randomised-rotation binary codes.

1. Each vector is rotated at random; the signs of the rotated coordinates are its code,
   and the code's inner product with the rotated vector is stored as its correction
   factor. A code's product with any other rotated vector, divided by the factor, is an
   unbiased estimate of the cosine, and the factor bounds the estimate's error.
2. Crowded places become balls: vectors whose home (the first bits of the code) holds
   many are compared with the home's mean. Those within half the threshold's angle of
   it are linked with each other whatever they are, so a ball's inner links are its size
   less one, and it counts as one item from there on.
3. Items that share a band of code bits with one another meet, in blocks of bounded
   size. A pair is dropped when even the upper bound of its estimate is under the
   threshold (widened by the radii of balls), else its cosine is worked out in double
   precision. Vectors' links are counted on the spot; two balls, or a ball and a vector,
   are linked wholly, not at all or in part by the triangle inequality.
4. Only partly linked balls are opened: their members meet the other side's, in blocks.

Counts and a spanning set of links leave the blocks, never the pairs. How many bits a
band has follows from the largest group, and how many bands there are from the chance
``miss`` that a pair at the threshold shares none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .neardup import components
from .shared import Cut, mix, own_keys, signed, small, small_batches

#: Items that should share a bucket by chance, items of either side in a block, rows of a block that are compared at once.
CROWD, BLOCK, AT_ONCE = 1024, 2048, 256
#: Standard deviations of an estimate's bound; vectors that a home must hold to become a ball; slack of angles against rounding.
DEVIATIONS, LEAST_BALL, SLACK = 5.0, 16, 1e-6
COUNT, EDGE, WHOLE, PART = range(4)


@lru_cache(maxsize=8)
def rotation(size: int, number: int) -> np.ndarray:
    """A random rotation, the same one wherever it is asked for."""
    q, r = np.linalg.qr(np.random.default_rng((size, number)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(u: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: ``bits`` signs at least, of as many rotations as that takes, packed; and the correction factor of the first rotation."""
    size, signs, factor = u.shape[1], [], None
    for number in range(max(1, -(-bits // size))):
        y = u @ rotation(size, number).T
        signs.append(y >= 0)
        if factor is None:
            factor = np.abs(y).sum(axis=1) / math.sqrt(size)
    return np.packbits(np.concatenate(signs, axis=1), axis=1), factor


def estimates(y: np.ndarray, code: np.ndarray, factor: np.ndarray, deviations: float = DEVIATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of rotated unit vectors (rows) with coded ones (columns), and the error that each code's bound allows."""
    size = y.shape[1]
    signs = np.unpackbits(code, axis=1, count=size).astype(np.float32) * 2 - 1
    scale = 1 / (math.sqrt(size) * factor)
    error = deviations * np.sqrt(np.maximum(1 - factor**2, 0)) / (factor * math.sqrt(max(size - 1, 1)))
    return (y.astype(np.float32) @ signs.T) * scale.astype(np.float32), error + 1e-5


def bands_of(code: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """The number that each band of a code spells: one row a code."""
    flags = np.unpackbits(code, axis=1, count=bands * bits).reshape(len(code), bands, bits)
    return flags @ (1 << np.arange(bits, dtype=np.int64))


def home_of(code: np.ndarray, group: np.ndarray, bits: int) -> np.ndarray:
    flags = np.unpackbits(code, axis=1, count=bits).astype(np.uint64)
    return mix(flags @ (np.uint64(1) << np.arange(bits, dtype=np.uint64)), group.view(np.uint64)).view(np.int64)


def plan(largest: int, threshold: float, miss: float, crowd: int = CROWD) -> tuple[int, int]:
    """Bits of a band and bands, so that a band splits the largest group into ``crowd`` each and a pair at the threshold misses all bands with chance ``miss``."""
    bits = max(4, math.ceil(math.log2(max(largest, 1) / crowd)))
    agree = min((1 - math.acos(threshold) / math.pi) ** bits, 1 - 1e-12)
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def _rows(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _cells(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of equal key, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if held and held[0].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _encode(kind: str, bits: int, home_bits: int):
    """Usable vectors with code, factor and home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            length = pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False)
            values = x.flatten().cast(pa.float32() if kind == "<f4" else pa.float64()).to_numpy(zero_copy_only=False)
            start = length.cumsum() - length
            for size in np.unique(length[length > 0]).tolist():
                rows = np.flatnonzero(length == size)
                part = values[start[rows][:, None] + np.arange(size)]
                good = np.isfinite(part).all(axis=1) & (part != 0).any(axis=1)
                rows, part = rows[good], part[good]
                if not len(rows):
                    continue
                code, factor = codes(unit(part), bits)
                group = mix(batch.column("g").to_numpy().view(np.uint64)[rows], np.full(len(rows), size, np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(pa.array(rows)), pa.array(group), _packed(part.astype(kind)), _packed(code), pa.array(factor), pa.array(home_of(code, group, home_bits))],
                    ["k", "g", "x", "code", "f", "home"],
                )

    return run


def _sums(kind: str, most: int = 4096):
    """Sums of unit vectors by home, of what a task has read: one row a home, or more if they are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["home", "total"])
            held.clear()
            return made

        for batch in batches:
            home, x = batch.column("home").to_numpy(), batch.column("x")
            for h in np.unique(home).tolist():
                total = unit(_rows(x.take(pa.array(np.flatnonzero(home == h))), kind)).sum(axis=0)
                held[h] = held[h] + total if h in held else total
            if len(held) > most:
                yield out()
        yield out()

    return run


def _centres(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches, "home"):
            total = _rows(t["total"].combine_chunks(), "<f8").sum(axis=0, keepdims=True)
            if np.abs(total).max() > 1e-9:
                yield pa.RecordBatch.from_arrays([t["home"].combine_chunks().slice(0, 1), _packed(unit(total).astype(kind))], ["home", "c"])

    return run


def _assigned(kind: str, half: float):
    """Vectors with their ball, and the angle between them and its centre, where they are within ``half`` of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, angle = np.zeros(batch.num_rows, dtype=bool), np.zeros(batch.num_rows)
            by_size: dict[int, list[int]] = {}
            for i, c in enumerate(batch.column("c").to_pylist()):
                if c is not None:
                    by_size.setdefault(len(c), []).append(i)
            for rows in by_size.values():
                at = pa.array(rows)
                cos = (unit(_rows(batch.column("x").take(at), kind)) * unit(_rows(batch.column("c").take(at), kind))).sum(axis=1)
                angle[rows] = np.arccos(np.clip(cos, -1, 1)) + SLACK
                inside[rows] = angle[rows] <= half
            off = pa.array(~inside)
            names = ["k", "g", "x", "code", "f"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pc.if_else(off, None, batch.column("home")), pa.array(angle)], [*names, "ball", "angle"])

    return run


def _recoded(kind: str, bits: int):
    """Balls with the code and factor of their centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.binary_length(batch.column("x")).to_numpy(zero_copy_only=False)
            for size in np.unique(length).tolist():
                part = batch.take(pa.array(np.flatnonzero(length == size)))
                code, factor = codes(unit(_rows(part.column("x"), kind)), bits)
                names = ["ball", "node", "w", "r", "x"]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [_packed(code), pa.array(factor)], [*names, "code", "f"])

    return run


def _banded(bands: int, bits: int, carried: tuple[str, ...]):
    """A row for each band: bucket, band, carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                batch = whole.slice(i, 128)
                length = pc.binary_length(batch.column("code")).to_numpy(zero_copy_only=False)
                for size in np.unique(length).tolist():  # vectors of other sizes may have longer codes
                    part = batch.take(pa.array(np.flatnonzero(length == size)))
                    spelt = bands_of(_rows(part.column("code"), "u1"), bands, bits).astype(np.uint64)
                    group = part.column("g").to_numpy().view(np.uint64)
                    bucket = mix(mix(spelt, np.broadcast_to(np.arange(bands, dtype=np.uint64), spelt.shape)), np.broadcast_to(group[:, None], spelt.shape))
                    rows = pa.array(np.repeat(np.arange(part.num_rows), bands))
                    band = pa.array(np.tile(np.arange(bands, dtype=np.int32), part.num_rows))
                    yield pa.RecordBatch.from_arrays([signed(bucket.reshape(-1)), band, *(part.column(n).take(rows) for n in carried)], ["bucket", "band", *carried])

    return run


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of links between rows: the least row that each one reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _said(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(n.astype(np.int64))], ["kind", "a", "b", "n"])


def _met(kind: str, threshold: float, bands: int, bits: int):
    """Of each cell (two blocks of a bucket, or one with itself): what its items have to do with each other."""
    theta = math.acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches, "cell"):
            if t.num_rows < 2:
                continue
            node, w, r, side = (t[n].to_numpy() for n in ("node", "w", "r", "side"))
            u = unit(_rows(t["x"].combine_chunks(), kind))
            code, factor, band = _rows(t["code"].combine_chunks(), "u1"), t["f"].to_numpy(), t["band"][0].as_py()
            y, spelt = u @ rotation(u.shape[1], 0).T, bands_of(code, bands, bits)
            left, right = (np.flatnonzero(side == s) for s in (0, 1))
            one = not len(right) or not len(left)
            if one and t["paired"][0].as_py():  # two blocks should meet, and one of them is empty
                continue
            left, right = (np.arange(len(node)),) * 2 if one else (left, right)
            balls = w > 1
            linked: list[tuple[np.ndarray, np.ndarray]] = []
            for i in range(0, len(left), AT_ONCE):
                rows = left[i : i + AT_ONCE]
                est, error = estimates(y[rows], code[right], factor[right])
                wide = np.minimum(theta + r[rows][:, None] + r[right], math.pi) if balls.any() else np.full((1, 1), theta)
                a, b = np.nonzero(est + error.astype(np.float32) >= np.cos(wide))
                a, b = rows[a], right[b]
                if one:
                    a, b = a[a < b], b[a < b]
                cos = np.concatenate([(u[a[j : j + 65536]] * u[b[j : j + 65536]]).sum(axis=1) for j in range(0, len(a), 65536)] or [np.zeros(0)])
                both = ~balls[a] & ~balls[b]
                hit = both & (cos >= threshold)
                la, lb = a[hit], b[hit]
                if band:  # a pair that shares several buckets counts in that of its first common band
                    first = np.concatenate([~(spelt[la[j : j + 65536], :band] == spelt[lb[j : j + 65536], :band]).any(axis=1) for j in range(0, len(la), 65536)] or [np.zeros(0, bool)])
                    la, lb = la[first], lb[first]
                linked.append((la, lb))
                a, b, angle = a[~both], b[~both], np.arccos(np.clip(cos[~both], -1, 1))
                reach = r[a] + r[b]
                whole, near = angle + reach <= theta - SLACK, angle - reach <= theta + SLACK
                for said, sel in ((WHOLE, whole), (PART, near & ~whole)):
                    if sel.any():
                        low, high = np.minimum(node[a[sel]], node[b[sel]]), np.maximum(node[a[sel]], node[b[sel]])
                        yield _said(said, low, high, np.zeros(len(low)))
            la, lb = (np.concatenate(x) for x in zip(*linked, strict=True))
            if len(la):
                count = np.bincount(np.r_[la, lb], minlength=len(node))
                has = np.flatnonzero(count)
                yield _said(COUNT, node[has], node[has], count[has])
                least = _least(len(node), la, lb)
                joined = np.flatnonzero(least != np.arange(len(node)))
                yield _said(EDGE, node[joined], node[least[joined]], np.zeros(len(joined)))

    return run


def _opened(kind: str, threshold: float):
    """Of each cell (a block of a ball's members x a block of the vectors that ask for it): links of both sides, and of their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches, "cell"):
            k, node, asks = t["k"].to_numpy(), t["node"].to_numpy(), t["asks"].to_numpy(zero_copy_only=False).astype(bool)
            if asks.all() or not asks.any():
                continue
            u = unit(_rows(t["x"].combine_chunks(), kind))
            mine, theirs, count = np.flatnonzero(asks), np.flatnonzero(~asks), np.zeros(len(k), np.int64)
            for i in range(0, len(mine), AT_ONCE):
                hit = u[mine[i : i + AT_ONCE]] @ u[theirs].T >= threshold
                count[mine[i : i + AT_ONCE]] += hit.sum(axis=1)
                count[theirs] += hit.sum(axis=0)
            has = np.flatnonzero(count)
            if len(has):
                yield _said(COUNT, k[has], k[has], count[has])
                joined = np.unique(node[has[asks[has]]])
                yield _said(EDGE, joined, np.full(len(joined), node[theirs[0]]), np.zeros(len(joined)))

    return run


def _in_cells(rows: DataFrame) -> DataFrame:
    """Rows of a cell together and in sequence."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "cell").sortWithinPartitions("cell")


def _own(key: str, blocks: str):
    return F.pmod(F.xxhash64(key), F.col(blocks))


def _numbered(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, bool]:
    """Rows (k, id, x, label) with a number k of their own, in the order of ids, null ones last; and whether k is the id itself."""
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("x"), F.col(label).alias("label"))
    if own_keys(rows, "id"):
        return rows.withColumn("k", F.col("id").cast("long")), True
    return Cut(rows.orderBy(F.col("id").asc_nulls_last(), F.xxhash64("x", "label")).withColumn("k", F.monotonically_increasing_id())).df, False


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, miss: float = 1e-6, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    crowd: int = CROWD, block: int = BLOCK, least_ball: int = LEAST_BALL,
) -> DataFrame:
    """Per row: vec_id, n_links (other vectors of the same label with a cosine of ``threshold`` or more), component_id (smallest id reachable by links), kept.

    Cosines are in double precision; no link is under the threshold, and one at it is
    missed with chance ``miss``. Vectors that are null, empty, all zero or hold a null or
    non-finite component, and those without a label, link with nothing; neither do
    vectors of different lengths. Rows that share an id, equal rows as well, are vectors
    of their own, linked as any others; ``kept`` then holds for one row of a component,
    the first by id, and null ids come last. An empty table gives no row; other columns
    are ignored. Groups of near copies of any size are counted whole.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows, own = _numbered(vectors, vec_id, embedding, label)
    element = vectors.schema[embedding].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    largest = rows.filter("label IS NOT NULL").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, bands = plan(largest, threshold, miss, crowd)
    home_bits, theta = bits + 8, math.acos(threshold)
    usable = rows.filter("label IS NOT NULL AND x IS NOT NULL").select("k", F.xxhash64("label").alias("g"), "x")
    coded = Cut(usable.mapInArrow(_encode(kind, max(bands * bits, home_bits), home_bits), "k long, g long, x binary, code binary, f double, home long")).df

    # Balls: a home's mean, and what is near it.
    crowded = small(Cut(coded.groupBy("home").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_ball).select("home")).df)
    sums = coded.select("home", "x").join(crowded, "home", "left_semi").mapInArrow(_sums(kind), "home long, total binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    centres = Cut(sums.repartition(n, "home").sortWithinPartitions("home").mapInArrow(_centres(kind), "home long, c binary")).df
    placed = Cut(coded.join(small(centres), "home", "left").mapInArrow(_assigned(kind, theta / 2 - SLACK), "k long, g long, x binary, code binary, f double, ball long, angle double")).df
    sizes = placed.filter("ball IS NOT NULL").groupBy("ball").agg(F.min("k").alias("node"), F.count(F.lit(1)).alias("w"), F.max("angle").alias("r")).filter("w > 1")
    balls = Cut(sizes.join(centres, F.col("ball") == F.col("home")).select("ball", "node", "w", "r", F.col("c").alias("x")).mapInArrow(_recoded(kind, max(bands * bits, home_bits)), "ball long, node long, w long, r double, x binary, code binary, f double")).df
    named = Cut(placed.join(small(balls.select("ball", F.col("node").alias("lead"), "w")), "ball", "left").select("k", "g", "x", "code", "f", F.coalesce("lead", "k").alias("node"), F.coalesce("w", F.lit(1)).alias("w"))).df

    # Items meet by band; a ball goes wherever one of its members does, once.
    carried = ("node", "x", "code", "f")
    lone = named.filter("w = 1").mapInArrow(_banded(bands, bits, carried), "bucket long, band int, node long, x binary, code binary, f double").withColumns({"w": F.lit(1).cast("long"), "r": F.lit(0.0)})
    places = named.filter("w > 1").select("g", "code", "node").mapInArrow(_banded(bands, bits, ("node",)), "bucket long, band int, node long").groupBy("node", "bucket").agg(F.min("band").alias("band"))
    balled = places.join(small(balls.drop("ball")), "node")
    items = lone.unionByName(balled.select(lone.columns))
    many = small(Cut(items.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).filter("blocks > 1")).df)
    dealt = items.join(many, "bucket", "left").na.fill(1, ["blocks"]).withColumn("own", _own("node", "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    cells = dealt.select(F.xxhash64("bucket", low, high).alias("cell"), "band", *carried, "w", "r", (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).alias("paired"))
    said = "kind int, a long, b long, n long"
    found = Cut(_in_cells(cells).mapInArrow(_met(kind, threshold, bands, bits), said)).df

    # Partly linked balls: the one's members against what asks for them.
    pairs = lambda what: found.filter(F.col("kind") == what).select("a", "b").distinct()
    whole, part = Cut(pairs(WHOLE)).df, Cut(pairs(PART)).df
    weight = small(balls.select("node", "w"))
    sized = part.join(weight.select(F.col("node").alias("a"), F.col("w").alias("wa")), "a", "left").join(weight.select(F.col("node").alias("b"), F.col("w").alias("wb")), "b", "left").na.fill(1)
    # The larger side is the target, so its members are read once for all that ask.
    turned = F.col("wa") >= F.col("wb")
    asks = sized.select(F.when(turned, F.col("a")).otherwise(F.col("b")).alias("target"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("asking"), F.greatest("wa", "wb").alias("w"), F.least("wa", "wb").alias("q"))
    blocks = small(Cut(asks.groupBy("target").agg(F.ceil(F.max("w") / block).alias("m_blocks"), F.ceil(F.sum("q") / block).alias("q_blocks"))).df)
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    member = named.select("node", "k", "x")
    members = member.join(blocks.withColumnRenamed("target", "node"), "node").select(F.col("node").alias("target"), "node", "k", "x", _own("k", "m_blocks").alias("m"), spread("q_blocks").alias("q"), F.lit(False).alias("asks"))
    asking = asks.select("target", F.col("asking").alias("node")).join(member, "node").join(blocks, "target").select("target", "node", "k", "x", spread("m_blocks").alias("m"), _own("k", "q_blocks").alias("q"), F.lit(True).alias("asks"))
    opened = Cut(_in_cells(members.unionByName(asking).select(F.xxhash64("target", "m", "q").alias("cell"), "node", "k", "x", "asks")).mapInArrow(_opened(kind, threshold), said)).df

    counts = found.unionByName(opened).filter(F.col("kind") == COUNT).groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("own_links"))
    edges = found.unionByName(opened).filter(F.col("kind") == EDGE).select("a", "b").unionByName(whole)
    of = Cut(components(edges)).df
    # What a wholly linked pair gives each side is the other side's size.
    other = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(weight.withColumnRenamed("node", "b"), "b", "left").groupBy(F.col("a").alias("node")).agg(F.sum(F.coalesce("w", F.lit(1))).alias("whole_links"))
    linked = named.select("k", "node", "w").join(counts, "k", "left").join(other, "node", "left").join(of, "node", "left")
    total = linked.select("k", (F.col("w") - 1 + F.coalesce("own_links", F.lit(0)) + F.coalesce("whole_links", F.lit(0))).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    out = rows.select("k", "id").join(total, "k", "left").select("k", "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "k").alias("comp"))
    if not own:
        out = out.join(rows.select(F.col("k").alias("comp"), F.col("id").alias("comp_id")), "comp")
    back = F.col("comp").cast(vectors.schema[vec_id].dataType) if own else F.col("comp_id")
    return out.select(F.col("id").alias("vec_id"), "n_links", back.alias("component_id"), (F.col("k") == F.col("comp")).alias("kept"))
