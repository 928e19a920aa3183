"""Ranked lexical search over inverted treaps.

Documents become bags of the terms that the queries ask for, with one pass over the
texts. Each run of documents then gets a treap for every term: a binary search tree by
document, a heap by impact (what one occurrence pattern is worth before the term's
weight). All treaps of a query are traversed together over intervals of documents: the
weighted impacts at their roots bound what any document of the interval can score; an
interval whose bound can't enter the top k is dropped with all its subtrees, any other
is split at the document of its heaviest root, which is scored exactly. Runs are
independent of each other, and the best of all runs are the result.

Queries are taken in batches of bounded size, since every task holds a batch's terms;
the documents are read once a batch.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Cut, in_blocks, small_batches, texts

#: How many results a query has; the constants of the weight.
TOP, LENGTH_PERCENT = 10, 75
#: Bytes of query texts in a batch, postings in a run, intervals that are split together, bytes of a text that are split into terms together.
BATCH, RUN, TOGETHER, PIECE = 1 << 20, 1 << 21, 256, 1 << 20

#: Terms are runs of digits, letters and whatever isn't ASCII; A-Z are lower-cased, all else becomes a space.
_PLAIN = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in lists, each of about a piece of it."""
    at = 0
    while at < len(text):
        to = at + piece
        if to < len(text):  # not within a term
            part = text[at:to].translate(_PLAIN)
            back = part.rfind(b" ")
            while back < 0 and to < len(text):
                to += piece
                part = text[at:to].translate(_PLAIN)
                back = part.rfind(b" ")
            if to < len(text):
                part, to = part[:back], at + back + 1
        else:
            part = text[at:].translate(_PLAIN)
        yield part.split()
        at = to


def weight(n_documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * holding + 1)))


class Treaps:
    """The treaps of a run of documents: postings sorted by term and document, each a node with the places of its children."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        """``doc`` numbers the run's documents from 0."""
        order = np.lexsort((doc, term))
        term, self.doc, self.impact, self.n_docs = term[order], doc[order].astype(np.int32), impact[order], n_docs
        self.key = term.astype(np.int64) * n_docs + self.doc
        self.left, self.right = np.full(len(term), -1, dtype=np.int32), np.full(len(term), -1, dtype=np.int32)
        self.root: dict[int, int] = {}
        # Among equal impacts a hash of the document is the priority, as in any treap: else equal ones would make a list.
        priority = (self.impact << 20) + (self.doc.astype(np.int64) * 0x9E3779B1 >> 11 & 0xFFFFF)
        edges = np.flatnonzero(np.r_[True, term[1:] != term[:-1], True]) if len(term) else np.zeros(1, dtype=int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            self.root[int(term[a])] = a + self._build(priority[a:b], a, b)

    def _build(self, priority: np.ndarray, a: int, b: int) -> int:
        """One term's treap from its postings in document order, each put in at the right end of the tree so far."""
        rank, left, right, spine = priority.tolist(), [-1] * (b - a), [-1] * (b - a), []
        for i, p in enumerate(rank):
            below = -1
            while spine and rank[spine[-1]] < p:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        for side, made in ((self.left, left), (self.right, right)):
            x = np.array(made, dtype=np.int32)
            side[a:b] = np.where(x < 0, -1, x + a)
        return spine[0]

    def _within(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The roots of subtrees once they are held to documents from ``lo`` to before ``hi``; -1 where nothing is left."""
        at = np.flatnonzero(node >= 0)
        while len(at):
            n = node[at]
            d = self.doc[n]
            low, high = d < lo[at], d >= hi[at]
            node[at] = np.where(low, self.right[n], np.where(high, self.left[n], n))
            at = at[(low | high) & (node[at] >= 0)]
        return node

    def search(self, terms: dict[int, int], k: int, together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``k`` best, best first, equal scores by document; terms: the weight of each, repeats counted in."""
        held = [(t, w) for t, w in terms.items() if w > 0 and t in self.root]
        best, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not held:
            return best, scores
        term, w = (np.array(x, dtype=np.int64) for x in zip(*held, strict=True))
        nodes = np.array([[self.root[t] for t, _ in held]], dtype=np.int32)
        lo, hi = np.zeros(1, dtype=np.int32), np.full(1, self.n_docs, dtype=np.int32)
        worth = w * self.impact[nodes]
        bound, heaviest = worth.sum(axis=1), worth.argmax(axis=1)

        def alive(bound: np.ndarray, lo: np.ndarray) -> np.ndarray:
            if len(best) < k:
                return bound > 0
            return (bound > scores[-1]) | (bound == scores[-1]) & (lo < best[-1])

        while len(bound):
            now = np.arange(len(bound)) if len(bound) <= together else np.argpartition(bound, len(bound) - together)[-together:]
            rest = np.ones(len(bound), dtype=bool)
            rest[now] = False
            split = self.doc[nodes[now, heaviest[now]]]
            key = (term * self.n_docs + split[:, None].astype(np.int64)).ravel()
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            score = (np.where(self.key[at] == key, self.impact[at], 0).reshape(len(now), -1) * w).sum(axis=1)
            best, scores = np.r_[best, split], np.r_[scores, score]
            first = np.lexsort((best, -scores))[:k]
            best, scores = best[first], scores[first]
            parts = np.r_[lo[now], split + 1], np.r_[split, hi[now]]
            full = np.tile(nodes[now], (2, 1))
            width = full.shape[1]
            full = self._within(full.ravel(), np.repeat(parts[0], width), np.repeat(parts[1], width)).reshape(-1, width)
            worth = np.where(full >= 0, self.impact[full], 0) * w
            new = worth.sum(axis=1)
            own, rest = alive(new, parts[0]), np.flatnonzero(rest)
            rest = rest[alive(bound[rest], lo[rest])]
            nodes, bound = np.r_[nodes[rest], full[own]], np.r_[bound[rest], new[own]]
            heaviest = np.r_[heaviest[rest], worth[own].argmax(axis=1)]
            lo, hi = np.r_[lo[rest], parts[0][own]], np.r_[hi[rest], parts[1][own]]
        return best, scores


def in_batches(items: DataFrame, limit: int = BATCH) -> Iterator[list]:
    """The items (id, text) in lists of at most ``limit`` bytes or one item, each checked before it is fetched."""
    n = 1
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(0)) + 16
    # Rows alike go to batches of their own as well.
    dealt = Cut(items.withColumn("deal", F.xxhash64(F.col("id").cast("string"), "text", F.monotonically_increasing_id()))).df
    while True:
        held = dealt.groupBy(F.pmod("deal", F.lit(n)).alias("batch")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n"))
        if held.filter((F.col("size") > limit) & (F.col("n") > 1)).isEmpty():
            break
        n *= 2
    for batch in range(n):
        rows = dealt.filter(F.pmod("deal", F.lit(n)) == batch).select("id", "text").collect()
        if rows:
            yield rows


def _bags(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with a term: id, n (its terms with repeats), and of the vocabulary's terms the numbers and how often each occurs."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by a batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in in_blocks(batches):
            kept, n, terms, counts = [], [], [], []
            for i, text in enumerate(texts(batch)):
                total, found = 0, Counter()
                for words in terms_of(text):
                    total += len(words)
                    found.update(map(number, words))
                if total:
                    found.pop(None, None)
                    kept.append(i)
                    n.append(total)
                    terms.append(list(found))
                    counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["id", "n", "terms", "counts"])

    schema = T.StructType([documents.schema["id"]]).add("n", "long").add("terms", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.LongType()))
    return documents.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Bags put together or taken apart into runs of about ``limit`` postings."""
    held, size = [], 0
    for batch in batches:
        ends = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, before + limit - size, side="right")), at if held else at + 1)
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
            if to < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            at = to
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _searched(bags: DataFrame, queries: list[dict[int, int]], n_documents: int, n_terms: int, k: int, run_postings: int, together: int) -> DataFrame:
    """The best of each run for each query (its number): query, id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, run_postings):
            # Documents are numbered in the order of their ids, null ones last.
            part = part.take(pc.sort_indices(part.column("id")))
            lists, counts = part.column("terms"), part.column("counts").flatten().to_numpy()
            doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * part.column("n").to_numpy() * n_documents // n_terms
            treaps = Treaps(lists.flatten().to_numpy(), doc, 1_000_000_000 * counts // (1000 * counts + 8 * m[doc]), part.num_rows)
            for q, terms in enumerate(queries):
                best, scores = treaps.search(terms, k, together)
                if len(best):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q, dtype=np.int32)), part.column("id").take(pa.array(best)), pa.array(scores)], ["query", "id", "score"])

    return bags.select("id", "n", "terms", "counts").mapInArrow(run, T.StructType().add("query", "integer").add(bags.schema["id"]).add("score", "long"))


def rank(
    documents: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    batch_bytes: int = BATCH, run_postings: int = RUN, together: int = TOGETHER,
) -> DataFrame:
    """The ``k`` documents with the highest score above 0 for each item: item_id, rank (from 1), doc_id, score.

    Equal scores are ranked by ascending id, a null id last. Null and empty texts have no
    terms: such documents are never found and don't count, such items have no rows. Rows
    that share an id are documents, or items, of their own; equal rows of documents rank
    one after the other. Empty tables give no rows. Texts of any length are taken whole, and
    a term that all documents hold is counted before it is shuffled; other columns,
    whatever their names, are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    id_kind = asked.schema["id"].dataType
    found = []
    for rows in in_batches(asked, batch_bytes):
        vocabulary: dict[bytes, int] = {}
        counted = [Counter(vocabulary.setdefault(t, len(vocabulary)) for words in terms_of((r["text"] or "").encode()) for t in words) for r in rows]
        if not vocabulary:
            continue
        bags = Cut(_bags(docs, vocabulary)).df
        n_documents, n_terms = bags.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_documents:
            continue
        # One row a term of the batch.
        holding = dict(bags.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator())
        queries = [{t: c * weight(n_documents, holding[t]) for t, c in q.items() if t in holding} for q in counted]
        best = _searched(bags, queries, n_documents, n_terms, k, run_postings, together)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], T.StructType().add("query", "integer").add("item_id", id_kind))
        found.append(top.join(F.broadcast(names), "query").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    if not found:
        empty = T.StructType().add("item_id", id_kind).add("rank", "integer").add("doc_id", docs.schema["id"].dataType).add("score", "long")
        return spark.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, found)

