"""Many keywords in one pass over a text.

Every keyword is filed under one of its runs of three bytes, the one that is likely to be
rarest. A batch of texts is read once: where such a run stands, and only there, the
keywords filed under it are compared. How long that takes does not grow with the number
of keywords but with what they have in common with the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are looked through at a time.
PIECE = 1 << 20
#: Texts that a worker is handed at a time.
BATCH_ROWS = 1000
#: How common bytes are in texts and code, roughly; the rest are rare. Only speed depends on it.
_COMMON = {b: len(" etaoinsrlcdu_.mpfgh") - i for i, b in enumerate(b" etaoinsrlcdu_.mpfgh")}
_NONE = np.iinfo(np.int64).max

Lists = tuple[tuple[str, ...], ...]


class KeywordIndex:
    """Finds where each of the distinct keywords begins first in each of many texts."""

    def __init__(self, words: Sequence[str]):
        self.words = tuple(dict.fromkeys(words))
        self.number = {w: i for i, w in enumerate(self.words)}
        filed: dict[int, list[tuple[int, int, bytes]]] = {}
        self.short: list[tuple[int, bytes]] = []
        for i, word in enumerate(self.words):
            raw = word.encode()
            if len(raw) < 3:
                self.short.append((i, raw))
                continue
            at = min(range(len(raw) - 2), key=lambda k: sum(_COMMON.get(b, 0) for b in raw[k : k + 3]))
            filed.setdefault(raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16, []).append((i, at, raw))
        self.runs = np.array(sorted(filed), dtype=np.uint32)
        self.filed = [filed[r] for r in self.runs.tolist()]
        self.likely = np.zeros(1 << 16, dtype=bool)
        self.likely[self._slot(self.runs)] = True

    @staticmethod
    def _slot(run: np.ndarray) -> np.ndarray:
        return run * np.uint32(0x9E3779B1) >> np.uint32(16)

    def first(self, texts: pa.Array) -> np.ndarray:
        """The byte at which each keyword (column) begins first in each text (row); the greatest number if it doesn't occur."""
        if texts.null_count:
            texts = texts.fill_null("")
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        out = np.full((len(texts), len(self.words)), _NONE)
        held = texts.buffers()[2]
        data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
        if not len(texts):
            return out

        def put(word: int, start: np.ndarray, row: np.ndarray, raw: bytes, done: int, known: int) -> None:
            """Keeps the starts at which all of the word stands within its text; ``known`` bytes from ``done`` are known to."""
            ok = (start >= ends[row]) & (start + len(raw) <= ends[row + 1])
            start, row = start[ok], row[ok]
            for k, b in enumerate(raw):
                if not done <= k < done + known:
                    same = data[start + k] == b
                    start, row = start[same], row[same]
            np.minimum.at(out, (row, word), start - ends[row])

        for a in range(int(ends[0]), int(ends[-1]), PIECE):
            d = data[a : min(a + PIECE + 2, int(ends[-1]))].astype(np.uint32)
            for word, raw in self.short:
                where = np.flatnonzero(d[:PIECE] == raw[0]) + a if raw else np.zeros(0, np.int64)
                put(word, where, np.searchsorted(ends, where, side="right") - 1, raw, 0, 1)
            if len(d) < 3 or not len(self.runs):
                continue
            run = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
            where = np.flatnonzero(self.likely[self._slot(run)])
            file = np.minimum(np.searchsorted(self.runs, run[where]), len(self.runs) - 1)
            hit = self.runs[file] == run[where]
            where, file = where[hit] + a, file[hit]
            order = np.argsort(file, kind="stable")
            where, file = where[order], file[order]
            row = np.searchsorted(ends, where, side="right") - 1
            edges = np.flatnonzero(np.r_[True, file[1:] != file[:-1], True]) if len(file) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                for word, at, raw in self.filed[file[lo]]:
                    put(word, where[lo:hi] - at, row[lo:hi], raw, at, 3)
        for word, raw in self.short:
            if not raw:  # an empty keyword is in every text
                out[:, word] = 0
        return out


@lru_cache(maxsize=64)
def _index(lists: Lists) -> KeywordIndex:
    return KeywordIndex([w for words in lists for w in words])


def _listed(lists: Sequence[Sequence[str]]) -> Lists:
    return tuple(tuple(words) for words in lists)


def small_batches(spark: SparkSession) -> None:
    """Ten thousand whole texts at once fill a worker, so batches are of BATCH_ROWS where the session has the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def _over(text: Column | str, kind: str, run: Callable[[pa.Array], pa.Array]) -> Column:
    """``run`` over batches of texts, small ones, as every keyword has a place for each text."""
    small_batches(SparkSession.active())

    def looked_through(texts: pa.Array) -> pa.Array:
        return run(texts)

    return F.arrow_udf(looked_through, kind)(text)


def keyword_counts(text: Column | str, lists: Sequence[Sequence[str]]) -> Column:
    """How many entries of each list are substrings of the text, as an array; an entry that is listed twice counts twice, a null text holds none."""
    made = _listed(lists)

    def run(texts: pa.Array) -> pa.Array:
        index = _index(made)
        member = np.zeros((len(index.words), len(made)), dtype=np.int32)
        for k, words in enumerate(made):
            for w in words:
                member[index.number[w], k] += 1
        counts = (index.first(texts) < _NONE).astype(np.int32) @ member
        return pa.FixedSizeListArray.from_arrays(pa.array(counts.ravel()), len(made)).cast(pa.list_(pa.int32())) if made else pa.array([[]] * len(texts), pa.list_(pa.int32()))

    return _over(text, "array<int>", run)


def keywords_first(text: Column | str, lists: Sequence[Sequence[str]]) -> Column:
    """How many bytes of the text precede the first entry of each list that it holds, as an array; null where it holds none."""
    made = _listed(lists)

    def run(texts: pa.Array) -> pa.Array:
        index = _index(made)
        first = index.first(texts)
        least = np.stack([first[:, [index.number[w] for w in words]].min(axis=1, initial=_NONE) for words in made], axis=1)
        flat = pa.array(np.where(least < _NONE, least, 0).ravel(), pa.int64(), mask=(least == _NONE).ravel())
        return pa.FixedSizeListArray.from_arrays(flat, len(made)).cast(pa.list_(pa.int64()))

    return _over(text, "array<long>", run)


def keywords_held(text: Column | str, lists: Sequence[Sequence[str]]) -> Column:
    """The entries of each list that are substrings of the text, in list order, as an array of arrays."""
    made = _listed(lists)

    def run(texts: pa.Array) -> pa.Array:
        index = _index(made)
        there = index.first(texts) < _NONE
        rows = []
        for row in there:
            held = row.any()
            rows.append([[w for w in words if row[index.number[w]]] if held else [] for words in made])
        return pa.array(rows, pa.list_(pa.list_(pa.string())))

    return _over(text, "array<array<string>>", run)
