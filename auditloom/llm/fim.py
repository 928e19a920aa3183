"""Fill-in-middle: texts cut at two random units and rearranged for infilling, with an index of sparse checkpoints.

A unit is a run of letters A-Z or any other single character. While a text's units are
counted, every so many units a checkpoint records the unit's number and its byte and
code-point offsets. A cut is then found by binary search among the checkpoints and a
short rescan from the nearest one, so no list of units is ever built.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, in_blocks, small_batches, texts

#: What marks the parts of an output: prefix, suffix, middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between two checkpoints, and bytes that are looked at together.
EVERY, PIECE = 256, 1 << 16

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _starts(data: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the bytes from ``at`` to ``to``: whether a unit begins there, and whether a code point does."""
    part = data[at:to]
    lead = (part & 0xC0) != 0x80
    letter = _LETTER[part]
    before = np.empty_like(letter)
    before[1:] = letter[:-1]
    before[:1] = at > 0 and _LETTER[data[at - 1]]
    return lead & ~(letter & before), lead


class Checkpoints:
    """Sparse offsets of a UTF-8 text's units, and how many units and code points it has."""

    def __init__(self, text: bytes, every: int = EVERY):
        self.data = np.frombuffer(text, dtype=np.uint8)
        self.numbers, self.bytes, self.chars = [], [], []
        units = chars = 0
        for at in range(0, len(text), PIECE):
            start, lead = _starts(self.data, at, min(at + PIECE, len(text)))
            where = np.flatnonzero(start)
            due = where[-units % every :: every]
            if len(due):
                self.numbers += range(units + -units % every, units + len(where), every)
                self.bytes += (due + at).tolist()
                self.chars += (np.cumsum(lead)[due] - 1 + chars).tolist()
            units += len(where)
            chars += int(np.count_nonzero(lead))
        self.units, self.length = units, chars

    def find(self, unit: int) -> tuple[int, int]:
        """The byte and the code point at which a unit begins; the ends of the text for the unit after the last."""
        if unit >= self.units:
            return len(self.data), self.length
        k = bisect_right(self.numbers, unit) - 1
        left, chars, at = unit - self.numbers[k], self.chars[k], self.bytes[k]
        while True:  # one piece is enough but for very long words
            start, lead = _starts(self.data, at, min(at + PIECE, len(self.data)))
            where = np.flatnonzero(start)
            if left < len(where):
                return at + int(where[left]), chars + int(np.count_nonzero(lead[: where[left]]))
            left, chars, at = left - len(where), chars + int(np.count_nonzero(lead)), at + PIECE


def _cut(text: bytes, h: list[int], keep: int, turned: int, marks: tuple[bytes, bytes, bytes], every: int) -> tuple:
    points = Checkpoints(text, every)
    if not text or h[2] % 100 >= keep or any(m in text for m in marks):
        return points.units, "plain", None, None, text
    first, last = sorted((h[0] % (points.units + 1), h[1] % (points.units + 1)))
    (a, a_chars), (b, b_chars) = points.find(first), points.find(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    form = "spm" if h[3] % 100 < turned else "psm"
    out = [s, suffix, p, prefix, m, middle] if form == "spm" else [p, prefix, s, suffix, m, middle]
    return points.units, form, a_chars, b_chars - a_chars, b"".join(out)


def draws(doc_id: Column, salt: int) -> list[Column]:
    """Four numbers of 32 bits that follow from an id; a null id is as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    documents: DataFrame, transformed: int = 90, turned: int = 20, salt: int = 1, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), every: int = EVERY, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output.

    ``transformed`` percent of the texts are rearranged, and of these ``turned`` percent put
    the suffix first; both follow from the id and ``salt``. Null and empty texts have no
    unit and stay plain, as do texts that hold one of the ``marks``. Each row is cut on its
    own: rows of one id are cut at the same draws, rows without an id at those of an empty
    id. Texts of any length are cut whole; an empty table gives no row; other columns,
    whatever their names, are ignored.
    """
    small_batches(documents.sparkSession)
    kind = documents.schema[doc_id].dataType.simpleString()
    raw = tuple(m.encode() for m in marks)
    columns = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.array(*draws(F.col(doc_id), salt)).alias("draws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches):
            made = [_cut(t, h, transformed, turned, raw, every) for t, h in zip(texts(batch), batch.column("draws").to_pylist(), strict=True)]
            n, form, prefix, middle, out = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return columns.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of; its marks can't occur in a rearranged text, so each splits it at one place."""
    prefix, suffix, middle = (F.lit(m) for m in marks)
    part = lambda x, mark, k: F.split_part(x, mark, F.lit(k))
    # The mark that begins an output leaves an empty first part.
    psm = F.concat(part(part(output, prefix, 2), suffix, 1), part(output, middle, 2), part(part(output, suffix, 2), middle, 1))
    spm = F.concat(part(part(output, prefix, 2), middle, 1), part(output, middle, 2), part(part(output, suffix, 2), prefix, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def with_restored(transformed: DataFrame, name: str = "restored") -> DataFrame:
    """The rows of ``fill_in_middle`` with the text that each output gives back."""
    return transformed.withColumn(fresh(transformed, name), restored(F.col("output"), F.col("form")))
