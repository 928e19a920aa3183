"""Column functions on text: markers, lines, comment stripping, cuts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def present(c: Column | str) -> Column:
    """Not missing, for strings: null and '' are missing, anything else is there."""
    return _col(c).isNotNull() & (_col(c) != "")


def present_array(c: Column | str) -> Column:
    return F.coalesce(F.size(_col(c)) > 0, F.lit(False))


def contains_any(c: Column | str, markers: Sequence[str], plain: str | None = None) -> Column:
    """Whether any marker is a substring. Where the column ``plain`` says that a text is ASCII, only those that are ASCII are looked for."""
    any_of = lambda those: reduce(lambda a, b: a | b, (_col(c).contains(m) for m in those), F.lit(False))
    if plain is None:
        return any_of(markers)
    return any_of([m for m in markers if m.isascii()]) | (~F.col(plain) & any_of([m for m in markers if not m.isascii()]))


def is_ascii(c: Column | str) -> Column:
    return F.octet_length(_col(c)) == F.char_length(_col(c))


def count_present(c: Column | str, keywords: Sequence[str]) -> Column:
    """How many entries of the list are substrings; an entry that is listed twice counts twice."""
    return reduce(lambda a, b: a + b, (_col(c).contains(k).cast("int") for k in keywords), F.lit(0))


def literals(values: Sequence[str]) -> Column:
    """Texts as an array, in one literal: plans with hundreds of literals take the analyser seconds, and this one is folded before anything runs."""
    return F.split(F.lit("\x01".join(values)), "\x01", -1) if values else F.array().cast("array<string>")


def any_in(name: str, markers: Sequence[str]) -> Column:
    """As contains_any, as one small expression whatever the number of markers. ``name`` is a column that ``fixed`` made, or its expression would run for every marker."""
    return F.exists(literals(markers), lambda m: F.contains(F.col(name), m))


def found_in(name: str, keywords: Sequence[str] | Column) -> Column:
    """The entries that are substrings of the column ``name`` (see any_in), in list order, repeated ones as often as they are listed."""
    listed = keywords if isinstance(keywords, Column) else literals(keywords)
    return F.filter(listed, lambda k: F.contains(F.col(name), k))


def count_in(name: str, keywords: Sequence[str]) -> Column:
    """As count_present, as one small expression; see any_in."""
    return F.size(found_in(name, keywords)) if keywords else F.lit(0)


def present_of(c: Column | str, keywords: Sequence[str]) -> Column:
    """The entries that are substrings, in list order."""
    return F.array_compact(F.array(*[F.when(_col(c).contains(k), F.lit(k)) for k in keywords]))


def ends_with_any(c: Column | str, suffixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (_col(c).endswith(s) for s in suffixes), F.lit(False))


def strip_comments(c: Column | str) -> Column:
    """Block, line and hash comments and triple-quoted strings, in this order; other strings stay."""
    out = _col(c)
    for pattern, to in ((r"(?s)/\*.*?\*/", " "), (r"//[^\n]*", " "), (r"#[^\n]*", " "), (r'(?s)""".*?"""', '""'), (r"(?s)'''.*?'''", "''")):
        out = F.regexp_replace(out, pattern, to)
    return out


#: What ends a line, beyond \n, where lines are split as text and not as a file of \n.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def split_lines(c: Column | str) -> Column:
    """Lines at any line break; a last empty one is not a line."""
    parts = F.split(_col(c), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def window_around(lines: Column, at: Column, radius: int) -> Column:
    """The lines around number ``at`` (from 1), stripped; '' if there is none."""
    start = F.greatest(at - radius, F.lit(1))
    return F.when(at > 0, strip(F.array_join(F.slice(lines, start, at + radius + 1 - start), "\n"))).otherwise("")


def first_hit_window(lines: Column, keywords: Sequence[str] | Column, radius: int = 2) -> Column:
    """The window of lines around the first line with a keyword, stripped; '' without one. ``lines`` is a column, not an expression to repeat; ``keywords`` may be a column too."""
    hit = (lambda line: F.exists(keywords, lambda k: F.contains(F.lower(line), k))) if isinstance(keywords, Column) else (lambda line: contains_any(F.lower(line), keywords))
    return window_around(lines, F.array_position(F.transform(lines, hit), F.lit(True)).cast("int"), radius)


def truncate(c: Column | str, limit: int) -> Column:
    """Cut to the limit less 32 characters, with a mark."""
    return F.when(F.length(_col(c)) <= limit, _col(c)).otherwise(F.concat(F.substring(_col(c), 1, max(0, limit - 32)), F.lit("\n... (truncated)\n")))


def truncate_head(c: Column | str, limit: int) -> Column:
    """The last characters, with a mark before them."""
    return F.when(F.length(_col(c)) <= limit, _col(c)).otherwise(F.concat(F.lit("\n... (truncated)\n"), F.right(_col(c), F.lit(max(0, limit - 32)))))


def distinct_trimmed(c: Column | str) -> Column:
    """Distinct trimmed entries in their order, without empty ones."""
    return F.array_distinct(F.filter(F.transform(_col(c), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


#: Texts that stand for nothing.
PLACEHOLDERS = ("unknown", "n/a", "none", "null", "未命名漏洞", "未分类漏洞")


def is_placeholder(c: Column | str) -> Column:
    return F.lower(F.trim(text_or_empty(c))).isin("", *PLACEHOLDERS)


def first_real(*cols: Column | str) -> Column:
    """The first that is neither missing nor a placeholder, trimmed; else ''."""
    return F.coalesce(*[F.when(~is_placeholder(c), F.trim(_col(c))) for c in cols], F.lit(""))


def fixed(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that are worked out once.

    The optimizer puts an alias's expression wherever a filter above refers to it, as often
    as it does so; it does not look through a generator, and one of a single row costs little.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))
