"""Column functions on severities, confidences and coverage statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, text_or_empty

SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")
#: Other names of severities.
ALIASES = {
    "critical": "Critical", "严重": "Critical", "high": "High", "高危": "High", "高": "High", "medium": "Medium", "中危": "Medium", "中": "Medium",
    "low": "Low", "低危": "Low", "低": "Low", "info": "Info", "提示": "Info", "信息": "Info", "informational": "Info",
}
#: Other names of coverage statuses; what counts as audited and as a gap.
STATUS_ALIASES = {
    "audited": "audited_no_finding", "covered": "audited_no_finding", "reviewed": "audited_no_finding", "no_finding": "audited_no_finding", "has_finding": "finding",
    "vulnerable": "finding", "finding_confirmed": "confirmed_finding", "confirmed": "confirmed_finding", "skipped": "skipped_with_reason",
    "not_enough_context": "insufficient_context", "need_followup": "needs_followup", "gap": "needs_followup", "n/a": "not_applicable", "na": "not_applicable",
}
AUDITED = ("audited_no_finding", "finding", "confirmed_finding", "skipped_with_reason", "not_applicable")
GAPS = ("insufficient_context", "needs_followup", "missing")


def _mapped(value: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value]


def severity(c: Column | str) -> Column:
    """One of the five; Medium for what is missing or unknown."""
    return F.coalesce(_mapped(F.lower(F.trim(text_or_empty(c))), ALIASES), F.lit("Medium"))


def severity_rank(c: Column | str) -> Column:
    """5 to 1 for the five exact names, else 0."""
    return F.coalesce(_mapped(F.trim(text_or_empty(c)), {s: str(5 - i) for i, s in enumerate(SEVERITIES)}).cast("int"), F.lit(0))


def severity_order(c: Column | str) -> Column:
    """As the rank, for other names too; 0 for unknown ones."""
    names = {s: str(5 - SEVERITIES.index(v)) for s, v in {**ALIASES, **{s: s for s in SEVERITIES}}.items()}
    return F.coalesce(_mapped(_col(c), names).cast("int"), F.lit(0))


def severity_names(name: str) -> list[str]:
    """All names that a filter by this one matches."""
    want = name.strip() if name.strip() in SEVERITIES else ALIASES.get(name.strip().lower(), "Medium")
    return [want, *(k for k, v in ALIASES.items() if v == want)]


def confidence(c: Column | str) -> Column:
    low = F.lower(F.trim(text_or_empty(c)))
    return F.when(low.isin("high", "medium", "low"), low).otherwise("medium")


def confidence_rank(c: Column | str) -> Column:
    x = confidence(c)
    return F.when(x == "high", 3).when(x == "medium", 2).otherwise(1)


def coverage_status(c: Column | str) -> Column:
    """A status by its usual name; what is blank counts as audited without finding."""
    low = F.regexp_replace(F.lower(F.trim(text_or_empty(c))), r"[\s-]+", "_")
    return F.coalesce(_mapped(low, STATUS_ALIASES), F.when(low == "", "audited_no_finding").otherwise(low))


def is_audited(c: Column | str) -> Column:
    return coverage_status(c).isin(*AUDITED)


def is_gap(c: Column | str) -> Column:
    return coverage_status(c).isin(*GAPS)


def status_of_route(statuses: Column) -> Column:
    """The one status of a route with several: the strongest; gaps are follow-ups; none is missing."""
    s = F.transform(F.filter(statuses, lambda x: x.isNotNull() & (x != "")), coverage_status)
    out = F.when(F.array_contains(s, "confirmed_finding"), "confirmed_finding")
    for name in ("finding", "audited_no_finding", "not_applicable", "skipped_with_reason"):
        out = out.when(F.array_contains(s, name), name)
    return out.when(F.arrays_overlap(s, F.array(*map(F.lit, GAPS))), "needs_followup").otherwise("missing")
