"""Facets: counts by term, by period, by range, and in all, from specs such as `lang:terms` or `created_at:histogram:week`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other names of columns.
ALIASES = {"type": "coll_type", "doc_type": "coll_type", "date": "created_at"}
PERIODS = ("day", "week", "month", "year")
DEFAULT_RANGES = ((0, 100), (100, 500), (500, None))


class SpecError(ValueError):
    """A facet spec that cannot be read."""


@dataclass(frozen=True)
class Facet:
    kind: str
    field: str = ""
    period: str = "month"
    ranges: tuple[tuple[int, int | None], ...] = DEFAULT_RANGES


def parse(spec: str) -> Facet:
    """`count`, `field:terms`, `field:histogram[:day|week|month|year]`, `field:range[:0-10,10-100,500-]`."""
    parts = [p.strip() for p in spec.split(":", 2)]
    if parts == ["count"] or parts[1:2] == ["count"]:
        return Facet("count")
    if len(parts) < 2 or parts[1] not in ("terms", "histogram", "range"):
        raise SpecError(f"no facet can be read from {spec!r}")
    field, kind, rest = parts[0], parts[1], parts[2] if len(parts) > 2 else ""
    if kind == "histogram":
        return Facet(kind, field, rest if rest in PERIODS else "month")
    ranges = tuple(r for r in map(_range, rest.split(",")) if r) if kind == "range" and rest else DEFAULT_RANGES
    return Facet(kind, field, ranges=ranges or DEFAULT_RANGES)


def _range(text: str) -> tuple[int, int | None] | None:
    low, sep, high = text.strip().partition("-")
    if not sep or not low.isdigit() or high and not high.isdigit():
        return None
    return int(low), int(high) if high else None


def period_key(at: Column, period: str) -> Column:
    """The period of an instant as text; weeks begin on Monday and are counted from 00 before the year's first Monday."""
    at = at.cast("timestamp")
    week = F.floor((F.dayofyear(at) + 6 - F.weekday(at)) / 7).cast("string")
    return {
        "day": F.date_format(at, "yyyy-MM-dd"),
        "week": F.concat(F.date_format(at, "yyyy"), F.lit("-"), F.lpad(week, 2, "0")),
        "year": F.date_format(at, "yyyy"),
    }.get(period, F.date_format(at, "yyyy-MM"))


def range_key(value: Column, ranges: tuple[tuple[int, int | None], ...]) -> Column:
    """The first range, lower end included, that holds a value; else 'other', also for null."""
    out = F
    for low, high in ranges:
        inside = (value >= low) & (value < high) if high is not None else value >= low
        out = out.when(inside, f"{low}-{'' if high is None else high}")
    return out.otherwise("other")


def facet(rows: DataFrame, what: Facet | str) -> DataFrame:
    """(key, count) of a facet over all rows: terms by falling count, the others by key. Rows without a key are left out of terms and histograms.

    Only columns that `rows` has can be named, so a name is never more than a name.
    """
    f = parse(what) if isinstance(what, str) else what
    total = F.count(F.lit(1)).alias("count")
    if f.kind == "count":
        return rows.agg(total).select(F.lit("count").alias("key"), "count")
    name = ALIASES.get(f.field, f.field)
    if name not in rows.columns:
        raise SpecError(f"there is no field {f.field!r}")
    column = F.col(f"`{name}`")
    if f.kind == "range":
        return rows.groupBy(range_key(column, f.ranges).alias("key")).agg(total).orderBy("key")
    if f.kind == "histogram":
        return rows.filter(column.isNotNull()).groupBy(period_key(column, f.period).alias("key")).agg(total).orderBy("key")
    return rows.filter(column.isNotNull()).groupBy(column.cast("string").alias("key")).agg(total).orderBy(F.desc("count"), "key")


def facets(rows: DataFrame, specs: list[str]) -> dict[str, DataFrame]:
    """A facet for each spec, over the same rows. By default these are all documents; hand in search results to narrow them."""
    return {spec: facet(rows, spec) for spec in specs}
