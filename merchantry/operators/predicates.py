"""Predicates of the browse and batch jobs (P07-P25) as columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(c: Column) -> Column:
    """Null, the same as absent in a schemaless store."""
    return c.isNull()


def blank(c: Column) -> Column:
    """Null or empty text: what a zero value means after decoding."""
    return c.isNull() | (c == "")


def not_true(c: Column) -> Column:
    """False or missing."""
    return ~c.eqNullSafe(F.lit(True))


def matches(c: Column, pattern: str) -> Column:
    """Search without regard to case."""
    return F.regexp_like(c, F.lit("(?i)" + pattern))


def has_element(c: Column) -> Column:
    """A non-empty array; null arrays have no elements."""
    return F.coalesce(F.size(c), F.lit(0)) > 0


def holds(c: Column, value: object) -> Column:
    return F.coalesce(F.array_contains(c, F.lit(value)), F.lit(False))


def since(c: Column, start: dt.datetime | None) -> Column:
    """At or after start; everything when no start is given."""
    return F.lit(True) if start is None else c >= F.lit(start)


def older_than(c: Column, as_of: Column, hours: Column | float) -> Column:
    """More than `hours` before as_of, strictly; null times are never old."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(c.cast("timestamp"))
    return F.coalesce(micros / F.lit(3.6e9) > hours, F.lit(False))


def level_at_least(c: Column, level: int) -> Column:
    return F.coalesce(c, F.lit(0)) >= level


def any_of(*conjunctions: Sequence[Column]) -> Column:
    """A disjunction of conjunctions."""
    out = F.lit(False)
    for parts in conjunctions:
        whole = F.lit(True)
        for part in parts:
            whole = whole & part
        out = out | whole
    return out


def browse(filters: Mapping[str, object], columns: Mapping[str, Column], arrays: Sequence[str] = ()) -> Column:
    """A predicate from request parameters: text is searched, members of arrays and other values are compared. Empty
    parameters select everything."""
    out = F.lit(True)
    for name, value in filters.items():
        if value in (None, ""):
            continue
        c = columns[name]
        out = out & (holds(c, value) if name in arrays else matches(c, value) if isinstance(value, str) else c == F.lit(value))
    return out


def gone(code: Column, codes: Sequence[str]) -> Column:
    """Error codes upon which a record is deleted."""
    return F.coalesce(code.isin(*codes), F.lit(False))


def display_state(deleted: Column, blacklisted: Column) -> Column:
    """error, warning or success: how a dictionary row is shown."""
    return F.when(deleted, "error").when(blacklisted, "warning").otherwise("success")
