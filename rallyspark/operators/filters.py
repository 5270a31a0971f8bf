"""Predicates of the platform's lists, as Column expressions that reach the scan where their columns do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyspark.functions.text import nz

#: Sort orders of the senior categories, and series of a continent that stand in the list all the same.
SENIOR = (1, 14)
CONTINENTAL, SHOWN = "CONTINENTAL", ("Asian", "European", "Pan American")


def unflagged(c: Column) -> Column:
    """A flag that is null or 0."""
    return c.isNull() | (c == 0)


def begun(start: Column, as_of: Column) -> Column:
    """Not in the future; an unknown start counts as begun."""
    return start.isNull() | (start <= as_of)


def senior(sort_order: Column) -> Column:
    """A sort order of the senior categories; an event without a category has none and is left out."""
    return F.coalesce(sort_order.between(*SENIOR), F.lit(False))


def shown_series(category: Column, name: Column) -> Column:
    """Any series but continental ones, of which some stay by name."""
    stays = F.lit(False)
    for word in SHOWN:
        stays = stays | F.contains(nz(name), F.lit(word))
    return ~F.startswith(F.upper(nz(category)), F.lit(CONTINENTAL)) | stays


def not_only(name: Column, one: str, other: str) -> Column:
    """Names that hold ``one`` without ``other`` are left out, case apart."""
    has = lambda w: F.contains(F.lower(nz(name)), F.lit(w.lower()))
    return ~(has(one) & ~has(other))


def optional(c: Column, value) -> Column:
    """Equality that is asked only where a value is given (null and the empty text are none)."""
    return F.lit(True) if value is None or value == "" else F.coalesce(c == value, F.lit(False))


def whole_unit(code: Column) -> Column:
    """Codes of a unit itself, not of one of its parts."""
    return F.endswith(nz(code), F.lit("0000"))


def incomplete(status: Column, score: Column, games: Column) -> Column:
    """Completed rows that lack a score or games (blank, or an empty JSON list)."""
    blank = lambda c: F.trim(nz(c)).isin("", "[]")
    return F.coalesce(status == "completed", F.lit(False)) & (blank(score) | blank(games))


def knockout(round_code: Column) -> Column:
    """Not a round of groups."""
    return ~nz(round_code).rlike(r"(?i)^GP\d+")


def holds(records: Column, tier: str | None = None, discipline: str | None = None, champion: bool = False) -> Column:
    """Whether any of an event's records (tier, discipline, is_champion) meets all conditions that are asked."""
    return F.exists(records, lambda r: optional(r["tier"], tier) & optional(r["discipline"], discipline) & (r["is_champion"] if champion else F.lit(True)))
