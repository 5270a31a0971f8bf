"""Types and kinds of calendar events from their names: a table of rules, of which the first that fits counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CUP = ("Cup", "Top 10", "Top-10", "Top 16", "Top-16")
EUROPE = ("ETTU", "Europe ", "European ")
OCEANIA = ("ITTF-Oceania", "ITTF Oceania")
AMERICAS_YOUTH = ("North American Youth", "Central American Youth", "Central America Youth", "South American Youth")
#: Fixed values, in order: a name fits if it holds one phrase of every group (case counts); then its type and kind.
CALENDAR_RULES: list[tuple[list[tuple[str, ...]], str, str]] = [
    ([("WTT Champions",)], "WTT Champions", "--"),
    ([("WTT Finals",)], "WTT Finals", "--"),
    ([("WTT Youth Grand Smash", "Youth Smash")], "WTT Youth Grand Smash", "--"),
    ([("Smash",)], "WTT Grand Smash", "--"),
    ([("WTT Youth Star Contender",)], "WTT Youth Contender Series", "WTT Youth Star Contender"),
    ([("WTT Youth Contender",)], "WTT Youth Contender Series", "WTT Youth Contender"),
    ([("WTT Star Contender",)], "WTT Contender Series", "WTT Star Contender"),
    ([("WTT Contender",)], "WTT Contender Series", "WTT Contender"),
    ([("WTT Feeder",)], "WTT Feeder Series", "--"),
    ([("World Team Championships Finals", "WTTTC Finals")], "ITTF WTTC", "WTTC Finals"),
    ([("World Team Championships", "World Team Table Tennis Championships", "World Table Tennis Championships")], "ITTF WTTC", "--"),
    ([("Mixed Team World Cup",)], "ITTF Mixed Team World Cup", "--"),
    ([("World Cup",)], "ITTF World Cup", "--"),
    ([("World Youth Championships", "World Junior")], "ITTF World Youth Championships", "--"),
    ([(r"~(?i)Youth\s+Olympic.*Qualif(?:ication|ier)",)], "Youth Olympic Games Qualification", "--"),
    ([(r"~(?i)Olympic.*Qualif(?:ication|ier)",)], "Olympic Qualification", "--"),
    ([("Youth Olympic Games",)], "Youth Olympic Games", "--"),
    ([("Olympic Games",)], "Olympic Games", "--"),
    ([("Asian Para Games",)], "Multi sport events", "--"),
    ([("Asian Games",)], "Continental Games", "--"),
    ([("Pan American Games",)], "Continental Games", "--"),
    ([("South American Games", "South American Youth Games")], "Multi sport events", "--"),
    ([("African Games",)], "Continental Games", "--"),
    ([("Central American and Caribbean Games", "Parasouth American Games", "Solidarity Games")], "Multi sport events", "--"),
    ([("World Para Championships",)], "ITTF Para", "World Para Championships"),
    ([("World Para Elite",)], "ITTF Para", "World Para Elite"),
    ([("World Para Challenger",)], "ITTF Para", "World Para Challenger"),
    ([("World Para Future",)], "ITTF Para", "World Para Future"),
    ([("World Masters", "Masters Championships")], "ITTF Masters", "--"),
    ([EUROPE, ("Youth",), CUP], "Continental", "Youth Cup"),
    ([EUROPE, ("U21",)], "Continental", "U21 Championships"),
    ([EUROPE, ("Youth", "U13")], "Continental", "Youth Championships"),
    ([EUROPE, CUP], "Continental", "Senior Cup"),
    ([EUROPE], "Continental", "Senior Championships"),
    ([("ITTF-Africa",), ("North", "South", "East", "West", "Central"), ("Youth",)], "Regional", "Youth Championships"),
    ([("ITTF-Africa",), ("North", "South", "East", "West", "Central")], "Regional", "Senior Championships"),
    ([("ITTF-Americas",), AMERICAS_YOUTH], "Regional", "Youth Championships"),
    ([("ITTF-Americas",), ("North American", "South American")], "Regional", "Senior Championships"),
    ([("ITTF-Africa", "ITTF-Americas", "ITTF-ATTU", *OCEANIA), ("Youth",), ("Cup",)], "Continental", "Youth Cup"),
    ([("ITTF-Africa", "ITTF-Americas", "ITTF-ATTU", *OCEANIA), ("Youth",)], "Continental", "Youth Championships"),
    ([OCEANIA, ("Hopes",)], "Continental", "Youth Championships"),
    ([("ITTF-Africa", "ITTF-Americas", "ITTF-ATTU", *OCEANIA), ("Cup",)], "Continental", "Senior Cup"),
    ([("ITTF-Africa", "ITTF-Americas", "ITTF-ATTU", *OCEANIA)], "Continental", "Senior Championships"),
    ([("Special Event Qualifier", "Qualification")], "Regional", "Senior Championships"),
]
#: What no rule fits.
OTHER = ("Continental", "Senior Championships")


def classified(name: Column, rules: list[tuple[list[tuple[str, ...]], str, str]] = CALENDAR_RULES, other: tuple[str, str] = OTHER) -> Column:
    """struct<event_type, event_kind> of a calendar event's name, null for a null or empty one. A phrase that begins with ``~`` is a pattern."""
    has = lambda p: name.rlike(p[1:]) if p.startswith("~") else F.contains(name, F.lit(p))
    fits = lambda groups: reduce(Column.__and__, [reduce(Column.__or__, [has(p) for p in group]) for group in groups])
    value = lambda kind, sub: F.struct(F.lit(kind).alias("event_type"), F.lit(sub).alias("event_kind"))
    found = F.when(F.coalesce(name, F.lit("")) == "", None)
    for groups, kind, sub in rules:
        found = found.when(fits(groups), value(kind, sub))
    return found.otherwise(value(*other))
