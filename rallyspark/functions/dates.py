"""Dates, times and zones as Column expressions. ``as_of`` is always an argument, never the clock."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyspark.functions.scores import lookup
from rallyspark.functions.text import contains_phrase, lookup_text, nz

_SHORT = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_LONG = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTHS = {name: i + 1 for names in (_SHORT, _LONG) for i, name in enumerate(names)}
#: Words that name a zone, tried in this order.
ZONE_WORDS = [
    (("united states smash", "ontario california", "ontario, california"), "America/Los_Angeles"), (("london", "united kingdom", "england"), "Europe/London"), (("doha", "qatar"), "Asia/Qatar"),
    (("singapore",), "Asia/Singapore"), (("macau", "macao"), "Asia/Macau"), (("china smash", "beijing"), "Asia/Shanghai"), (("yokohama", "japan"), "Asia/Tokyo"),
]


def month(c: Column) -> Column:
    """Number of an English month, short or long, any case; null for other texts."""
    return lookup(F.lower(F.trim(nz(c))), MONTHS)


def _two(c: Column) -> Column:
    text = c.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def _iso(year: Column, m: Column, day: Column) -> Column:
    return F.concat_ws("-", F.when(m.isNotNull() & day.isNotNull(), year.cast("string")), _two(m), _two(day))


def date_range(c: Column, year: Column) -> Column:
    """struct<start, end> as ISO texts of four grammars: month alone (no dates), ``26-27 TBD Mar``, ``29 Apr – 2 May``, ``01-07至01-11``.

    The end falls in the next year only where its month is before a start in October or later.
    """
    text = F.regexp_replace(F.trim(nz(c)), "[–—]", "-")
    number = lambda form, i: F.nullif(F.regexp_extract(text, form, i), F.lit(""))
    tbd, named, plain = r"(?i)(\d+)-(\d+)\s*TBD\s*([A-Za-z]+)", r"(\d+)\s*([A-Za-z]+)\s*[-至]\s*(\d+)\s*([A-Za-z]+)", r"(\d+)-(\d+)\s*至\s*(\d+)-(\d+)"
    none = F.lit(None).cast("string")
    empty = F.struct(none.alias("start"), none.alias("end"))

    def span(d1: Column, m1: Column, d2: Column, m2: Column) -> Column:
        turn = F.when((m2 < m1) & (m1 >= 10), year + 1).otherwise(year)
        both = m1.isNotNull() & m2.isNotNull()
        return F.when(both, F.struct(_iso(year, m1, d1).alias("start"), _iso(turn, m2, d2).alias("end"))).otherwise(empty)

    whole = lambda form, i: number(form, i).try_cast("int")
    tbd_month = month(number(tbd, 3))
    return (
        F.when((text == "") | text.rlike("^[A-Za-z]+$"), empty)
        .when(text.rlike(tbd), span(whole(tbd, 1), tbd_month, whole(tbd, 2), tbd_month))
        .when(text.rlike(named), span(whole(named, 1), month(number(named, 2)), whole(named, 3), month(number(named, 4))))
        .when(text.rlike(plain), span(whole(plain, 2), whole(plain, 1), whole(plain, 4), whole(plain, 3)))
        .otherwise(empty)
    )


def expires_date(c: Column) -> Column:
    """``2026-May-25`` as ISO; an unknown month counts as January; other texts stay; blank is null."""
    form = r"^(\d{4})-(\w+)-(\d{1,2})"
    part = lambda i: F.regexp_extract(c, form, i)
    exact = lookup(part(2), {s.capitalize(): i + 1 for i, s in enumerate(_SHORT)}, 1)
    return F.when(nz(c) == "", None).when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).when(c.rlike(form), F.concat_ws("-", part(1), _two(exact), _two(part(3).try_cast("int")))).otherwise(c)


def ranking_month(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(c, 1, 7))


def display_time(c: Column, year: Column) -> Column:
    """Local ISO time of ``Match 3 | 18 Apr, 10:00`` in the event's year; null where there is none."""
    text = F.trim(F.split_part(nz(c), F.lit("|"), F.lit(2)))
    m, form = month(F.regexp_extract(text, r"^\d{1,2} ([A-Za-z]+), \d{1,2}:\d{2}$", 1)), r"^(\d{1,2}) [A-Za-z]+, (\d{1,2}):(\d{2})$"
    n = lambda i: _two(F.regexp_extract(text, form, i).try_cast("int"))
    iso = F.concat(year.cast("string"), F.lit("-"), _two(m), F.lit("-"), n(1), F.lit("T"), n(2), F.lit(":"), n(3), F.lit(":00"))
    return F.when(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), iso)


def us_time(c: Column) -> Column:
    """Local ISO time of ``MM/dd/yyyy HH:mm[:ss]``."""
    t = F.coalesce(F.try_to_timestamp(F.trim(c), F.lit("MM/dd/yyyy HH:mm:ss")), F.try_to_timestamp(F.trim(c), F.lit("MM/dd/yyyy HH:mm")))
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")


def chinese_day(c: Column) -> Column:
    """struct<month, day> of ``8月8日``."""
    form = r"^(\d{1,2})\s*月\s*(\d{1,2})\s*日$"
    part = lambda i: F.regexp_extract(F.trim(nz(c)), form, i).try_cast("int")
    return F.struct(part(1).alias("month"), part(2).alias("day"))


@lru_cache(maxsize=1)
def _zones() -> frozenset[str]:
    from zoneinfo import available_timezones

    return frozenset(z for z in available_timezones() if "/" in z or z in ("UTC", "GMT"))


def known_zone(c: Column, otherwise: str | None = None) -> Column:
    """The IANA zone if it is one, else ``otherwise``."""
    zones = F.array(*map(F.lit, sorted(_zones())))
    return F.when(F.array_contains(zones, F.trim(nz(c))), F.trim(c)).otherwise(F.lit(otherwise))


def local_and_utc(c: Column, zone: Column) -> Column:
    """struct<local, utc> of an ISO time: a time with an offset is kept, one without is read in the zone; a bad zone gives no UTC.

    In the hour that occurs twice the first one counts; a time in the gap is read with the offset before it.
    """
    raw = F.regexp_replace(F.trim(nz(c)), "Z$", "+00:00")
    form = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?"
    aware = raw.rlike(form + r"(\.\d+)?[+-]\d{2}:?\d{2}$")
    naive = raw.rlike(form + r"(\.\d+)?$")
    bare = F.regexp_replace(F.regexp_extract(raw, form, 0), "T", " ")
    at = F.to_timestamp_ntz(F.when(F.length(bare) == 16, F.concat(bare, F.lit(":00"))).otherwise(bare))
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    offset = F.regexp_extract(raw, r"([+-]\d{2}:?\d{2})$", 1)
    minutes = F.concat(F.substring(offset, 1, 1), F.lit("1")).try_cast("int") * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.regexp_extract(offset, r"(\d{2})$", 1).try_cast("int"))
    utc_aware = F.date_format(F.timestamp_add("MINUTE", -minutes, at), "yyyy-MM-dd'T'HH:mm:ss")
    known = known_zone(zone)
    utc_naive = F.date_format(F.convert_timezone(known, F.lit("UTC"), at), "yyyy-MM-dd'T'HH:mm:ss")
    mark = lambda x: F.concat(x, F.lit("+00:00"))
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(aware, F.concat(iso, offset)).when(naive, iso).alias("local"),
        F.when(aware, mark(utc_aware)).when(naive & known.isNotNull(), mark(utc_naive)).otherwise(none).alias("utc"),
    )


def local_day(as_of: Column, zone: Column) -> Column:
    """Date of an instant in the zone; unknown zones count as UTC."""
    return F.to_date(F.from_utc_timestamp(as_of, known_zone(zone, "UTC")))


def display_status(lifecycle: Column, start: Column, end: Column, zone: Column, as_of: Column) -> Column:
    """completed, upcoming, finished_pending_promotion or in_progress on the event's local day."""
    today = local_day(as_of, zone)
    return F.when(lifecycle == "completed", "completed").when(today < start, "upcoming").when(today > end, "finished_pending_promotion").otherwise("in_progress")


def imported_lifecycle(end: Column, as_of: Column) -> Column:
    return F.when(end < as_of, "completed").otherwise("upcoming")


def is_past(end: Column, as_of: Column) -> Column:
    return F.coalesce(end < as_of, F.lit(False))


def day_bucket(utc: Column, local: Column, zone: Column, reference: str, missing: str = "TBD") -> Column:
    """Day in the reference zone: from the instant, else from local time and zone, else the bucket for unknown days."""
    there = F.convert_timezone(known_zone(zone), F.lit(reference), local)
    day = F.coalesce(F.date_format(F.from_utc_timestamp(utc, reference), "yyyy-MM-dd"), F.date_format(there, "yyyy-MM-dd"))
    return F.coalesce(day, F.lit(missing))


def starts_within(start: Column, now: Column, minutes: int = 15) -> Column:
    return (start >= now) & (start <= F.timestamp_add("MINUTE", F.lit(minutes), now))


def zone_guess(stored: Column, *texts: Column) -> Column:
    """The stored zone, else that of the first rule with a word in the texts."""
    hay = F.lower(F.concat_ws(" ", *[nz(t) for t in texts]))
    out = F.when(F.trim(nz(stored)) != "", F.trim(stored))
    for words, zone in ZONE_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(hay, F.lit(w))
        out = out.when(hit, zone)
    return out


def time_window(times: Column) -> Column:
    """struct<start, end>: the first two texts, trimmed, blank as null."""
    part = lambda i: F.nullif(F.trim(F.get(times, F.lit(i))), F.lit(""))
    return F.struct(part(0).alias("start"), part(1).alias("end"))


def city_phrase(location: Column, phrase: Column) -> Column:
    """Whether a location names a city: whole words without marks."""
    return contains_phrase(lookup_text(location), lookup_text(phrase))
