"""Text normalisers as Column expressions. Null inputs behave as the empty text unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\n\x0B\f\r]+"
#: Latin letters with marks and their bare letters.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĖėĘęĚěĞğĢģĪīĮįİĶķĻļŃńŅņŇňŌōŐőŔŕŘřŚśŞşŠšŤťŪūŮůŰűŲųŹźŻżŽž"
BARE = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeEeGgGgIiIiIKkLlNnNnNnOoOoRrRrSsSsSsTtUuUuUuUuZzZzZz"


def nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null where nothing remains."""
    return F.nullif(F.trim(c), F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(nz(c), SPACES, " "))


def normalize_text(c: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.lower(squeeze(c))


def normalize_event_name(c: Column) -> Column:
    """Lower case without sponsor suffix, commas, full stops and repeated spaces."""
    bare = F.regexp_replace(F.lower(F.trim(nz(c))), r"\s+presented\s+by\s+.*$", "")
    return squeeze(F.regexp_replace(bare, "[,.]", ""))


def tokens(c: Column) -> Column:
    """Words of the lower-cased text; none for blank texts."""
    return F.filter(F.split(F.lower(nz(c)), SPACES), lambda w: w != "")


def name_key(c: Column) -> Column:
    """Words of a name in order of their letters: equal for any word order."""
    return F.array_join(F.array_sort(tokens(c)), " ")


def side_key(players: Column, name: str = "name", country: str = "country") -> Column:
    """``name|country`` of every player of an array of structs, lower case, sorted and joined by ``||``."""
    part = F.transform(players, lambda p: F.concat(F.lower(F.trim(nz(p[name]))), F.lit("|"), F.lower(F.trim(nz(p[country])))))
    return F.coalesce(F.array_join(F.array_sort(part), "||"), F.lit(""))


def pair_key(a: Column, b: Column, sep: str = "|") -> Column:
    """Two keys in order, joined: the same for (a, b) and (b, a)."""
    return F.concat_ws(sep, F.least(a, b), F.greatest(a, b))


def dedup_key(event: Column, sub_event: Column, stage: Column, round_: Column, a: Column, b: Column) -> Column:
    return F.concat_ws("|", normalize_event_name(event), nz(sub_event), nz(stage), nz(round_), pair_key(nz(a), nz(b)))


def countries_of(players: Column, country: str = "country") -> Column:
    """Distinct country codes of an array of players, upper case, sorted, without blanks."""
    codes = F.transform(players, lambda p: F.upper(F.trim(nz(p[country]))))
    return F.array_sort(F.array_distinct(F.filter(codes, lambda c: c != "")))


def single_country(players: Column, country: str = "country") -> Column:
    """The only country of the players; null where there is none or more than one."""
    found = countries_of(players, country)
    return F.when(F.size(found) == 1, found[0])


def _named(players: Column, name: str) -> Column:
    return F.filter(players, lambda p: F.trim(nz(p[name])) != "")


def team_key(players: Column, name: str = "name", country: str = "country") -> Column:
    """``C:XXX`` for players of one country, else ``R:`` and the sorted roster."""
    member = lambda p: F.concat(normalize_text(p[name]), F.lit("|"), F.upper(F.trim(nz(p[country]))))
    roster = F.array_join(F.array_sort(F.array_distinct(F.transform(_named(players, name), member))), "||")
    return F.coalesce(F.concat(F.lit("C:"), single_country(players, country)), F.concat(F.lit("R:"), roster))


def roster_key(players: Column, name: str = "name", country: str = "country", player_id: str = "player_id") -> Column:
    """``R:`` and the sorted members, by id where there is one, else by name and country."""
    member = lambda p: F.coalesce(F.concat(F.lit("id:"), p[player_id].cast("string")), F.concat(F.lit("name:"), normalize_text(p[name]), F.lit("|"), F.upper(F.trim(nz(p[country])))))
    return F.concat(F.lit("R:"), F.array_join(F.array_sort(F.array_distinct(F.transform(_named(players, name), member))), "||"))


def slugify(c: Column) -> Column:
    """Lower case, spaces as hyphens, other characters than letters, digits and hyphens left out."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(nz(c))), SPACES, "-"), "[^a-z0-9-]", "")


def match_code(c: Column, drop_spaces: bool = True) -> Column:
    """External match code without trailing hyphens; importers also leave out spaces, readers keep inner ones."""
    text = F.replace(nz(c), F.lit(" "), F.lit("")) if drop_spaces else nz(c)
    return F.trim(F.regexp_replace(text, "-+$", ""))


def stage_token(c: Column) -> Column:
    """Lower case with other characters than letters and digits as single inner hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(nz(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def name_variants(c: Column) -> Column:
    """The normalised name, and without a birth year in brackets at its end."""
    full = normalize_text(c)
    bare = F.trim(F.regexp_replace(full, r"\s+\((?:19|20)\d{2}\)$", ""))
    return F.array_distinct(F.filter(F.array(full, bare), lambda x: (x != "") | (full == "")))


def fold_accents(c: Column) -> Column:
    """Latin letters without their marks; other characters stay."""
    return F.translate(nz(c), MARKED, BARE)


def lookup_text(c: Column) -> Column:
    """Lower-case ASCII words with one space between them, for phrase tests."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether whole words of ``text`` are the words of ``phrase``; a blank phrase is in no text."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (F.trim(phrase) != "") & F.contains(pad(text), pad(phrase))


def player_token(c: Column) -> Column:
    """``NAME (CC)`` as struct<name, country>; a text of another form is all name."""
    text, form = F.trim(nz(c)), r"^(.+?)\s*\((\w+)\)$"
    hit = text.rlike(form)
    return F.struct(F.when(hit, F.regexp_extract(text, form, 1)).otherwise(text).alias("name"), F.when(hit, F.regexp_extract(text, form, 2)).alias("country"))


def row_players(c: Column) -> Column:
    """Player tokens of a ``|``-delimited raw row: its cells of the form ``NAME (CC)``."""
    cells = F.transform(F.split(nz(c), r"\|"), lambda x: F.trim(x))
    return F.filter(cells, lambda x: x.rlike(r"^.+\(\w+\)$"))


def row_sides(c: Column) -> Column:
    """struct<a, b> of a raw row: two players are one against one, an even number of four or more is cut in halves, else empty."""
    players = row_players(c)
    n = F.size(players)
    half = F.when((n == 2) | ((n >= 4) & (n % 2 == 0)), F.floor(n / 2).cast("int")).otherwise(0)
    empty = F.array().cast("array<string>")
    return F.struct(F.when(half > 0, F.slice(players, 1, half)).otherwise(empty).alias("a"), F.when(half > 0, F.slice(players, half + 1, half)).otherwise(empty).alias("b"))


def rubber_names(c: Column) -> Column:
    """Names of ``A / B``."""
    return F.filter(F.transform(F.split(nz(c), "/"), lambda x: F.trim(x)), lambda x: x != "")


def text_value(items: Column, language: str = "ENG") -> Column:
    """Value of an array of struct<Language, Value>: in ``language`` if filled, else the first that is filled."""
    filled = F.filter(items, lambda x: nz(x["Value"]) != "")
    return F.coalesce(F.get(F.filter(filled, lambda x: x["Language"] == language), F.lit(0))["Value"], F.get(filled, F.lit(0))["Value"])


def match_number(c: Column) -> Column:
    """The number of ``Match n`` or ``M n``."""
    return F.expr("int(null)") if c is None else F.regexp_extract(nz(c), r"(?i)\b(?:Match|M)\s*(\d+)\b", 1).try_cast("int")


def session_label(number: Column, local_at: Column) -> Column:
    """``Match n | d Mon, hh:mm``; without a readable time ``Match n``; null without a number."""
    t = F.try_to_timestamp(local_at, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    head = F.concat(F.lit("Match "), number.cast("string"))
    return F.coalesce(F.concat(head, F.lit(" | "), F.date_format(t, "d MMM, HH:mm")), head)


def rubber_label(base: Column, order: Column) -> Column:
    return F.concat(F.coalesce(blank_to_null(base), F.lit("Match TBD")), F.lit(" / Rubber "), order.cast("string"))


def table_label(c: Column) -> Column:
    """``T01`` for ``Table 1`` and ``T 1``; other texts in upper case; null for blank ones."""
    number = F.regexp_extract(nz(c), r"(?i)\b(?:Table|T)\s*0*(\d+)\b", 1)
    return F.when(number != "", F.concat(F.lit("T"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))).otherwise(F.upper(blank_to_null(c)))


def competitor_name(team: Column, given: Column, family: Column, code: Column, organization: Column) -> Column:
    """Team name, else family and given name, else code, else organisation, else ``TBD``."""
    person = F.nullif(F.concat_ws(" ", blank_to_null(family), blank_to_null(given)), F.lit(""))
    return F.coalesce(blank_to_null(team), person, F.nullif(code, F.lit("")), F.nullif(organization, F.lit("")), F.lit("TBD"))


def athlete_name(given: Column, family: Column, code: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" ", blank_to_null(family), blank_to_null(given)), F.lit("")), F.nullif(code, F.lit("")), F.lit("Unknown"))


def split_event_name(c: Column) -> Column:
    """struct<base, year>: the name without sponsor and without a year at its end."""
    bare = F.trim(F.regexp_replace(nz(c), r"(?i)\s+presented\s+by\s+.*$", ""))
    form = r"^(.*?)[\s,]+((?:19|20)\d{2})$"
    hit = bare.rlike(form)
    return F.struct(F.when(hit, F.regexp_extract(bare, form, 1)).otherwise(bare).alias("base"), F.when(hit, F.regexp_extract(bare, form, 2)).try_cast("int").alias("year"))


def event_id_from_href(c: Column) -> Column:
    """The number behind ``eventId=``, else that of ``/tournament/n/``."""
    return F.coalesce(F.regexp_extract(nz(c), r"eventId=(\d+)", 1).try_cast("long"), F.regexp_extract(nz(c), r"/tournament/(\d+)/", 1).try_cast("long"))


def raw_identity(c: Column) -> Column:
    """struct<year, event> of the first two cells of a raw row; the year is null where it is no number."""
    cells = F.transform(F.split(nz(c), r"\|"), lambda x: F.trim(x))
    return F.struct(F.get(cells, F.lit(0)).try_cast("int").alias("year"), F.nullif(F.get(cells, F.lit(1)), F.lit("")).alias("event"))


def fixed_row(c: Column, names: list[str]) -> Column:
    """Cells of a ``|``-delimited row as a struct by position; missing and blank cells are null."""
    cells = F.split(nz(c), r"\|")
    return F.struct(*[blank_to_null(F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(names)])


def id_list(c: Column) -> Column:
    """Whole numbers of a comma-separated text; empty and other members are left out."""
    return F.filter(F.transform(F.split(nz(c), ","), lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull())


#: Aliases of event names and what each stands for, in the order of the rules.
EVENT_ALIASES = [
    ("混合团体", ["混团"]),
    ("世界乒乓球锦标赛", ["世乒赛", "世锦赛"]),
    ("亚洲锦标赛", ["亚锦赛"]),
    ("亚洲团体锦标赛", ["亚锦赛"]),
    ("国际乒联世界团体锦标赛", ["世乒赛团体"]),
]


def expand_query(c: Column, rules: list[tuple[str, list[str]]] = EVENT_ALIASES) -> Column:
    """The normalised query and what its aliases stand for: a query that is an alias adds the full name, one that holds it is rewritten."""
    query, none = normalize_text(c), F.lit(None).cast("string")
    found = [query]
    for canonical, aliases in rules:
        exact = query.isin(aliases)
        found.append(F.when(exact, F.lit(canonical)))
        found += [F.when(~exact & F.contains(query, F.lit(a)), F.replace(query, F.lit(a), F.lit(canonical))).otherwise(none) for a in aliases]
    return F.when(query == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(*found))))
