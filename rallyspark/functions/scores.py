"""Scores, game lists and winners as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyspark.functions.text import nz

#: Forfeit markers.
MARKERS = ("WO", "INJ", "DNS", "DSQ", "RET")
GAMES = "array<struct<player:int,opponent:int>>"
#: Weight of a round for best results, and priorities of a status.
ROUND_WEIGHTS = {"Final": 8, "SemiFinal": 7, "QuarterFinal": 6, "R16": 5, "R32": 4, "R64": 3, "R128": 2}
READ_STATUS = {"completed": 4, "walkover": 4, "live": 3, "scheduled": 2, "cancelled": 1}
IMPORT_STATUS = {"completed": 40, "walkover": 40, "live": 30, "scheduled": 20, "cancelled": 10}
#: Source statuses.
STATUSES = {
    "scheduled": "scheduled", "start list": "scheduled", "intermediate": "live", "live": "live", "displayed": "completed", "official": "completed",
    "completed": "completed", "walkover": "walkover", "cancelled": "cancelled", "canceled": "cancelled",
}


def lookup(c: Column, table: dict, default=None) -> Column:
    """Value of a literal table; ``default`` for other keys and null."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, nz(c)), F.lit(default))


def _pair(text: Column, form: str) -> Column:
    a, b = F.regexp_extract(text, form, 1).try_cast("int"), F.regexp_extract(text, form, 2).try_cast("int")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def tie_score(c: Column) -> Column:
    """struct<a, b> of the first ``n-n`` anywhere in the text, else null."""
    return _pair(nz(c), r"(\d+)\s*-\s*(\d+)")


def match_score(c: Column) -> Column:
    """struct<a, b> of a text that is ``n-n`` and nothing else, else null."""
    return _pair(nz(c), r"^\s*(\d+)\s*-\s*(\d+)\s*$")


def bracket_score(c: Column) -> Column:
    """struct<a, b> of ``n-n`` before a bracket such as ``(11-9, ...)``, else null."""
    return _pair(F.replace(F.trim(F.split_part(nz(c), F.lit("("), F.lit(1))), F.lit(" "), F.lit("")), r"^(\d+)-(\d+)$")


def winner_of(score: Column) -> Column:
    """``A`` or ``B`` of a struct<a, b>; null for equal and missing scores."""
    return F.when(score["a"] > score["b"], "A").when(score["b"] > score["a"], "B")


def flip_score(c: Column) -> Column:
    """``b-a`` of the first score in the text; texts without one stay."""
    s = tie_score(c)
    return F.coalesce(F.concat(s["b"].cast("string"), F.lit("-"), s["a"].cast("string")), c)


def flip_winner(c: Column) -> Column:
    return F.when(c == "A", "B").when(c == "B", "A")


def flip_games(games: Column) -> Column:
    return F.transform(games, lambda g: F.struct(g["opponent"].alias("player"), g["player"].alias("opponent")))


def flips_order(official_a: Column, official_b: Column, shown_a: Column, shown_b: Column) -> Column:
    """Whether the official order of two team codes is that of the display turned round."""
    known = (nz(shown_a) != "") & (nz(shown_b) != "")
    return F.coalesce(known & (official_a == shown_b) & (official_b == shown_a), F.lit(False))


def _played(games: Column) -> Column:
    return F.filter(games, lambda g: g.isNotNull() & g["player"].isNotNull() & g["opponent"].isNotNull() & ~((g["player"] == 0) & (g["opponent"] == 0)))


def _tokens(items: Column, form: str) -> Column:
    one = lambda x: F.struct(F.regexp_extract(x, form, 1).try_cast("int").alias("player"), F.regexp_extract(x, form, 2).try_cast("int").alias("opponent"))
    return _played(F.transform(items, one))


def games(c: Column) -> Column:
    """Games of a JSON list of texts or of objects (player, opponent), else of a comma-separated text; 0-0 games are left out."""
    listed = F.trim(nz(c)).rlike(r"^\[")
    texts = F.from_json(c, "array<string>")
    objects = F.from_json(c, GAMES)
    comma = _tokens(F.split(nz(c), ","), r"(-?\d+)\s*[-:]\s*(-?\d+)")
    as_text = _tokens(F.filter(texts, lambda x: x.rlike(r"^\s*\d+\s*[-:]\s*\d+\s*$")), r"^\s*(\d+)\s*[-:]\s*(\d+)\s*$")
    return F.when(listed & F.exists(F.coalesce(texts, F.array()), lambda x: F.trim(x).startswith("{")), _played(objects)).when(listed & texts.isNotNull(), as_text).otherwise(comma)


def forfeit(raw: Column, first_is_a: Column, marker: Column | None = None, marker_side: Column | None = None) -> Column:
    """struct<score, winner> in side A's view of ``3-0``, ``3-0 WO`` and ``0 WO-3``.

    An explicit marker and its side (``team1`` or ``team2``) go before those in the text: behind the score the marker is the second
    team's, before the hyphen the first team's. A walkover is won by the side without the marker; other markers follow the score and
    count only where it is equal. Other texts are returned as they are, without a winner; null and blank texts are null.
    """
    none = F.lit(None).cast("string")
    text, any_ = F.trim(raw), "|".join(MARKERS)
    back, front = rf"^(\d+)\s*-\s*(\d+)(?:\s+({any_}))?\s*$", rf"^(\d+)\s+({any_})\s*-\s*(\d+)\s*$"
    is_back, is_front = text.rlike(back), text.rlike(front)
    number = lambda i, j: F.when(is_back, F.regexp_extract(text, back, i)).otherwise(F.regexp_extract(text, front, j)).try_cast("int")
    t1, t2 = number(1, 1), number(2, 3)
    given = F.nullif(F.trim(marker), F.lit("")) if marker is not None else none
    given_side = F.nullif(F.trim(marker_side), F.lit("")) if marker_side is not None else none
    own = F.nullif(F.when(is_back, F.regexp_extract(text, back, 3)).when(is_front, F.regexp_extract(text, front, 2)), F.lit(""))
    mark = F.coalesce(given, own)
    side = F.when(given.isNull() & own.isNotNull(), F.when(is_back, "team2").otherwise("team1")).otherwise(given_side)
    a, b = F.when(first_is_a, t1).otherwise(t2), F.when(first_is_a, t2).otherwise(t1)
    known = mark.isNotNull() & side.isNotNull()
    on_a = known & ((side == "team1") == first_is_a)
    on_b = known & ~((side == "team1") == first_is_a)
    text_a, text_b = a.cast("string"), b.cast("string")
    score = F.when(on_a, F.concat(text_a, F.lit(" "), mark, F.lit("-"), text_b)).otherwise(F.concat(text_a, F.lit("-"), text_b, F.coalesce(F.concat(F.lit(" "), mark), F.lit(""))))
    winner = F.when((mark == "WO") & on_a, "B").when((mark == "WO") & on_b, "A").when(a > b, "A").when(b > a, "B").when(on_a, "B").when(on_b, "A")
    readable = is_back | is_front
    return F.when(nz(text) != "", F.struct(F.when(readable, score).otherwise(text).alias("score"), F.when(readable, winner).alias("winner")))


def round_weight(c: Column) -> Column:
    return lookup(c, ROUND_WEIGHTS, 1)


def status_of(c: Column) -> Column:
    """Status of a source's text; unknown texts are scheduled."""
    return lookup(F.lower(F.trim(nz(c))), STATUSES, "scheduled")


def status_priority(c: Column, scale: dict[str, int] = IMPORT_STATUS) -> Column:
    return lookup(c, scale, 0)


def completeness(score: Column, n_games: Column, athletes: Column, teams: Column, table: Column, label: Column, weights: tuple[int, int, int, int, int, int] = (100, 0, 5, 3, 2, 1)) -> Column:
    """Weighted count of what is filled: result, games, athletes, team codes, table and label."""
    flag = lambda c: F.when(nz(c.cast("string")) != "", 1).otherwise(0)
    parts = [flag(score), F.coalesce(n_games, F.lit(0)), F.coalesce(athletes, F.lit(0)), F.coalesce(teams, F.lit(0)), flag(table), flag(label)]
    return sum((p * w for p, w in zip(parts, weights, strict=True) if w), F.lit(0))


def names_in(winner: Column, side: Column) -> Column:
    """Whether the winner's text holds a name of the side (an array of names)."""
    return F.exists(side, lambda x: (nz(x) != "") & F.contains(F.lower(nz(winner)), F.lower(x)))


def winner_side(explicit: Column, winner: Column, side_a: Column, side_b: Column) -> Column:
    """``A`` or ``B`` as given, else the only side of which the winner's text holds a name."""
    given = F.upper(F.trim(nz(explicit)))
    in_a, in_b = names_in(winner, side_a), names_in(winner, side_b)
    return F.when(given.isin("A", "B"), given).when(in_a & ~in_b, "A").when(in_b & ~in_a, "B")


def live_winner(status: Column, explicit: Column, score: Column) -> Column:
    """Only finished matches have a winner: the given side, else that of the score."""
    given = F.upper(F.trim(nz(explicit)))
    return F.when(status.isin("completed", "walkover"), F.when(given.isin("A", "B"), given).otherwise(winner_of(tie_score(score))))


def bracket_winner(first: Column, second: Column, result: Column) -> Column:
    """Side whose place has the W flag, else that of the higher score."""
    return F.when(F.upper(nz(first)) == "W", "A").when(F.upper(nz(second)) == "W", "B").otherwise(winner_of(bracket_score(result)))


def guarded_ratio(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """part / whole * scale, 0 where the whole is null or 0."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * F.lit(scale), F.lit(0.0))


def first_filled(*columns: Column) -> Column:
    """The first text that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def didwin(winner: Column, side_no: Column) -> Column:
    return F.coalesce(((winner == "A") & (side_no == 1)) | ((winner == "B") & (side_no == 2)), F.lit(False))
