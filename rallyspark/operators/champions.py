"""Champions of every event and discipline from draw rows and rosters; problems are rows, never errors or prompts.

``finals`` and the other rounds are draw rows with match_id, event_id, sub_event_type_code, draw_round, winner_side, winner_name,
match_score and the rosters side_a and side_b: array<struct<name, country, player_id>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyspark.functions.rounds import is_team_discipline
from rallyspark.functions.scores import match_score, tie_score, winner_side
from rallyspark.functions.text import countries_of, normalize_text, nz, roster_key, team_key
from rallyspark.operators.bracket import DRAW, disjoint_runs
from rallyspark.operators.relational import set_pairs

#: Doubles, whose champions may be of two countries.
MULTI_COUNTRY = [f"{age}{code}" for age in ("", "U11", "U13", "U15", "U17", "U19", "U21", "J", "C") for code in ("MD", "WD", "XD")]


def decided(rows: DataFrame) -> DataFrame:
    """Add ``w``: the winner as given, or from the winner's name; null where neither tells."""
    names = lambda side: F.transform(side, lambda p: p["name"])
    return rows.withColumn("w", winner_side(F.col("winner_side"), F.col("winner_name"), names("side_a"), names("side_b")))


def drawn(score: Column) -> Column:
    s = match_score(score)
    return F.coalesce(s["a"] == s["b"], F.lit(False))


def _pair(a: Column, b: Column) -> Column:
    return F.concat_ws("&", F.least(a, b), F.greatest(a, b))


def _majority(members: Column) -> Column:
    """Most frequent country of an array of players, the least on a tie."""
    codes = F.filter(F.transform(members, lambda p: F.upper(F.trim(nz(p["country"])))), lambda c: c != "")
    votes = F.transform(F.array_distinct(codes), lambda c: F.struct((-F.size(F.filter(codes, lambda x: x == c))).alias("n"), c.alias("c")))
    return F.array_min(votes)["c"]


def singles_pairs(rows: DataFrame) -> DataFrame:
    """(event, discipline, pair) of the true final: the two semifinal winners among the quarterfinal winners, if there are two."""
    keyed = decided(rows).withColumns({"a": roster_key(F.col("side_a")), "b": roster_key(F.col("side_b"))})
    won = F.when(F.col("w") == "A", F.col("a")).when(F.col("w") == "B", F.col("b"))
    quarter = keyed.where("draw_round = 'QuarterFinal'")
    enough = quarter.groupBy(*DRAW).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(won).alias("winners")).where("n >= 2 and winners >= 2").select(*DRAW)
    through = quarter.select(*DRAW, won.alias("key")).where(F.col("key").isNotNull()).distinct()
    semi = keyed.where("draw_round = 'SemiFinal'")
    two = semi.groupBy(*DRAW).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(*DRAW)
    both = semi.join(through.withColumnRenamed("key", "a"), [*DRAW, "a"], "left_semi").join(through.withColumnRenamed("key", "b"), [*DRAW, "b"], "left_semi")
    last = both.join(enough, DRAW, "left_semi").join(two, DRAW, "left_semi").groupBy(*DRAW).agg(F.array_sort(F.collect_set(won)).alias("keys")).where(F.size("keys") == 2)
    return last.select(*DRAW, _pair(F.col("keys")[0], F.col("keys")[1]).alias("pair"))


def singles_champions(rows: DataFrame) -> DataFrame:
    """Champion roster of each singles or doubles draw, with ``fallback`` and ``issue``.

    Of several finals the only one between the two semifinal winners counts, else the first match.
    """
    rows = rows.where(~is_team_discipline(F.col("sub_event_type_code")))
    finals = decided(rows.where("draw_round = 'Final'")).withColumn("pair", _pair(roster_key(F.col("side_a")), roster_key(F.col("side_b"))))
    hits = finals.join(singles_pairs(rows), [*DRAW, "pair"], "left_semi").groupBy(*DRAW).agg(F.min("match_id").alias("hit"), F.count(F.lit(1)).alias("hits"))
    all_ = finals.groupBy(*DRAW).agg(F.min("match_id").alias("first"), F.count(F.lit(1)).alias("n"))
    picked = all_.join(hits, DRAW, "left").withColumn("one", F.coalesce(F.col("hits") == 1, F.lit(False)))
    picked = picked.select(F.when((F.col("n") > 1) & F.col("one"), F.col("hit")).otherwise(F.col("first")).alias("match_id"), ((F.col("n") > 1) & ~F.col("one")).alias("fallback"))
    roster = F.when(F.col("w") == "A", F.col("side_a")).when(F.col("w") == "B", F.col("side_b"))
    return finals.join(picked, "match_id").select(*DRAW, roster.alias("roster"), F.lit(None).cast("string").alias("country"), "fallback", F.when(F.col("w").isNull(), "unresolved_winner_side").alias("issue"))


def team_pairs(rows: DataFrame) -> DataFrame:
    """(event, discipline, pair) of two teams that each won a semifinal tie with strictly most rubbers."""
    keyed = decided(rows.where("draw_round = 'SemiFinal'")).withColumns({"a": team_key(F.col("side_a")), "b": team_key(F.col("side_b"))})
    won = F.when(F.col("w") == "A", F.col("a")).when(F.col("w") == "B", F.col("b"))
    wins = keyed.withColumn("tie", _pair(F.col("a"), F.col("b"))).select(*DRAW, "tie", won.alias("team")).where(F.col("team").isNotNull()).groupBy(*DRAW, "tie", "team").agg(F.count(F.lit(1)).alias("wins"))
    best = wins.groupBy(*DRAW, "tie").agg(F.max("wins").alias("top"))
    alone = wins.join(best, [*DRAW, "tie"]).where("wins = top").groupBy(*DRAW, "tie").agg(F.min("team").alias("team"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return set_pairs(alone, DRAW, "team").select(*DRAW, _pair(F.col("first"), F.col("second")).alias("pair"))


def team_champions(rows: DataFrame) -> DataFrame:
    """Champion roster and country of each team draw, with ``fallback`` and ``issue``.

    Finals are parted where no country is shared. Of several parts the only one between two semifinal winners counts, else the one with
    the first match. The side with more rubbers wins; equal rubbers are an issue.
    """
    rows = rows.where(is_team_discipline(F.col("sub_event_type_code")))
    finals = decided(rows.where("draw_round = 'Final'"))
    countries = F.array_union(countries_of(F.col("side_a")), countries_of(F.col("side_b")))
    grouped = disjoint_runs(finals.withColumn("countries", countries).select(*DRAW, "match_id", "countries")).select("match_id", "tie_group")
    ties = finals.join(grouped, "match_id").groupBy(*DRAW, "tie_group").agg(
        F.min("match_id").alias("first"), F.count_if(F.col("w") == "A").alias("a"), F.count_if(F.col("w") == "B").alias("b"), F.count_if(F.col("w").isNull() & ~drawn(F.col("match_score"))).alias("unresolved"),
        F.array_sort(F.collect_list(F.struct("match_id", "side_a", "side_b"))).alias("rubbers"),
    )
    roster = lambda side: F.flatten(F.transform("rubbers", lambda r: r[side]))
    team = lambda side: F.coalesce(F.concat(F.lit("C:"), _majority(roster(side))), team_key(roster(side)))
    ties = ties.withColumns({"pair": _pair(team("side_a"), team("side_b"))})
    hits = ties.join(team_pairs(rows), [*DRAW, "pair"], "left_semi").groupBy(*DRAW).agg(F.min("first").alias("hit"), F.count(F.lit(1)).alias("hits"))
    all_ = ties.groupBy(*DRAW).agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    one = F.coalesce(F.col("hits") == 1, F.lit(False))
    picked = all_.join(hits, DRAW, "left").select(*DRAW, F.when((F.col("n") > 1) & one, F.col("hit")).otherwise(F.col("least")).alias("first"), ((F.col("n") > 1) & ~one).alias("fallback"))
    won = F.when(F.col("a") > F.col("b"), roster("side_a")).when(F.col("b") > F.col("a"), roster("side_b"))
    out = ties.join(picked, [*DRAW, "first"]).withColumn("roster", won)
    return out.select(*DRAW, "roster", _majority(F.col("roster")).alias("country"), "fallback", F.when(F.col("roster").isNull(), "champion_tie").when(F.col("unresolved") > 0, "unresolved_winner_side").alias("issue"))


def _members(roster: Column) -> Column:
    """Named members, each once: by id, else by name and country; the first spelling stays."""
    key = lambda p: F.coalesce(F.concat(F.lit("id:"), p["player_id"].cast("string")), F.concat_ws("|", normalize_text(p["name"]), F.upper(F.trim(nz(p["country"])))))
    named = F.filter(roster, lambda p: F.trim(nz(p["name"])) != "")
    keys = F.transform(named, key)
    return F.filter(named, lambda p, i: F.array_position(keys, key(p)) == i + 1)


def champions(rows: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row for each event and discipline: champion_player_ids, champion_name, champion_country_code, fallback and issue.

    ``overrides`` (event_id, sub_event_type_code, champion) name a champion team, whose roster is every member of sides of that country
    alone. Champions of several countries are allowed for doubles only, else an issue.
    """
    found = singles_champions(rows).unionByName(team_champions(rows)).withColumn("members", _members(F.col("roster")))
    codes = F.array_distinct(F.filter(F.transform("members", lambda p: F.upper(F.trim(nz(p["country"])))), lambda c: c != ""))
    several = F.size(codes) > 1
    allowed = F.col("sub_event_type_code").isin(MULTI_COUNTRY)
    country = F.coalesce("country", F.when(several & allowed, F.array_join(F.array_sort(codes), ",")).when(F.size(codes) == 1, codes[0]))
    issue = F.coalesce("issue", F.when(F.col("country").isNull() & several & ~allowed, "manual_country_override"))
    out = found.select(*DRAW, "members", country.alias("champion_country_code"), "fallback", issue.alias("issue"))
    if overrides is not None:
        named = rows.join(overrides, DRAW).select(*DRAW, "champion", "match_id", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.col("side_a").alias("side")), F.struct(F.lit(2).alias("n"), F.col("side_b").alias("side")))).alias("s"))
        own = named.where((F.size(countries_of(F.col("s.side"))) == 1) & (countries_of(F.col("s.side"))[0] == F.col("champion")))
        forced = own.groupBy(*DRAW, "champion").agg(_members(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("match_id", F.col("s.n").alias("n"), F.col("s.side").alias("side")))), lambda x: x["side"]))).alias("members"))
        forced = forced.select(*DRAW, "members", F.col("champion").alias("champion_country_code"), F.lit(False).alias("fallback"), F.lit(None).cast("string").alias("issue"))
        out = out.join(forced, DRAW, "left_anti").unionByName(forced)
    ids = F.array_join(F.transform("members", lambda p: F.coalesce(p["player_id"].cast("string"), F.lit(""))), ",")
    return out.select(*DRAW, ids.alias("champion_player_ids"), F.array_join(F.transform("members", lambda p: F.trim(p["name"])), ",").alias("champion_name"), "champion_country_code", "fallback", "issue")


def problem_ledger(found: DataFrame) -> DataFrame:
    return found.where(F.col("issue").isNotNull()).select(*DRAW, F.col("issue").alias("issue_type"))


def merge_country_changes(ties: DataFrame, history: DataFrame) -> DataFrame:
    """Ties that a player's change of country has split are one again.

    ``ties``: tie_id, sub_event_type_code, stage_code, round_code, group_code, scheduled_local_at, match_score, winner_side, sides:
    array<struct<side_no, team_code, players: array<struct<name, country>>>>. ``history``: player_name, current_country,
    historical_country. A side whose players are of one country after the mapping takes its code. Ties with one key are merged only if
    a member changed: the least id stays, scores are summed by team in its order, the winner follows the sums (equal: as it was).
    """
    h = history.groupBy(normalize_text(F.col("player_name")).alias("k"), F.upper("current_country").alias("cc")).agg(F.max("historical_country").alias("old"))
    players = ties.select("tie_id", F.explode("sides").alias("s")).select("tie_id", "s.side_no", "s.team_code", F.posexplode_outer("s.players").alias("pos", "p"))
    mapped = players.withColumns({"k": normalize_text(F.col("p.name")), "cc": F.upper(nz(F.col("p.country")))}).join(h, ["k", "cc"], "left")
    now, changed = F.coalesce("old", "p.country"), F.coalesce(F.col("old") != F.col("p.country"), F.lit(False))
    item = F.struct("pos", F.col("p.name").alias("name"), now.alias("country"))
    sides = mapped.groupBy("tie_id", "side_no", "team_code").agg(F.bool_or(changed).alias("changed"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), item))).alias("ps"))
    codes = countries_of(F.col("ps"))
    sides = sides.withColumn("team", F.when(F.col("changed") & (F.size(codes) == 1), codes[0]).otherwise(F.col("team_code")))
    both = sides.groupBy("tie_id").agg(F.max(F.when(F.col("side_no") == 1, F.col("team"))).alias("team_a"), F.max(F.when(F.col("side_no") == 2, F.col("team"))).alias("team_b"), F.bool_or("changed").alias("changed"))
    rows = ties.drop("sides").join(both, "tie_id")
    key = ["sub_event_type_code", "stage_code", "round_code", "group_code", "scheduled_local_at", "pair"]
    rows = rows.withColumn("pair", F.when(F.col("team_a").isNotNull() & F.col("team_b").isNotNull(), _pair(F.col("team_a"), F.col("team_b"))).otherwise(F.concat(F.lit("alone:"), F.col("tie_id").cast("string"))))
    filled = rows.withColumns({c: nz(F.col(c)) for c in key if c != "pair"})
    s = tie_score(F.col("match_score"))
    lo = F.least("team_a", "team_b")
    points = filled.withColumns({"lo": F.when(F.col("team_a") == lo, s["a"]).otherwise(s["b"]), "hi": F.when(F.col("team_a") == lo, s["b"]).otherwise(s["a"])})
    base = F.struct("tie_id", "team_a", "team_b", "match_score", "winner_side")
    groups = points.groupBy(*key).agg(F.bool_or("changed").alias("any"), F.count(F.lit(1)).alias("n"), F.min_by(base, F.abs("tie_id")).alias("base"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.collect_list(base).alias("all"))
    first_lo = F.col("base.team_a") == F.least("base.team_a", "base.team_b")
    a, b = F.coalesce(F.when(first_lo, F.col("lo")).otherwise(F.col("hi")), F.lit(0)), F.coalesce(F.when(first_lo, F.col("hi")).otherwise(F.col("lo")), F.lit(0))
    score = F.when((a > 0) | (b > 0), F.concat_ws("-", a.cast("string"), b.cast("string"))).otherwise(F.col("base.match_score"))
    won = F.when(a > b, "A").when(b > a, "B").otherwise(F.col("base.winner_side"))
    one = F.struct(F.col("base.tie_id").alias("tie_id"), F.col("base.team_a").alias("team_a"), F.col("base.team_b").alias("team_b"), score.alias("match_score"), won.alias("winner_side"))
    out = groups.withColumn("x", F.explode(F.when((F.col("n") > 1) & F.col("any"), F.array(one)).otherwise(F.col("all"))))
    return out.select("x.*", *[c for c in key if c != "pair"], F.when(F.col("any") & (F.col("n") > 1), F.col("n")).otherwise(1).alias("merged"))
