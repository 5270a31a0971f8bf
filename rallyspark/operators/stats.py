"""Results of players and teams: aggregate statistics, opponents, head-to-head, standings, podiums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallyspark.functions.rounds import is_team_title
from rallyspark.functions.scores import didwin, guarded_ratio, round_weight, tie_score, winner_of
from rallyspark.functions.text import id_list

#: Tier order up to which a title is one of the three or seven majors, and disciplines of individual titles.
THREE, SEVEN = 5, 9
INDIVIDUAL = ("WS", "WD", "XD")
CHAMPION = "冠军"


def fold_matches(rows: DataFrame) -> DataFrame:
    """One row for each (match_id, player_id) of joined rows, with the set of opponents' countries.

    Other fields are functions of the key (the player's country is the least where a player appears twice). Two levels of grouping:
    the first has a map-side part, so a player with very many matches is spread over them.
    """
    fields = [c for c in rows.columns if c not in ("match_id", "player_id", "opponent_country")]
    once = F.collect_set(F.when(F.col("opponent_country") != "", F.col("opponent_country")))
    return rows.where(F.col("player_id").isNotNull()).groupBy("match_id", "player_id").agg(*[F.min(c).alias(c) for c in fields], once.alias("opponent_countries"))


def is_champion(event_override: Column | None = None) -> Column:
    """Whether a player's row is a title.

    Team disciplines: the player is among the champions' ids or of the champions' country. Others: the main draw's final was won. In
    either, an override that names the player's country makes a title.
    """
    ids = F.array_contains(id_list(F.col("champion_player_ids")), F.col("player_id"))
    country = F.col("player_country") == F.col("champion_country_code")
    team = F.coalesce(ids, F.lit(False)) | F.coalesce(country, F.lit(False))
    won = (F.col("stage") == "Main Draw") & (F.col("round") == "Final") & didwin(F.col("winner_side"), F.col("side_no"))
    title = F.when(is_team_title(F.col("sub_event_type_code")), team).otherwise(F.coalesce(won, F.lit(False)))
    return title if event_override is None else title | F.coalesce(event_override == F.col("player_country"), F.lit(False))


def adult(category: Column) -> Column:
    """Not a youth tier; an unknown category counts as adult."""
    return F.coalesce(~F.upper(category).rlike("YOUTH|JUNIOR|CADET"), F.lit(True))


def player_stats(rows: DataFrame) -> DataFrame:
    """Aggregate statistics of every player of the joined rows (match x side x player x opponents).

    Columns: match_id, event_id, stage, round, winner_side, sub_event_type_code, sort_order, category_id, player_id, player_country,
    side_no, opponent_country, champion_country_code, champion_player_ids. Ratios are not rounded.
    """
    folded = fold_matches(rows).where(adult(F.col("category_id")))
    won = didwin(F.col("winner_side"), F.col("side_no"))
    known = (F.coalesce("player_country", F.lit("")) != "") & (F.size("opponent_countries") > 0)
    same = F.forall("opponent_countries", lambda c: c == F.col("player_country"))
    event = F.when(F.col("event_id").isNotNull(), F.concat_ws(":", F.col("event_id").cast("string"), F.coalesce("sub_event_type_code", F.lit(""))))
    seven, three = F.col("sort_order").between(1, SEVEN), F.col("sort_order").between(1, THREE)
    single, own = F.col("sub_event_type_code") == "WS", F.col("sub_event_type_code").isin(*INDIVIDUAL)
    flags = folded.withColumns({"won": won, "domestic": known & same, "foreign": known & ~same, "key": event, "title": is_champion(), "seven": F.coalesce(seven, F.lit(False)), "three": F.coalesce(three, F.lit(False))})
    final = (F.col("stage") == "Main Draw") & (F.col("round") == "Final")
    # counts of matches add up and flags of an event join by or, so events are folded first: no row is copied for distinct counts
    matches = {
        "foreign_matches": F.col("foreign"), "foreign_wins": F.col("foreign") & F.col("won"), "domestic_matches": F.col("domestic"), "domestic_wins": F.col("domestic") & F.col("won"),
    }
    events = {
        "seven_events": [F.col("seven")], "seven_finals": [F.col("seven"), F.coalesce(final, F.lit(False)) | F.col("title")], "all_seven_titles": [F.col("seven"), F.col("title")],
        "all_three_titles": [F.col("three"), F.col("title")], "event_seven_titles": [F.col("seven"), F.col("title"), own], "event_three_titles": [F.col("three"), F.col("title"), own],
        "single_seven_titles": [F.col("seven"), F.col("title"), single], "single_three_titles": [F.col("three"), F.col("title"), single],
    }
    by_event = flags.groupBy("player_id", "event_id", "key").agg(*[F.count_if(c).alias(n) for n, c in matches.items()], *[F.bool_or(F.coalesce(_all(*c), F.lit(False))).alias(n) for n, c in events.items()])
    out = by_event.groupBy("player_id").agg(
        *[F.sum(n).alias(n) for n in matches], F.count_distinct("event_id").alias("events_total"), *[F.count_if(F.col(n) & F.col("key").isNotNull()).alias(n) for n in events]
    )
    return out.withColumns({
        "foreign_win_rate": guarded_ratio(F.col("foreign_wins"), F.col("foreign_matches")), "domestic_win_rate": guarded_ratio(F.col("domestic_wins"), F.col("domestic_matches")),
        "seven_titles": F.col("event_seven_titles"), "three_titles": F.col("event_three_titles"),
    })


def _all(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def career(players: DataFrame, stats: DataFrame) -> DataFrame:
    """Stored career counters beside computed statistics; the two sources are kept apart."""
    stored = players.select("player_id", F.coalesce("career_matches", F.lit(0)).alias("total_matches"), F.coalesce("career_wins", F.lit(0)).alias("total_wins"))
    return stored.withColumn("win_rate", guarded_ratio(F.col("total_wins"), F.col("total_matches"))).join(stats, "player_id", "left").fillna(0)


def opponent_table(rows: DataFrame) -> DataFrame:
    """Opponents of each player: matches, wins, latest date and rate; opponents are told apart by id and name, each of a pair counts."""
    named = rows.where(F.coalesce("opponent_name", F.lit("")) != "")
    out = named.groupBy("player_id", "opponent_id", "opponent_name").agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(didwin(F.col("winner_side"), F.col("side_no"))).alias("wins"), F.max("start_date").alias("latest_date")
    )
    return out.withColumn("win_rate", guarded_ratio(F.col("wins"), F.col("matches")))


def head_to_head_summary(meetings: DataFrame) -> DataFrame:
    """One row of wins of both, undecided meetings and rates over all meetings (columns winner_side, side_a, side_b)."""
    a, b = didwin(F.col("winner_side"), F.col("side_a")), didwin(F.col("winner_side"), F.col("side_b"))
    out = meetings.agg(F.count(F.lit(1)).alias("total"), F.count_if(a).alias("wins_a"), F.count_if(b).alias("wins_b"))
    return out.withColumns({"undecided": F.col("total") - F.col("wins_a") - F.col("wins_b"), "rate_a": guarded_ratio(F.col("wins_a"), F.col("total")), "rate_b": guarded_ratio(F.col("wins_b"), F.col("total"))})


def best_results(rows: DataFrame) -> DataFrame:
    """Best result of each (player_id, event_id, sub_event_type_code).

    Rows come in source order (``seq`` ascending). A row replaces the one held if its round weighs more, or if it is a title and the
    held one is none; so a later, heavier row without a title replaces a title. The fold runs inside one sorted array of a player's
    rows at one event and discipline, which the number of rounds bounds.
    """
    keys = ["player_id", "event_id", "sub_event_type_code"]
    item = F.struct("seq", round_weight(F.col("round")).alias("weight"), F.col("is_champion").alias("title"), "round")
    listed = rows.where(F.col("event_id").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    take = lambda held, x: (x["weight"] > held["weight"]) | (x["title"] & ~held["title"])
    best = F.aggregate("items", F.col("items")[0], lambda held, x: F.when(take(held, x), x).otherwise(held))
    out = listed.withColumn("best", best)
    return out.select(*keys, F.when(F.col("best.title"), F.lit(CHAMPION)).otherwise(F.col("best.round")).alias("result"), F.col("best.weight").alias("weight"), F.col("best.title").alias("is_champion"))


def standings(teams: DataFrame, ties: DataFrame, group: str = "group_code") -> DataFrame:
    """Table of each group: played, won, lost, points, score for and against, rank.

    ``teams`` lists (group, team_code); teams without a decided tie have zeros. ``ties`` has team_a, team_b and score texts. Ranks go by
    points, wins, score difference, score for and code, none shared.
    """
    score = tie_score(F.col("match_score"))
    decided = ties.withColumns({"s": score, "w": F.coalesce("winner_side", winner_of(score))}).where(F.col("w").isNotNull())
    row = lambda team, own, other, side: F.struct(F.col(team).alias("team_code"), (F.col("w") == side).alias("won"), F.coalesce(F.col(f"s.{own}"), F.lit(0)).alias("plus"), F.coalesce(F.col(f"s.{other}"), F.lit(0)).alias("minus"))
    both = decided.select(group, F.explode(F.array(row("team_a", "a", "b", "A"), row("team_b", "b", "a", "B"))).alias("r")).select(group, "r.*")
    agg = both.groupBy(group, "team_code").agg(
        F.count(F.lit(1)).alias("played"), F.count_if("won").alias("won"), F.count_if("won").alias("points"), F.sum("plus").alias("score_for"), F.sum("minus").alias("score_against")
    )
    full = teams.select(group, "team_code").distinct().join(agg, [group, "team_code"], "left").fillna(0)
    full = full.withColumns({"lost": F.col("played") - F.col("won"), "difference": F.col("score_for") - F.col("score_against")})
    order = W.partitionBy(group).orderBy(F.desc("points"), F.desc("won"), F.desc("difference"), F.desc("score_for"), "team_code")
    return full.withColumn("rank", F.row_number().over(order))


def podium(ties: DataFrame, keys: list[str], live: bool = False) -> DataFrame:
    """(keys, place, team_code) from knockout ties (draw_round, winner_side, team_a, team_b).

    The final gives places 1 and 2, a decided bronze tie 3 and 4. Else the losers of the semifinals share place 3, finalists left out:
    in the live view only if no bronze tie exists, in the historical view if none has a winner. A team keeps its best place.
    """
    won, lost = F.when(F.col("winner_side") == "A", F.col("team_a")).otherwise(F.col("team_b")), F.when(F.col("winner_side") == "A", F.col("team_b")).otherwise(F.col("team_a"))
    decided = ties.where(F.col("winner_side").isin("A", "B"))
    place = lambda df, c, n: df.select(*keys, F.lit(n).alias("place"), c.alias("team_code"))
    final, bronze = decided.where("draw_round = 'Final'"), decided.where("draw_round = 'Bronze'")
    blocked = (ties.where("draw_round = 'Bronze'") if live else bronze).select(*keys).distinct()
    semi = place(decided.where("draw_round = 'SemiFinal'"), lost, 3).join(blocked, keys, "left_anti")
    finalists = ties.where("draw_round = 'Final'").select(*keys, F.explode(F.array("team_a", "team_b")).alias("team_code"))
    semi = semi.join(finalists, [*keys, "team_code"], "left_anti")
    rows = place(final, won, 1).union(place(final, lost, 2)).union(place(bronze, won, 3)).union(place(bronze, lost, 4)).unionByName(semi)
    return rows.where(F.col("team_code").isNotNull()).groupBy(*keys, "team_code").agg(F.min("place").alias("place"))


def legacy_totals(rankings: DataFrame, matches: DataFrame) -> DataFrame:
    """Ranking rows with totals of events, matches and wins of each player's match files."""
    totals = matches.groupBy("player_id").agg(F.count_distinct("event_name").alias("events"), F.count(F.lit(1)).alias("matches"), F.count_if(F.col("result") == "W").alias("wins"))
    return rankings.join(totals, "player_id", "left").fillna(0, subset=["events", "matches", "wins"])
