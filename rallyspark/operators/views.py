"""Read views: tournament lists, nested matches and ties, events of a player, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyspark.functions.dates import display_status
from rallyspark.functions.scores import didwin, tie_score
from rallyspark.functions.text import event_id_from_href, normalize_event_name, nz, single_country
from rallyspark.operators.relational import contains_any, existing, first_nonzero, nested, page, search_rank, top_row, waterfall


def match_view(matches: DataFrame, sides: DataFrame, players: DataFrame, display: DataFrame | None = None) -> DataFrame:
    """Matches with nested sides and players.

    sides: match_id, side_no, side_id; players: side_id, player_order, player_id, player_name, player_country; display: player_id, slug,
    name_zh. Two groupings, each of one match's rows.
    """
    p = players
    if display is not None:
        p = p.join(display.select("player_id", "slug", "name_zh"), "player_id", "left")
    fields = [c for c in p.columns if c not in ("side_id",)]
    listed = nested(p, ["side_id"], ["player_order"], fields, "players")
    s = sides.join(listed, "side_id", "left").withColumn("team_code", single_country(F.col("players"), "player_country"))
    both = nested(s, ["match_id"], ["side_no"], ["side_no", "team_code", "players"], "sides")
    out = matches.join(both, "match_id", "left")
    won = F.transform("sides", lambda x: F.struct(x["side_no"].alias("side_no"), x["team_code"].alias("team_code"), x["players"].alias("players"), didwin(F.col("winner_side"), x["side_no"]).alias("is_winner")))
    return out.withColumn("sides", won)


def tie_view(ties: DataFrame, rubbers: DataFrame, final_status: tuple[str, ...] = ("completed", "walkover")) -> DataFrame:
    """Ties with their rubbers nested in order; a finished tie shows finished rubbers only."""
    status = ties.select("tie_id", F.col("status").alias("_tie"))
    shown = rubbers.join(status, "tie_id").where(~F.col("_tie").isin(*final_status) | F.col("status").isin(*final_status)).drop("_tie")
    fields = [c for c in shown.columns if c != "tie_id"]
    return ties.join(nested(shown, ["tie_id"], ["rubber_order"], fields, "rubbers"), "tie_id", "left")


def tournament_list(events: DataFrame, children: list[tuple[DataFrame, str]], terms: list[str], as_of: Column, limit: int, offset: int = 0, year: int | None = None) -> DataFrame:
    """Page of tournaments: begun by ``as_of``, with rows in any child table, names that hold a term, counts and display status."""
    rows = events.where(F.col("start_date").isNull() | (F.col("start_date") <= F.to_date(as_of))).where(F.coalesce(F.col("filtering_only"), F.lit(0)) == 0)
    rows = rows if year is None else rows.where(F.col("year") == year)
    rows = rows.where(contains_any(["name", "name_zh"], terms)) if terms else rows
    rows = first_nonzero(existing(rows, "event_id", *children), "event_id", children, "total_matches", "matches")
    rows = rows.withColumn("display_status", display_status(F.col("lifecycle_status"), F.col("start_date"), F.col("end_date"), F.col("time_zone"), as_of))
    return page(rows, [F.desc_nulls_last("start_date"), F.desc("event_id")], limit, offset)


def latest_snapshot(snapshots: DataFrame, category: str | None = None) -> DataFrame:
    """The latest snapshot of each category: newest date, then largest id."""
    rows = snapshots if category is None else snapshots.where(F.col("category") == category)
    return top_row(rows, "category", F.struct("ranking_date", "snapshot_id"))


def rankings(snapshots: DataFrame, entries: DataFrame, players: DataFrame, category: str, limit: int, offset: int = 0, by_rate: bool = False) -> DataFrame:
    """Page of the latest ranking, by rank or by career win rate (more than five events)."""
    last = latest_snapshot(snapshots, category).select("snapshot_id", "ranking_date")
    rows = entries.join(last, "snapshot_id").join(players, "player_id")
    rate = F.coalesce(F.col("career_wins").cast("double") / F.nullif(F.col("career_matches").cast("double"), F.lit(0.0)) * 100, F.lit(0.0))
    rows = rows.withColumn("win_rate", rate)
    if by_rate:
        return page(rows.where("career_events > 5"), [F.desc("win_rate"), F.asc("rank"), F.asc("player_id")], limit, offset)
    return page(rows, [F.asc("rank"), F.asc("player_id")], limit, offset)


def search_players(players: DataFrame, entries: DataFrame, snapshots: DataFrame, query: str, limit: int = 10, category: str = "women_singles", country: str = "") -> DataFrame:
    """Players whose names hold the query, by relevance and present rank. Without a snapshot of the category there are no hits."""
    last = latest_snapshot(snapshots, category).select("snapshot_id")
    ranks = entries.join(last, "snapshot_id").select("player_id", "rank")
    rows = players.where(contains_any(["name", "name_zh", "slug"], [query.strip()]))
    rows = rows if not country else rows.where(F.col("country_code") == country)
    some = last.limit(1).agg((F.count(F.lit(1)) > 0).alias("_some"))
    rows = rows.join(ranks, "player_id", "left").crossJoin(F.broadcast(some)).where("_some").drop("_some")  # one row is broadcast
    ranked = rows.withColumn("relevance", search_rank(query.strip(), "name", "name_zh", "slug", "rank"))
    return ranked.orderBy("relevance", F.coalesce("rank", F.lit(999999)), "name", "player_id").limit(max(1, min(limit, 20)))


def by_position(rows: DataFrame, ids: str, table: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of a table for an array of ids, in the array's order; unknown ids are left out."""
    marked = rows.withColumn("_id", F.monotonically_increasing_id())
    asked = marked.select("_id", F.posexplode(ids).alias("_pos", key))
    found = asked.join(table, key)
    listed = found.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.struct(*table.columns).alias("row")))), lambda x: x["row"]).alias(name))
    return marked.join(listed, "_id", "left").drop("_id")


def by_id_or_name(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Display columns by player id, else by exact trimmed name (of several the last id)."""
    own = table.select("player_id", *[F.col(c).alias(f"_a_{c}") for c in columns])
    named = table.groupBy(F.trim("name").alias("_name")).agg(F.max_by(F.struct(*columns), "player_id").alias("_b"))
    out = rows.withColumn("_name", F.trim("player_name")).join(own, "player_id", "left").join(named, "_name", "left")
    return out.select(*rows.columns, *[F.coalesce(f"_a_{c}", f"_b.{c}").alias(c) for c in columns])


def calendar_rows(calendar: DataFrame, events: DataFrame) -> DataFrame:
    """Calendar rows with event_id: by name and year, by a name that one event has, else by the id in the link."""
    e = events.select("event_id", "year", normalize_event_name(F.col("name")).alias("k"))
    c = calendar.withColumns({"k": normalize_event_name(F.col("name")), "_href": event_id_from_href(F.col("href"))})
    out = waterfall(c, [(e, {"k": "k", "year": "year"}, "event_id"), (e, {"k": "k"}, "event_id"), (e, {"_href": "event_id"}, "event_id")], "event_id")
    return out.drop("k", "_href")


def carried_translations(incoming: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Missing translations from last year's rows, by name, else by link."""
    by = lambda key, p: previous.where(nz(F.col(key)) != "").groupBy(key).agg(*[F.max(c).alias(f"{p}{c}") for c in columns])
    out = incoming.join(by("name", "_n"), "name", "left").join(by("href", "_h"), "href", "left")
    return out.withColumns({c: F.coalesce(F.nullif(c, F.lit("")), f"_n{c}", f"_h{c}") for c in columns}).select(*incoming.columns)


def presentation_mode(override: Column, has_knockout: Column, has_round_robin: Column) -> Column:
    return F.coalesce(override, F.when(has_knockout, "knockout").when(has_round_robin, "round_robin").otherwise("knockout"))


def staged_view(ties: DataFrame, stages: DataFrame) -> DataFrame:
    """Ties of an override's stages in order, nested: one row for each stage and group.

    stages: event_id, position, stage, format, group_code, group_name (no group: the whole stage). A group takes the ties of its stage
    whose round is its code, a stage without groups all of them.
    """
    s, t = stages.alias("s"), ties.alias("t")
    own = (F.col("s.event_id") == F.col("t.event_id")) & (F.col("s.stage") == F.col("t.stage")) & (F.col("s.group_code").isNull() | (F.col("s.group_code") == F.col("t.round")))
    item = F.struct("t.tie_id", "t.team_a", "t.team_b", "t.match_score", "t.winner_side")
    rows = s.join(t, own, "left").groupBy("s.event_id", "s.position", "s.stage", "s.format", "s.group_code", "s.group_name")
    return rows.agg(F.array_sort(F.collect_list(F.when(F.col("t.tie_id").isNotNull(), item))).alias("ties"))


def knockout_rounds(ties: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """Ties by resolved round, latest round last; an override's round (event_id, tie_id, code, label, round_order) goes before a tie's own."""
    rows = ties
    if override is not None:
        named = override.select("event_id", "tie_id", *[F.col(c).alias(f"_{c}") for c in ("code", "label", "round_order")])
        rows = ties.join(named, ["event_id", "tie_id"], "left")
        rows = rows.withColumns({c: F.coalesce(f"_{c}", c) for c in ("code", "label", "round_order")}).drop("_code", "_label", "_round_order")
    item = F.struct("tie_id", "team_a", "team_b", "match_score", "winner_side")
    return rows.groupBy("event_id", "code", "label", "round_order").agg(F.array_sort(F.collect_list(item)).alias("ties")).orderBy("event_id", "round_order")


def override_ties(ties: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first tie between the two teams that an override names (event_id, role, first_code, second_code), in either order."""
    w = wanted.select("event_id", "role", F.least("first_code", "second_code").alias("_lo"), F.greatest("first_code", "second_code").alias("_hi"))
    t = ties.withColumns({"_lo": F.least("team_a", "team_b"), "_hi": F.greatest("team_a", "team_b")})
    return w.join(t.groupBy("event_id", "_lo", "_hi").agg(F.min("tie_id").alias("tie_id")), ["event_id", "_lo", "_hi"], "left").select("event_id", "role", "tie_id")


def live_tie_view(ties: DataFrame, sides: DataFrame, brackets: DataFrame, rubbers: DataFrame) -> DataFrame:
    """Ties of running events with both teams, scores and rubbers in order.

    ties: tie_id, event_id, sub_event_type_code, external_match_code, match_score; sides: tie_id, side_no, team_code, team_name;
    brackets: event_id, sub_event_type_code, external_unit_code, side_a_team_code, side_b_team_code; rubbers: tie_id, match_id and more.
    A side without a team takes the bracket's team of the same code (of several rows the greatest), else ``TBD``; its name is the
    code where none is given. A missing side is empty, a tie without sides is left out, a score that cannot be read is 0.
    """
    own = lambda n: F.max(F.when(F.col("side_no") == n, F.struct("team_code", "team_name")))
    both = sides.groupBy("tie_id").agg(own(1).alias("_a"), own(2).alias("_b"))
    unit = ["event_id", "sub_event_type_code", "external_match_code"]
    placed = brackets.where(F.col("external_unit_code").isNotNull()).withColumnRenamed("external_unit_code", "external_match_code")
    draw = placed.groupBy(*unit).agg(F.max(F.struct("side_a_team_code", "side_b_team_code")).alias("_draw"))

    def team(side: str, drawn: str) -> Column:
        code = F.coalesce(f"{side}.team_code", f"_draw.{drawn}", F.lit("TBD"))
        given = F.struct(code.alias("code"), F.coalesce(f"{side}.team_name", code).alias("name"))
        return F.when(F.col(side).isNotNull(), given).otherwise(F.struct(F.lit("").alias("code"), F.lit("").alias("name")))

    score = tie_score(F.col("match_score"))
    listed = nested(rubbers, ["tie_id"], ["match_id"], [c for c in rubbers.columns if c != "tie_id"], "rubbers")
    rows = ties.join(both, "tie_id").join(draw, unit, "left").join(listed, "tie_id", "left")
    shown = {"team_a": team("_a", "side_a_team_code"), "team_b": team("_b", "side_b_team_code"), "score_a": F.coalesce(score["a"], F.lit(0)), "score_b": F.coalesce(score["b"], F.lit(0))}
    return rows.withColumns(shown).drop("_a", "_b", "_draw")


def tie_detail(ties: DataFrame, players: DataFrame) -> DataFrame:
    """Detail of a merged or overriding tie, rebuilt from its rubbers: score, winner's side, round and every side's players.

    ties: tie_id, team_a, team_b, winner_code, score_a, score_b, round; players: tie_id, match_id, side_no, player_no, player_id, name,
    country_code. A player stands once for each name and country, where the rubbers name them first, with what the last rubber says. The
    round is what stands behind the last colon. Ties without players have empty lists; a winner that is neither team has no side.
    """
    at = F.struct("match_id", "player_no", F.col("player_id"))
    who = players.withColumn("_who", F.concat_ws("|", nz(F.col("name")), nz(F.col("country_code"))))
    once = who.groupBy("tie_id", "side_no", "_who").agg(F.min(at).alias("_at"), F.max_by(F.struct("player_id", "name", "country_code"), at).alias("_player"))
    of = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("side_no") == n, F.struct("_at", "_who", "_player")))), lambda x: x["_player"])
    sides = once.groupBy("tie_id").agg(of(1).alias("players_a"), of(2).alias("players_b"))
    won = lambda c: F.coalesce(F.col("winner_code") == F.col(c), F.lit(False))
    none = lambda c: F.coalesce(c, F.array().cast(sides.schema[c].dataType))
    return ties.join(sides, "tie_id", "left").select(
        "tie_id", F.concat(F.col("score_a").cast("string"), F.lit("-"), F.col("score_b").cast("string")).alias("match_score"), F.when(won("team_a"), "A").when(won("team_b"), "B").alias("winner_side"),
        F.substring_index("round", ":", -1).alias("round_code"), "team_a", none("players_a").alias("players_a"), "team_b", none("players_b").alias("players_b"),
    )
