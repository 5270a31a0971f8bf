"""Messages of live, official and schedule feeds folded into the last state of ties, rubbers and units.

The importers apply one message after the other. Their rules allow a closed form, so a state is one aggregate for each key, reduced
before the shuffle: an official final result can be replaced by another one only, fields are patched or filled, a status never falls.
Orders (``order``) must be unique within a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyspark.functions.scores import IMPORT_STATUS, didwin, flip_score, forfeit, match_score, status_priority
from rallyspark.functions.text import nz, rubber_label
from rallyspark.operators.relational import _cols, top_row

#: Statuses and sources of an official final result.
FINAL = ("completed", "walkover")
OFFICIAL = ("official", "completed")


def official_final(status: Column, source: Column) -> Column:
    """Whether a result is final and comes from an official source; false for nulls."""
    tidy = lambda c: F.lower(F.trim(nz(c)))
    return tidy(status).isin(*FINAL) & tidy(source).isin(*OFFICIAL)


def accepted(messages: DataFrame, keys: str | list[str], order: str, status: str = "status", source: str = "source_status") -> DataFrame:
    """The messages that change a state: from the first official final one on, only such messages do.

    The column ``final`` says which messages those are. Null keys are keys like others.
    """
    keys = _cols(keys)
    marked = messages.withColumn("final", official_final(F.col(status), F.col(source)))
    first = marked.where("final").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(order).alias("_from"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = marked.join(first, same, "left")
    return joined.where(F.col("_from").isNull() | F.col("final") | (F.col(order) < F.col("_from"))).select(*marked.columns)


def replay(
    messages: DataFrame, keys: str | list[str], order: str, latest: list[str], patched: list[str] = (), filled: list[str] = (), initial: list[str] = (), status: str = "status", source: str = "source_status"
) -> DataFrame:
    """State of each key after all its messages: ties, single matches or rubbers.

    ``latest`` columns are those of the last accepted message, nulls included (score, winner, children that are replaced whole);
    ``patched`` ones its last value that is not null (source status, session, table, sides only if supplied); ``filled`` ones the first
    such value (stage, round, group); ``initial`` ones stand as the first message had them. ``final`` and ``synced`` (the last accepted
    message's order) are added. No messages: no rows. The feeds derive a status from its source, so a final status without a source is not
    official even where an earlier source was.
    """
    rows = accepted(messages, keys, order, status, source)
    at, there = F.col(order), lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    return rows.groupBy(*_cols(keys)).agg(
        *[F.max_by(c, at).alias(c) for c in latest], *[F.max_by(c, there(c)).alias(c) for c in patched], *[F.min_by(c, there(c)).alias(c) for c in filled],
        *[F.min_by(c, at).alias(c) for c in initial], F.max_by("final", at).alias("final"), F.max(at).alias("synced"),
    )


def rubber_code(tie: Column, number: Column) -> Column:
    """Code of a tie's nth rubber."""
    return F.concat(tie, F.lit("::R"), number.cast("string"))


def rubber_messages(messages: DataFrame, code: str, rubbers: str) -> DataFrame:
    """One message for each rubber of a tie's message, with the tie's fields, ``rubber_no`` from 1 and ``rubber_code``.

    ``rubbers`` is an array of structs, whose fields become columns; ties without rubbers have no row.
    """
    rest = [c for c in messages.columns if c != rubbers]
    each = messages.select(*rest, F.posexplode(rubbers).alias("_at", "_rubber"))
    return each.select(*rest, (F.col("_at") + 1).alias("rubber_no"), rubber_code(F.col(code), F.col("_at") + 1).alias("rubber_code"), "_rubber.*")


def official_matches(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Single matches after all official and live results: the matches, their sides and their players.

    Messages have event_id, external_match_code, seq, status, source_status, match_score, winner_side, session_label, table_no, stage_code,
    round_code and ``sides``: array<struct<side_no, team_code, players: array<struct<player_id, name, country>>>>. An accepted message
    replaces all sides and players of its match; one without sides leaves none. A side wins by the match's winner.
    """
    keys = ["event_id", "external_match_code"]
    states = replay(messages, keys, "seq", ["status", "match_score", "winner_side", "sides"], ["source_status", "session_label", "table_no"], ["stage_code", "round_code"])
    sides = states.select(*keys, "winner_side", F.explode("sides").alias("s")).select(*keys, "s.side_no", "s.team_code", F.coalesce(didwin(F.col("winner_side"), F.col("s.side_no")), F.lit(False)).alias("is_winner"), "s.players")
    players = sides.select(*keys, "side_no", F.posexplode("players").alias("_at", "p")).select(*keys, "side_no", (F.col("_at") + 1).alias("player_order"), "p.*")
    return states.drop("sides"), sides.drop("players"), players


def cascaded(ties: DataFrame, rubbers: DataFrame, code: str) -> DataFrame:
    """Rubbers after their ties' last message: those without an official final result take over the tie's status and, if it has one, its source.

    Both are results of ``replay``; a rubber whose own last message is later than its tie's keeps its own.
    """
    t = ties.select(F.col(code).alias("_code"), F.col("status").alias("_status"), F.col("source_status").alias("_source"), F.col("synced").alias("_synced"))
    taken = ~F.col("final") & F.coalesce(F.col("_synced") > F.col("synced"), F.lit(False))
    out = rubbers.join(t, F.col(code) == F.col("_code"), "left")
    status = F.when(taken, F.col("_status")).otherwise(F.col("status"))
    source = F.when(taken, F.coalesce("_source", "source_status")).otherwise(F.col("source_status"))
    return out.withColumns({"status": status, "source_status": source}).select(*rubbers.columns)


def flipped_sets(sets: Column) -> Column:
    """Set scores of a comma-separated text turned round; blank parts go, parts that are no score stay as they are."""
    parts = F.filter(F.transform(F.split(nz(sets), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(match_score(x).isNotNull(), flip_score(x)).otherwise(x))


def completed_rubbers(games: DataFrame, first_is_a: str = "team1_is_side_a") -> DataFrame:
    """Finished rubbers in side A's view: players, score, winner and sets are turned round where the first team is side B.

    Needs tie_code, tie_session, game_order, player1, player2, game_score, marker and set_scores.
    """
    a = F.coalesce(F.col(first_is_a), F.lit(False))
    blank = lambda c: F.trim(nz(F.col(c)))
    plain = F.filter(F.transform(F.split(nz(F.col("set_scores")), ","), lambda x: F.trim(x)), lambda x: x != "")
    view = forfeit(F.col("game_score"), a, F.col("marker"))
    player_a, player_b = F.when(a, blank("player1")).otherwise(blank("player2")), F.when(a, blank("player2")).otherwise(blank("player1"))
    return games.select(
        rubber_code(F.col("tie_code"), F.col("game_order")).alias("rubber_code"), rubber_label(F.col("tie_session"), F.col("game_order")).alias("session_label"),
        player_a.alias("player_a"), player_b.alias("player_b"), view["score"].alias("match_score"), view["winner"].alias("winner_side"),
        F.when(a, plain).otherwise(flipped_sets(F.col("set_scores"))).alias("games"), F.lit("completed").alias("status"),
    )


def found_ties(wanted: DataFrame, ties: DataFrame) -> DataFrame:
    """``wanted`` with the ``tie_id`` that each of its rows means, null where none or more than one fits best.

    By code first. Else by event, discipline and the two teams in either order; a given group must be the tie's. Of several the ones with
    the stage and round, the time, the match number and the table that are asked for go first, in this order: each test only narrows where
    something is left, which is the largest tuple of the tests.
    """
    pair = lambda a, b: [F.least(a, b).alias("_low"), F.greatest(a, b).alias("_high")]
    fields = ["stage_code", "round_code", "group_code", "scheduled_local_at", "match_no", "table_no"]
    unit = ["event_id", "sub_event_type_code"]
    coded = ties.where(nz(F.col("external_match_code")) != "").groupBy("event_id", "external_match_code").agg(F.min("tie_id").alias("_coded"))
    pairs = ties.select("tie_id", *unit, *pair(F.col("team1"), F.col("team2")), *[F.col(c).alias(f"_{c}") for c in fields])
    asked = wanted.where(F.col("team1").isNotNull() & F.col("team2").isNotNull()).select("wanted_id", *unit, *pair(F.col("team1"), F.col("team2")), *fields)
    same = lambda c: F.coalesce(nz(F.col(c)) == nz(F.col(f"_{c}")), F.lit(False))
    given = lambda c: F.coalesce((F.col(c) == F.col(f"_{c}")), F.lit(False))
    grouped = nz(F.col("group_code")) != ""
    staged = ~grouped & (nz(F.col("stage_code")) != "") & (nz(F.col("round_code")) != "") & same("stage_code") & same("round_code")
    near = asked.join(pairs, [*unit, "_low", "_high"]).where(~grouped | given("group_code"))
    fit = F.struct(staged.alias("s"), given("scheduled_local_at").alias("t"), given("match_no").alias("m"), given("table_no").alias("n"))
    classes = near.groupBy("wanted_id", fit.alias("fit")).agg(F.count(F.lit(1)).alias("n"), F.min("tie_id").alias("tie_id"))
    best = top_row(classes, "wanted_id", F.col("fit")).select("wanted_id", F.when(F.col("n") == 1, F.col("tie_id")).alias("_paired"))
    out = wanted.join(coded, ["event_id", "external_match_code"], "left").join(best, "wanted_id", "left")
    return out.select(*wanted.columns, F.coalesce("_coded", "_paired").alias("tie_id"))


def ensured_ties(wanted: DataFrame, ties: DataFrame) -> DataFrame:
    """Ties after finished results: empty fields of known ties are filled, results without a tie become ties of their own.

    Columns as ``ties``; new ones have a null ``tie_id``, a code made of discipline, group or round, session and teams, and are taken once
    for each code (the least ``wanted_id``). Filling takes the first value by ``wanted_id``.
    """
    fields = ["stage_code", "round_code", "group_code", "scheduled_local_at"]
    found = found_ties(wanted, ties)
    there = lambda c: F.when(F.col(c).isNotNull(), F.col("wanted_id"))
    fill = found.where(F.col("tie_id").isNotNull()).groupBy("tie_id").agg(*[F.min_by(c, there(c)).alias(f"_{c}") for c in fields])
    known = ties.join(fill, "tie_id", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in fields}).select(*ties.columns)
    part = F.coalesce(F.nullif("group_code", F.lit("")), F.nullif("round_code", F.lit("")), F.lit("UNK"))
    code = F.concat(F.lit("COMP::"), F.col("sub_event_type_code"), F.lit("::"), part, F.lit("::"), F.coalesce("match_no", F.lit(0)).cast("string"), F.lit("::"), F.col("team1"), F.lit("-"), F.col("team2"))
    named = F.coalesce(F.nullif("external_match_code", F.lit("")), code)
    new = top_row(found.where(F.col("tie_id").isNull()).withColumn("external_match_code", named), ["event_id", "external_match_code"], F.col("wanted_id"), largest=False)
    return known.unionByName(new.select(*[F.col(c).cast(t).alias(c) for c, t in ties.dtypes]))


def scheduled_units(units: DataFrame, discipline: Column, team: Column, keys: str | list[str], order: str, patched: list[str], latest: list[str] = ()) -> DataFrame:
    """Ties and matches after all schedule messages; units of an unknown discipline (null) are left out.

    ``kind`` is team_tie or match. A status falls never and the later one wins on equality: the last one of the highest priority. ``patched``
    columns keep their last value that is not null, ``latest`` ones (children, which are replaced) are those of the last message.
    """
    rows = units.withColumn("sub_event_type_code", discipline).where(F.col("sub_event_type_code").isNotNull()).withColumn("kind", F.when(team, "team_tie").otherwise("match"))
    there = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    rank = F.struct(status_priority(F.col("status"), IMPORT_STATUS), F.col(order))
    return rows.groupBy("kind", *_cols(keys)).agg(
        F.max_by("status", rank).alias("status"), *[F.max_by(c, there(c)).alias(c) for c in patched], *[F.max_by(c, F.col(order)).alias(c) for c in latest],
    )
