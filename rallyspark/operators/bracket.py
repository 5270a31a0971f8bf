"""Elimination brackets: draw rows, bronze matches, feeder links, positions, display order and virtual byes.

``matches`` has match_id, event_id, category_code, sub_event_type_code, stage, round, side_a_key, side_b_key, winner_side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallyspark.functions.rounds import DRAW_ORDER, draw_order, draw_round, non_tour, position_round_two, stage_prefix, team_round
from rallyspark.functions.text import nz
from rallyspark.operators.relational import set_pairs
from rallyspark.sources.shared import discard, stored

DRAW = ["event_id", "sub_event_type_code"]


def side_of(winner: Column, side: str) -> Column:
    """Side key of the winner (``won``) or the loser; null without a winner."""
    w = F.upper(F.trim(nz(winner)))
    a, b = (F.col("side_a_key"), F.col("side_b_key")) if side == "won" else (F.col("side_b_key"), F.col("side_a_key"))
    return F.nullif(F.when(w == "A", a).when(w == "B", b), F.lit(""))


def draw_rows(matches: DataFrame) -> DataFrame:
    """Matches of the main draw with draw_round, round_order, bronze_source and bronze_verified.

    Bronze is a match named so; one of exactly two finals outside the tour whose sides are semifinal losers; or round two of a
    position draw with such sides.
    """
    named = matches.withColumns({
        "draw_round": draw_round(F.col("event_id"), F.col("stage"), F.col("round")), "_pair": F.array_sort(F.array(nz(F.col("side_a_key")), nz(F.col("side_b_key")))),
        "_other": non_tour(F.col("category_code")), "_loser": side_of(F.col("winner_side"), "lost"),
    })
    losers = set_pairs(named.where("draw_round = 'SemiFinal'"), DRAW, "_loser").select(*DRAW, F.array("first", "second").alias("_pair"), F.lit(True).alias("_semi"))
    finals = named.where("draw_round = 'Final'").groupBy(*DRAW).agg(F.count(F.lit(1)).alias("_finals"))
    rows = named.join(losers, [*DRAW, "_pair"], "left").join(finals, DRAW, "left")
    semi = F.coalesce("_semi", F.lit(False))
    twin = (F.col("draw_round") == "Final") & F.col("_other") & (F.col("_finals") == 2) & semi
    placed = F.col("draw_round").isNull() & F.col("_other") & position_round_two(F.col("stage"), F.col("round")) & semi
    source = F.when(F.col("draw_round") == "Bronze", "explicit_bronze").when(twin, "final_reclassified").when(placed, "position_draw_round2")
    out = rows.withColumn("bronze_source", source).withColumn("draw_round", F.when(F.col("bronze_source").isNotNull(), "Bronze").otherwise(F.col("draw_round")))
    out = out.where(F.col("draw_round").isNotNull()).withColumns({"round_order": draw_order(F.col("draw_round")), "bronze_verified": F.col("bronze_source").isNotNull() & semi})
    return out.select(*matches.columns, "draw_round", "round_order", "bronze_source", "bronze_verified")


def feeder_links(rows: DataFrame) -> DataFrame:
    """Add side_a_previous and side_b_previous: the match of the round before that each side won.

    In match order, side A before side B, a side takes the first match of the round before that its key won and none has taken. Keys
    do not compete with each other, so the k-th side with a key takes the k-th match that the key won: one join, no loop.
    """
    level = F.dense_rank().over(W.partitionBy(*DRAW).orderBy("round_order"))
    ranked = rows.withColumn("_level", level)
    side = lambda n, c: F.struct(F.lit(n).alias("n"), F.col(c).alias("key"))
    asks = ranked.select(*DRAW, "match_id", "_level", F.explode(F.array(side(1, "side_a_key"), side(2, "side_b_key"))).alias("s")).select(*DRAW, "match_id", "_level", "s.n", "s.key").where("key <> ''")
    asks = asks.withColumn("_k", F.row_number().over(W.partitionBy(*DRAW, "_level", "key").orderBy("match_id", "n")))
    wins = ranked.select(*DRAW, (F.col("_level") + 1).alias("_level"), side_of(F.col("winner_side"), "won").alias("key"), F.col("match_id").alias("feeder")).where(F.col("key").isNotNull())
    wins = wins.withColumn("_k", F.row_number().over(W.partitionBy(*DRAW, "_level", "key").orderBy("feeder")))
    found = asks.join(wins, [*DRAW, "_level", "key", "_k"]).groupBy("match_id").agg(F.max(F.when(F.col("n") == 1, F.col("feeder"))).alias("side_a_previous"), F.max(F.when(F.col("n") == 2, F.col("feeder"))).alias("side_b_previous"))
    return rows.join(found, "match_id", "left")


def _levels(rows: DataFrame, keys: list[str], order: Column, tag: str) -> tuple[DataFrame, int]:
    """The rows with ``_depth``, their round counted from the last one (0) of their draw, stored; and the number of rounds."""
    deep = stored(rows.withColumn("_depth", F.dense_rank().over(W.partitionBy(*keys).orderBy(order)) - 1), tag)
    last = deep.agg(F.max("_depth")).first()[0]
    return deep, 0 if last is None else last + 1


def bracket_positions(linked: DataFrame) -> DataFrame:
    """Add bracket_position: rounds are numbered from the last one down, and a feeder of place p, side s moves to 2(p - 1) + s.

    Matches that feed none stand behind the placed ones in match order. All draws go down together, one stored step for each round.
    """
    slim = linked.select(*DRAW, "match_id", "round_order", "side_a_previous", "side_b_previous")
    deep, rounds = _levels(slim, DRAW, F.desc("round_order"), "levels")
    spots = linked.sparkSession.createDataFrame([], "match_id long, _spot long")
    placed = []
    for depth in range(rounds):
        place = F.row_number().over(W.partitionBy(*DRAW).orderBy(F.asc_nulls_last("_spot"), "match_id"))
        level = stored(deep.where(F.col("_depth") == depth).join(spots, "match_id", "left").withColumn("_n", place), "places")
        side = lambda n, c: F.struct(F.col(c).alias("match_id"), ((F.col("_n") - 1) * 2 + n).cast("long").alias("_spot"))
        spots = level.select(F.explode(F.array(side(1, "side_a_previous"), side(2, "side_b_previous"))).alias("f")).select("f.*").where("match_id is not null")
        placed.append(level)
    if not placed:
        return linked.withColumn("bracket_position", F.lit(None).cast("int"))
    rows = reduce(DataFrame.union, placed)
    draws = rows.groupBy(*DRAW).agg(F.max("_depth").alias("_first"), F.coalesce(F.max("_spot"), F.lit(0)).alias("_top"))
    lowest = F.coalesce("_spot", F.col("_top") + F.col("_n"))
    at = F.when(F.col("_depth") == F.col("_first"), lowest).otherwise(F.col("_n")).cast("int")
    places = stored(rows.join(draws, DRAW).select("match_id", at.alias("bracket_position")), "positions")
    discard(deep, *placed)
    return linked.join(places, "match_id")


def display_order(ties: DataFrame) -> DataFrame:
    """Add display_order to team ties (draw, level, seq, tie_id, team_a, team_b, winner): each round in the order of its feeders.

    From the last round down, the ties that a next tie's teams won come in that tie's order, side a first; of several ties that a team
    won its k-th ask takes the k-th by appearances of both teams in the rounds before, then by ``seq``. The others follow as they were.
    All draws go down together, one stored step for each round; ``seq`` is unique within a draw and level.
    """
    deep, rounds = _levels(ties, ["draw"], F.desc("level"), "ties")
    seen = deep.select("draw", "_depth", F.explode(F.array("team_a", "team_b")).alias("team")).where("team is not null").groupBy("draw", "team", "_depth").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("draw", "team").orderBy(F.desc("_depth")).rowsBetween(W.unboundedPreceding, -1))
    history = seen.select("draw", "_depth", "team", F.coalesce(before, F.lit(0)).alias("h"))
    of = lambda c: history.select("draw", "_depth", F.col("team").alias(c), F.col("h").alias(f"_{c}"))
    weight = F.coalesce("_team_a", F.lit(0)) + F.coalesce("_team_b", F.lit(0))
    weighed = stored(deep.join(of("team_a"), ["draw", "_depth", "team_a"], "left").join(of("team_b"), ["draw", "_depth", "team_b"], "left").withColumn("_weight", weight).drop("_team_a", "_team_b"), "weighed")
    kth = F.row_number().over(W.partitionBy("draw", "winner").orderBy(F.desc("_weight"), "seq"))
    asked, placed = None, []
    for depth in range(rounds):
        level = weighed.where(F.col("_depth") == depth).withColumn("_k", kth)
        level = level.withColumn("_ask", F.lit(None).cast("long")) if asked is None else level.join(asked, ["draw", "winner", "_k"], "left")
        order = F.row_number().over(W.partitionBy("draw").orderBy(F.asc_nulls_last("_ask"), "seq"))
        level = stored(level.withColumn("display_order", order).select(*ties.columns, "display_order"), "order")
        side = lambda n, c: F.struct(F.col(c).alias("winner"), (F.col("display_order") * 2 + n).cast("long").alias("_ask"))
        asks = level.select("draw", F.explode(F.array(side(0, "team_a"), side(1, "team_b"))).alias("s")).select("draw", "s.*").where("winner is not null")
        asked = asks.withColumn("_k", F.row_number().over(W.partitionBy("draw", "winner").orderBy("_ask")))
        placed.append(level)
    discard(deep, weighed)
    return reduce(DataFrame.union, placed) if placed else ties.withColumn("display_order", F.lit(None).cast("int"))


def virtual_byes(sides: DataFrame, counts: list[str]) -> DataFrame:
    """Bye rows for the rounds that lack matches.

    ``sides`` has (counts..., level, match_id, side_no, previous_unit, unit_code, n_players): one row for each side. A side of the next
    round without a match before it gets a bye, but only where all sides together then fill exactly two slots a match. The unit of
    each bye names its draw, level, next match and side; its id is the negative of ten times the next match plus the side.
    """
    matches = sides.select(*counts, "level", "match_id", "unit_code").distinct()
    size = matches.groupBy(*counts, "level").agg(F.count(F.lit(1)).alias("_n"))
    before = size.select(*counts, (F.col("level") + 1).alias("level"), F.col("_n").alias("_before"))
    units = matches.select(*counts, (F.col("level") + 1).alias("level"), F.col("unit_code").alias("previous_unit"), F.lit(True).alias("_fed"))
    rows = sides.join(units, [*counts, "level", "previous_unit"], "left").join(size, [*counts, "level"]).join(before, [*counts, "level"])
    rows = rows.where(F.col("_before") < 2 * F.col("_n")).withColumn("_slot", F.col("_fed").isNotNull() | (F.col("n_players") > 0))
    full = rows.groupBy(*counts, "level").agg(F.count_if("_slot").alias("_slots"), F.max("_n").alias("_m")).where(F.col("_slots") == 2 * F.col("_m")).select(*counts, "level")
    byes = rows.where(F.col("_fed").isNull()).join(full, [*counts, "level"], "left_semi")
    unit = F.concat_ws(":", F.lit("virtual-bye"), *[F.col(c).cast("string") for c in counts], (F.col("level") - 1).cast("string"), F.col("match_id").cast("string"), F.col("side_no").cast("string"))
    return byes.select(*counts, (F.col("level") - 1).alias("level"), (-(F.col("match_id") * 10 + F.col("side_no"))).alias("match_id"), unit.alias("unit_code"), F.col("match_id").alias("next_match_id"), F.col("side_no").alias("next_side_no"))


def modal_round(rubbers: DataFrame, keys: list[str]) -> DataFrame:
    """Draw round of a tie: that of most of its rubbers, the later round on a tie."""
    votes = rubbers.groupBy(*keys, "draw_round", "round_order").agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(*keys).agg(F.max_by(F.struct("draw_round", "round_order"), F.struct("_n", "round_order")).alias("_r")).select(*keys, "_r.*")


def resolved_rounds(ties: DataFrame, rubbers: DataFrame) -> DataFrame:
    """Add code, label and round_order to team ties (tie_id, stage, stage_zh, round, round_zh): null where neither source tells.

    The draw round of most of a tie's rubbers (tie_id, draw_round, round_order) counts first; else the tie's own round, in a knockout stage
    and if it is a known one, under the stage's code and label.
    """
    modal = modal_round(rubbers, ["tie_id"]).select("tie_id", F.col("draw_round").alias("_draw"), F.col("round_order").alias("_order"))
    parts = {"_drawn": team_round(F.col("_draw"), F.lit(None).cast("string")), "_own": team_round(F.col("round"), F.col("round_zh")), "_stage": stage_prefix(F.col("stage"), F.col("stage_zh"))}
    rows = ties.join(modal, "tie_id", "left").withColumns(parts)
    by_draw, placed = F.col("_draw").isNotNull(), F.col("_stage").isNotNull() & (F.coalesce("_own.order", F.lit(0)) > 0)
    found = {
        "code": F.when(by_draw, F.col("_drawn.code")).when(placed, F.concat_ws(":", "_stage.code", "_own.code")),
        "label": F.when(by_draw, F.col("_drawn.label")).when(placed, F.concat_ws(" ", F.nullif("_stage.label", F.lit("")), "_own.label")),
        "round_order": F.when(by_draw, F.coalesce(F.nullif("_order", F.lit(0)), "_drawn.order")).when(placed, F.col("_own.order") + F.col("_stage.shift")),
    }
    return rows.withColumns(found).drop("_draw", "_order", *parts)


def draw_report(rows: DataFrame) -> DataFrame:
    """Counts of bronze rows by how they were found."""
    return rows.where("draw_round = 'Bronze'").groupBy(F.coalesce("bronze_source", F.lit("(none)")).alias("bronze_source")).agg(F.count(F.lit(1)).alias("n"))


ROUNDS = sorted(DRAW_ORDER, key=DRAW_ORDER.get)


def disjoint_runs(finals: DataFrame) -> DataFrame:
    """Add tie_group to team finals (draw keys, match_id, countries): a match whose countries are none of those seen so far in its
    group opens the next group.

    Windows find, for each match, the last one before it that shares a country. A match opens a group if that one lies before the
    group's first, which depends on the group: a fold over one number for each of a discipline's finals. Null countries share nothing.
    """
    at = F.row_number().over(W.partitionBy(*DRAW).orderBy("match_id"))
    rows = finals.withColumn("_at", at)
    each = rows.select(*DRAW, "_at", F.explode(F.array_distinct(F.coalesce("countries", F.array().cast(dict(finals.dtypes)["countries"])))).alias("c")).where("c is not null")
    shared = each.withColumn("p", F.lag("_at").over(W.partitionBy(*DRAW, "c").orderBy("_at"))).groupBy(*DRAW, "_at").agg(F.max("p").alias("_p"))
    listed = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_p", F.lit(0)).alias("p"))))
    start = F.struct(F.lit(1).alias("first"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        opens = (x["_at"] > 1) & (x["p"] < s["first"])
        g = s["g"] + opens.cast("int")
        return F.struct(F.when(opens, x["_at"]).otherwise(s["first"]).alias("first"), g.alias("g"), F.concat(s["out"], F.array(g)).alias("out"))

    folded = rows.join(shared, [*DRAW, "_at"], "left").groupBy(*DRAW).agg(F.aggregate(listed, start, step, lambda s: s["out"]).alias("_out"))
    return rows.join(folded, DRAW).withColumn("tie_group", F.element_at("_out", F.col("_at"))).select(*finals.columns, "tie_group")


def lanes(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Add lane: spans of a key in order of start (then end) take the first lane that is free, one whose last span ended before.

    A running maximum of the ends cuts a key's spans where none is active, and every stretch begins in lane 0 again, so the fold that
    holds the lanes' ends sees one stretch of overlapping spans. Spans without a start or an end are left out.
    """
    columns = [c for c in spans.columns if c in (key, start, end)]
    kind = dict(spans.dtypes)[end]
    rows = spans.select(*columns).where(F.col(start).isNotNull() & F.col(end).isNotNull())
    w = W.partitionBy(key).orderBy(start, end)
    until = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = rows.withColumn("_new", F.when(until >= F.col(start), 0).otherwise(1)).withColumn("_part", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    listed = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"))))
    begin = F.struct(F.array().cast(f"array<{kind}>").alias("busy"), F.array().cast("array<int>").alias("out"))

    def take(a: Column, x: Column) -> Column:
        free = F.array_position(F.transform(a["busy"], lambda u: u < x["s"]), F.lit(True)).cast("int")
        lane = F.when(free > 0, free - 1).otherwise(F.size(a["busy"]))
        busy = F.when(free > 0, F.transform(a["busy"], lambda u, i: F.when(i == lane, x["e"]).otherwise(u))).otherwise(F.concat(a["busy"], F.array(x["e"])))
        return F.struct(busy.alias("busy"), F.concat(a["out"], F.array(lane)).alias("out"))

    folded = cut.groupBy(key, "_part").agg(listed.alias("_spans"), F.aggregate(listed, begin, take, lambda a: a["out"]).alias("_lanes"))
    each = folded.select(key, F.explode(F.arrays_zip("_spans", "_lanes")).alias("x"))
    return each.select(key, F.col("x._spans.s").alias(start), F.col("x._spans.e").alias(end), F.col("x._lanes").alias("lane")).select(*columns, "lane")


def rolled_dates(days: DataFrame, key: str, seq: str, base_year: str) -> DataFrame:
    """Add local_date to rows with month and day: a date before the previous row's falls in the year after the base year.

    The base year is one for each key and never moves, and no later date of that year can come before one of the next, so all rows
    from the first step back on are in the next year: a running maximum over the key's sessions in order of ``seq``.
    """
    w = W.partitionBy(key).orderBy(seq)
    here = F.make_date(F.col(base_year), F.col("month"), F.col("day"))
    back = F.coalesce(F.col("_here") < F.lag("_here").over(w), F.lit(False)).cast("int")
    rows = days.withColumn("_here", here).withColumn("_back", back).withColumn("_rolled", F.max("_back").over(w.rowsBetween(W.unboundedPreceding, 0)))
    date = F.when(F.col("_rolled") == 1, F.make_date(F.col(base_year) + 1, F.col("month"), F.col("day"))).otherwise(F.col("_here"))
    return rows.withColumn("local_date", date).select(*days.columns, "local_date")
