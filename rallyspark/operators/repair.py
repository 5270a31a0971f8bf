"""Repair of match files from the raw rows they keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyspark.functions.rounds import raw_round
from rallyspark.functions.scores import match_score, winner_of
from rallyspark.functions.text import name_key, nz, player_token, row_players

#: Places of the cells of a raw row.
SIDE_A, SIDE_B, SUB_EVENT, STAGE, ROUND, WINNER = (2, 3), (4, 5), 6, 7, 8, 11


def _bare(players: Column) -> Column:
    return F.transform(players, lambda p: player_token(p)["name"])


def repaired_matches(matches: DataFrame) -> DataFrame:
    """Matches with what their raw rows say, and ``changes``, the names of the columns that differ from what they held.

    matches: player_name (the file's owner), raw_row_text, match_score, all_players_in_row, side_a, side_b (array<string>), sub_event,
    round, perspective, result_for_player, winner and more. An empty sub event keeps the old one; a round that repeats the stage is
    looked for in the whole row; the owner is found by words in any order; equal scores are a loss; the winner's cells go before the
    score. Null lists and texts count as empty, but a null perspective or result differs from every value. One pass, no shuffle.
    """
    cells = F.transform(F.split(nz(F.col("raw_row_text")), r"\|"), lambda x: F.trim(x))
    cell = lambda i: nz(F.get(F.col("_cells"), F.lit(i)))
    rows = matches.withColumn("_cells", cells)
    players = lambda at: row_players(F.concat_ws("|", *[cell(i) for i in at]))
    stage_again = F.lower(cell(ROUND)) == F.lower(cell(STAGE))
    rows = rows.withColumns({
        "_side_a": players(SIDE_A), "_side_b": players(SIDE_B), "_sub_event": F.coalesce(F.nullif(cell(SUB_EVENT), F.lit("")), F.col("sub_event")),
        "_round": F.when((cell(ROUND) == "") | stage_again, raw_round(F.col("raw_row_text"))).otherwise(cell(ROUND)), "_won": winner_of(match_score(F.col("match_score"))),
    })
    owner = lambda side: F.exists(_bare(F.col(side)), lambda n: name_key(n) == name_key(F.col("player_name")))
    rows = rows.withColumn("_perspective", F.when(owner("_side_a"), "side_a").when(owner("_side_b"), "side_b").otherwise("unknown"))
    known = (F.col("_perspective") != "unknown") & match_score(F.col("match_score")).isNotNull()
    wins = F.coalesce(F.col("_won") == F.when(F.col("_perspective") == "side_a", "A").otherwise("B"), F.lit(False))
    named = F.array_join(F.filter(F.slice("_cells", WINNER + 1, F.greatest(F.size("_cells"), F.lit(1))), lambda x: x != ""), " / ")
    scored = F.when(F.col("_won") == "A", F.array_join(_bare(F.col("_side_a")), " / ")).when(F.col("_won") == "B", F.array_join(_bare(F.col("_side_b")), " / ")).otherwise("")
    rows = rows.withColumns({
        "_all_players_in_row": F.concat("_side_a", "_side_b"), "_result_for_player": F.when(known & wins, "win").when(known, "loss").otherwise("unknown"),
        "_winner": F.coalesce(F.nullif(named, F.lit("")), scored),
    })
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    differs = {c: listed(c) != F.col(f"_{c}") for c in ("all_players_in_row", "side_a", "side_b")}
    differs |= {c: nz(F.col(c)) != nz(F.col(f"_{c}")) for c in ("sub_event", "round")}
    differs |= {c: ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("perspective", "result_for_player")}
    differs["winner"] = nz(F.col("winner")) != F.col("_winner")
    changes = F.filter(F.array(*[F.when(d, c) for c, d in differs.items()]), lambda c: c.isNotNull()).alias("changes")
    return rows.select(*[F.col(f"_{c}").alias(c) if c in differs else F.col(c) for c in matches.columns], changes)
