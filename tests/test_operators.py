from datetime import date

from pyspark.sql import functions as F

from rallyspark.operators import bracket, champions, identity, merge, quality, relational, schedule, stats, views
from tests.helpers import plain, rows

M = "match_id long, event_id long, category_code string, sub_event_type_code string, stage string, round string, side_a_key string, side_b_key string, winner_side string"
DRAW = [
    (1, 1, "ITTF", "MS", "Main Draw", "QuarterFinal", "a", "b", "A"), (2, 1, "ITTF", "MS", "Main Draw", "QuarterFinal", "c", "d", "B"), (3, 1, "ITTF", "MS", "Main Draw", "QuarterFinal", "e", "f", "A"), (4, 1, "ITTF", "MS", "Main Draw", "QuarterFinal", "g", "h", "A"),
    (5, 1, "ITTF", "MS", "Main Draw", "SemiFinal", "e", "a", "A"), (6, 1, "ITTF", "MS", "Main Draw", "SemiFinal", "d", "g", "B"),
    (7, 1, "ITTF", "MS", "Main Draw", "Final", "a", "d", "A"), (8, 1, "ITTF", "MS", "Main Draw", "Final", "g", "e", "B"), (9, 1, "ITTF", "MS", "Qualification", "Final", "x", "y", "A"),
    (10, 2, "WTT_X", "MS", "Main Draw", "SemiFinal", "a", "b", "A"), (11, 2, "WTT_X", "MS", "Main Draw", "SemiFinal", "c", "d", "A"), (12, 2, "WTT_X", "MS", "Main Draw", "Final", "b", "d", "A"), (13, 2, "WTT_X", "MS", "Main Draw", "Final", "a", "c", "B"),
    (14, 3, "ITTF", "MS", "Main Draw", "SemiFinal", "a", "b", "A"), (15, 3, "ITTF", "MS", "Main Draw", "SemiFinal", "c", "d", "A"), (16, 3, "ITTF", "MS", "Position Draw", "2", "d", "b", "A"), (17, 3, None, "MS", "Main Draw", "Final", "a", "c", None),
]


def test_bronze_and_links(spark):
    draw = bracket.draw_rows(spark.createDataFrame(DRAW, M))
    got = {r.match_id: (r.draw_round, r.bronze_source, r.bronze_verified) for r in draw.collect()}
    assert got[7] == ("Bronze", "final_reclassified", True) and got[8] == ("Final", None, False) and 9 not in got
    assert got[12][0] == got[13][0] == "Final"  # tour events keep both finals
    assert got[16] == ("Bronze", "position_draw_round2", True)
    linked = bracket.feeder_links(draw)
    links = {r.match_id: (r.side_a_previous, r.side_b_previous) for r in linked.collect()}
    assert links[5] == (3, 1) and links[6] == (2, 4) and links[7] == (None, None) and links[13] == (10, 11)
    feeders = [f for pair in links.values() for f in pair if f]
    assert len(feeders) == len(set(feeders))  # each feeder once
    at = {r.match_id: r.bracket_position for r in bracket.bracket_positions(linked).collect()}
    assert [at[m] for m in (3, 1, 2, 4)] == [1, 2, 3, 4] and at[5] == 1 and at[6] == 2
    assert rows(bracket.draw_report(draw)) == {("final_reclassified", 1), ("position_draw_round2", 1)}


def test_equal_winner_keys_are_used_once(spark):
    r = [(1, 1, "X", "MS", "Main Draw", "SemiFinal", "a", "b", "A"), (2, 1, "X", "MS", "Main Draw", "SemiFinal", "c", "a", "B"), (3, 1, "X", "MS", "Main Draw", "Final", "a", "a", "A")]
    linked = bracket.feeder_links(bracket.draw_rows(spark.createDataFrame(r, M)))
    assert rows(linked.where("match_id = 3"), "side_a_previous", "side_b_previous") == {(1, 2)}


def test_display_order_and_byes(spark):
    ties = [("d", 1, 1, "q1", "A", "B", "A"), ("d", 1, 2, "q2", "C", "D", "D"), ("d", 1, 3, "q3", "E", "F", None), ("d", 2, 1, "s1", "D", "A", "A")]
    df = spark.createDataFrame(ties, "draw string, level int, seq int, tie_id string, team_a string, team_b string, winner string")
    assert rows(bracket.display_order(df), "tie_id", "display_order") == {("q2", 1), ("q1", 2), ("q3", 3), ("s1", 1)}
    sides = [("d", 1, 1, 1, None, "u1", 1), ("d", 1, 1, 2, None, "u1", 1), ("d", 2, 5, 1, "u1", "u5", 1), ("d", 2, 5, 2, None, "u5", 1), ("e", 1, 7, 1, None, "v1", 1), ("e", 2, 8, 1, None, "v2", 0), ("e", 2, 8, 2, "v1", "v2", 1)]
    df = spark.createDataFrame(sides, "draw string, level int, match_id long, side_no int, previous_unit string, unit_code string, n_players int")
    assert rows(bracket.virtual_byes(df, ["draw"]), "draw", "level", "match_id", "next_match_id") == {("d", 1, -52, 5)}


def test_sequential_folds(spark):
    finals = spark.createDataFrame([(1, "MT", 1, ["A", "B"]), (1, "MT", 2, ["B"]), (1, "MT", 3, ["C", "D"]), (1, "MT", 4, ["A", "C"]), (2, "MT", 5, ["A"])], "event_id long, sub_event_type_code string, match_id long, countries array<string>")
    assert rows(bracket.disjoint_runs(finals), "match_id", "tie_group") == {(1, 0), (2, 0), (3, 1), (4, 1), (5, 0)}
    spans = spark.createDataFrame([("w", 1, 3), ("w", 2, 5), ("w", 4, 6), ("w", 6, 7)], "week string, s int, e int")
    assert rows(bracket.lanes(spans, "week", "s", "e"), "s", "lane") == {(1, 0), (2, 1), (4, 0), (6, 1)}
    days = spark.createDataFrame([(1, 1, 2024, 12, 30), (1, 2, 2024, 1, 2), (1, 3, 2024, 1, 3)], "event_id long, seq int, year int, month int, day int")
    assert [r[0] for r in bracket.rolled_dates(days, "event_id", "seq", "year").orderBy("seq").select("local_date").collect()] == [date(2024, 12, 30), date(2025, 1, 2), date(2025, 1, 3)]


P = "array<struct<name:string,country:string,player_id:long>>"
R = f"match_id long, event_id long, sub_event_type_code string, draw_round string, winner_side string, winner_name string, match_score string, side_a {P}, side_b {P}"


def player(n, c="CHN", i=None):
    return [(n, c, i)]


def test_champions(spark):
    data = [
        (1, 1, "WS", "QuarterFinal", "A", None, None, player("a"), player("x")), (2, 1, "WS", "QuarterFinal", "A", None, None, player("b"), player("y")), (3, 1, "WS", "SemiFinal", "A", None, None, player("a"), player("b")),
        (4, 1, "WS", "QuarterFinal", "A", None, None, player("c"), player("z")), (5, 1, "WS", "QuarterFinal", "B", None, None, player("w"), player("d", "JPN", 4)), (6, 1, "WS", "SemiFinal", None, "d won", None, player("c"), player("d", "JPN", 4)),
        (7, 1, "WS", "Final", "A", None, None, player("b"), player("c")), (8, 1, "WS", "Final", "B", None, None, player("a"), player("d", "JPN", 4)),
        (9, 2, "MD", "Final", "A", None, None, [("p", "SWE", 1), ("q", "GER", 2)], [("r", "KOR", 3)]), (10, 3, "WS", "Final", None, None, None, player("m"), player("n")),
        (11, 4, "MT", "Final", "A", None, "3-0", player("a1"), player("j1", "JPN")), (12, 4, "MT", "Final", "B", None, "0-3", player("a2"), player("j2", "JPN")), (13, 4, "MT", "Final", "A", None, "3-1", player("a1"), player("j3", "JPN")),
        (14, 5, "MT", "Final", "A", None, "3-0", player("a1"), player("j1", "JPN")), (15, 5, "MT", "Final", "B", None, "0-3", player("a2"), player("j2", "JPN")),
        (16, 6, "XT", "Final", "B", None, "0-3", player("k", "KOR"), player("a3")),
    ]
    df = spark.createDataFrame(data, R)
    forced = spark.createDataFrame([(6, "XT", "KOR")], "event_id long, sub_event_type_code string, champion string")
    got = {r.event_id: r for r in champions.champions(df, forced).collect()}
    assert (got[1].champion_name, got[1].champion_player_ids, got[1].champion_country_code, got[1].fallback) == ("d", "4", "JPN", False)
    assert (got[2].champion_name, got[2].champion_country_code, got[2].issue) == ("p,q", "GER,SWE", None)
    assert got[3].issue == "unresolved_winner_side" and got[5].issue == "champion_tie"
    assert (got[4].champion_name, got[4].champion_country_code) == ("a1,a2", "CHN")
    assert (got[6].champion_name, got[6].champion_country_code) == ("k", "KOR")
    assert rows(champions.problem_ledger(champions.champions(df))) == {(3, "WS", "unresolved_winner_side"), (5, "MT", "champion_tie")}


def test_country_change_merge(spark):
    side = "array<struct<side_no:int,team_code:string,players:array<struct<name:string,country:string>>>>"
    schema = f"tie_id long, sub_event_type_code string, stage_code string, round_code string, group_code string, scheduled_local_at string, match_score string, winner_side string, sides {side}"
    tie = lambda i, a, b, score, pa, r="R1": (i, "MT", "S", r, None, None, score, "A", [(1, a, [pa]), (2, b, [("Opp", b)])])
    data = [tie(1, "MAC", "JPN", "2-1", ("Chan", "MAC")), tie(2, "CHN", "JPN", "0-2", ("Chan", "CHN")), tie(3, "KOR", "JPN", "3-0", ("Kim", "KOR"), "R2"), tie(4, "KOR", "JPN", "3-0", ("Kim", "KOR"), "R2")]
    history = spark.createDataFrame([("Chan", "CHN", "MAC")], "player_name string, current_country string, historical_country string")
    got = rows(champions.merge_country_changes(spark.createDataFrame(data, schema), history), "tie_id", "match_score", "winner_side", "merged")
    assert got == {(1, "2-3", "B", 2), (3, "3-0", "A", 1), (4, "3-0", "A", 1)}


def test_player_stats_and_best_results(spark):
    schema = "match_id long, event_id long, stage string, round string, winner_side string, sub_event_type_code string, sort_order int, category_id string, player_id long, player_country string, side_no int, opponent_country string, champion_country_code string, champion_player_ids string"
    data = [
        (1, 1, "Main Draw", "Final", "A", "WS", 3, "WTT", 7, "CHN", 1, "JPN", None, None), (2, 1, "Main Draw", "R16", "B", "WS", 3, "WTT", 7, "CHN", 1, "CHN", None, None),
        (3, 2, "Main Draw", "Final", "B", "WD", 8, None, 7, "CHN", 1, "CHN", None, None), (3, 2, "Main Draw", "Final", "B", "WD", 8, None, 7, "CHN", 1, "JPN", None, None), (4, 3, "Main Draw", "Final", "A", "WS", 1, "youth_x", 7, "CHN", 1, "JPN", None, None),
        (5, 4, "Group", "R1", None, "WT", 5, "WTT", 7, "CHN", 2, None, "JPN", "3,7"), (6, None, None, None, None, None, None, None, None, None, 1, None, None, None),
    ]
    r = stats.player_stats(spark.createDataFrame(data, schema)).first()
    assert (r.foreign_matches, r.foreign_wins, r.domestic_matches, r.domestic_wins, r.events_total) == (2, 1, 1, 0, 3)
    assert (r.seven_events, r.seven_finals, r.all_seven_titles, r.all_three_titles, r.event_seven_titles, r.single_three_titles) == (3, 3, 2, 2, 1, 1)
    fold = [(1, 1, "WS", 1, "R16", False), (1, 1, "WS", 2, "QuarterFinal", True), (1, 1, "WS", 3, "Final", False), (1, 2, "WS", 1, "Final", True), (1, 2, "WS", 2, "R16", True)]
    best = stats.best_results(spark.createDataFrame(fold, "player_id long, event_id long, sub_event_type_code string, seq long, round string, is_champion boolean"))
    assert rows(best, "event_id", "result") == {(1, "Final"), (2, "冠军")}  # a heavier row without a title replaces a title


def test_standings_and_podium(spark):
    ties = spark.createDataFrame([("G", "A", "B", "3-1", None), ("G", "B", "C", "3-0", None), ("G", "C", "A", "3-2", None), ("G", "A", "D", None, None)], "group_code string, team_a string, team_b string, match_score string, winner_side string")
    teams = spark.createDataFrame([("G", t) for t in "ABCD"], "group_code string, team_code string")
    got = [(r.team_code, r.rank, r.played, r.points) for r in stats.standings(teams, ties).orderBy("rank").collect()]
    assert got == [("A", 1, 2, 1), ("B", 2, 2, 1), ("C", 3, 2, 1), ("D", 4, 0, 0)]
    k = "event_id int, draw_round string, team_a string, team_b string, winner_side string"
    open_bronze = spark.createDataFrame([(1, "Final", "A", "B", "A"), (1, "SemiFinal", "A", "C", "A"), (1, "SemiFinal", "D", "B", "B"), (1, "Bronze", "C", "D", None)], k)
    assert rows(stats.podium(open_bronze, ["event_id"]), "place", "team_code") == {(1, "A"), (2, "B"), (3, "C"), (3, "D")}
    assert rows(stats.podium(open_bronze, ["event_id"], live=True), "place", "team_code") == {(1, "A"), (2, "B")}


def test_identity(spark):
    players = spark.createDataFrame([(1, "MA Long", "CHN"), (2, "LI Wei", "CHN"), (3, "LI Wei", "CHN"), (4, "CHAN Kin", "CHN")], "player_id long, name string, country_code string")
    history = spark.createDataFrame([("CHAN Kin", "CHN", "MAC"), ("LI Wei", "CHN", "SGP")], "player_name string, current_country string, historical_country string")
    index, groups = identity.player_index(players, history), identity.same_name_groups(players, history)
    assert rows(groups, "key", "country", "player_ids") == {("li wei", "CHN", (2, 3)), ("li wei", "SGP", (2, 3))}
    asks = spark.createDataFrame([("Long MA", "chn", "c1"), ("CHAN Kin", "MAC", "c1"), ("LI Wei", "CHN", "c1"), ("LI Wei", "CHN", "c2"), ("LI Wei", "SGP", "c3"), ("NO One", "CHN", "c1")], "name string, country string, context string")
    proof = spark.createDataFrame([(2, "c1"), (2, "c2"), (3, "c2")], "player_id long, context string")
    got = rows(identity.resolve_players(asks, index, groups, proof), "name", "context", "player_id", "status")
    assert got == {("Long MA", "c1", 1, "matched"), ("CHAN Kin", "c1", 4, "matched"), ("LI Wei", "c1", 2, "matched"), ("LI Wei", "c2", None, "same_name_ambiguous"), ("LI Wei", "c3", None, "same_name_unresolved"), ("NO One", "c1", None, "unmatched")}
    plain_ = rows(identity.resolve_players(asks, index), "name", "status")
    assert ("LI Wei", "ambiguous") in plain_
    filled = identity.backfill_exact(spark.createDataFrame([("MA Long", "CHN", None), ("LI Wei", "CHN", None), ("x", "CHN", 9)], "name string, country string, player_id long"), players)
    assert rows(filled, "name", "player_id") == {("MA Long", 1), ("LI Wei", None), ("x", 9)}


def test_ranking_merge(spark):
    w = [(1, "exact name", "CHN", 100), (2, "Loose Name", "CHN", 5), (3, "Nick Alias", "GER", 7), (4, "Maria Silva", "BRA", 9), (5, "Twin Name", "KOR", 1), (6, "nobody here", "FRA", 1), (7, "exact name", "CHN", 100)]
    r = [(1, "EXACT Name (1999)", "CHN", 100, "i1"), (2, "loose name", "CHN", 6, "i2"), (9, "Completely Other", "GER", 7, "i3"), (4, "Maria Clara Silva", "BRA", 8, "i4"), (3, "Twin Name", "KOR", 1, "i5"), (7, "Twin Name", "KOR", 1, "i6")]
    c = "category string, seq long, rank long, name string, country_code string, points long"
    weekly = spark.createDataFrame([("WS", i, i, n, cc, p) for i, n, cc, p in w], c)
    results = spark.createDataFrame([("WS", i, k, n, cc, p, d) for i, (k, n, cc, p, d) in enumerate(r)], c + ", player_id string")
    aliases = spark.createDataFrame([("GER", "nick alias", "completely other", None)], "country_code string, weekly_name string, results_name string, player_id string")
    got = {x.seq: (x.player_id, x.status) for x in identity.merge_ranking_ids(weekly, results, aliases).collect()}
    assert got == {1: ("i1", "matched"), 2: ("i2", "matched"), 3: ("i3", "manual_alias"), 4: ("i4", "partial_name"), 5: (None, "ambiguous"), 6: (None, "unmatched"), 7: (None, "unmatched")}


def test_merges(spark):
    s = "k long, status string, source string, v string"
    old = spark.createDataFrame([(1, "completed", "official", "a"), (2, "live", "live", "b"), (None, "live", "live", "n")], s)
    new = spark.createDataFrame([(1, "live", "live", "late"), (2, "scheduled", "live", None), (3, "live", "live", "c"), (None, "live", "live", "m")], s)
    got = rows(merge.upsert(old, new, "k", merge.patch(["v"]) | merge.monotone_status(), merge.not_final()))
    assert got == {(1, "completed", "official", "a"), (2, "live", "live", "b"), (3, "live", "live", "c"), (None, "live", "live", "m")}
    again = merge.upsert(merge.upsert(old, new, "k"), new, "k")
    assert rows(again) == rows(merge.upsert(old, new, "k"))  # idempotent
    assert rows(merge.insert_or_ignore(old, new, "k", "v"), "k", "v") == {(1, "a"), (2, "b"), (3, "c"), (None, "n")}
    assert rows(merge.replace_scope(old, new.where("k = 2"), "k"), "k", "v") == {(1, "a"), (2, None), (None, "n")}
    best = spark.createDataFrame([("x", 1, 1, "t1", 1), ("x", 2, 1, "t0", 2), ("x", 2, 1, "t0", 3), ("", 0, 0, None, 4), (None, 0, 0, None, 5)], "code string, p int, c int, t string, seq long")
    assert rows(merge.best_record(best, "code", F.col("p"), F.col("c"), F.col("t"), "seq"), "seq") == {(2,), (4,), (5,)}
    feeds = spark.createDataFrame([("c", "", "1", "static")], "code string, a string, b string, source string"), spark.createDataFrame([("c", "x", "2", "api"), ("d", "y", None, "api")], "code string, a string, b string, source string")
    assert {(r.code, r.a, r.b, tuple(r.sources)) for r in merge.fill_from(*feeds, "code", ["a", "b"]).collect()} == {("c", "x", "1", ("api", "static")), ("d", "y", None, ("api",))}
    prov = spark.createDataFrame([("R1", "t1", None), ("LIVE::1", "t1", "3-0"), ("LIVE::2", "t2", "1-0")], "code string, tie string, score string")
    assert rows(merge.reconcile_provisional(prov, "code", ~F.startswith("code", F.lit("LIVE::")), ["tie"], ["score"])) == {("R1", "t1", "3-0"), ("LIVE::2", "t2", "1-0")}
    hist = spark.createDataFrame([(1, "old")], "event_id long, external_code string")
    live = spark.createDataFrame([(1, "m1", "completed", "A", "a", "b"), (1, "m2", "walkover", "A", "a", "b"), (1, "m3", "completed", None, "a", "b"), (2, "m4", "completed", "A", "a", "b")], "event_id long, external_code string, status string, winner_side string, side_a_key string, side_b_key string")
    once = merge.promote(hist, live, 1)
    assert rows(once) == {(1, "old"), (1, "m1")} == rows(merge.promote(once, live, 1)) and rows(merge.promote(once, live, 1, replace=True)) == {(1, "m1")}
    kids = merge.cascade(old, "k", (spark.createDataFrame([(1, "s"), (9, "s")], "k long, x string"), "k"))
    assert rows(kids[0]) == {(1, "s")}


def test_relational_builders(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "x"), ("b", 4, "x"), ("c", 5, None)], "k string, v long, c string")
    assert rows(relational.top_row(df, "k", F.struct("v"))) == rows(relational.first_rows(df, "k", F.desc("v"))) == {("a", 2, "y"), ("b", 4, "x"), ("c", 5, None)}
    assert rows(relational.majority(df, "k", "c")) == {("a", "x"), ("b", "x")}
    assert rows(relational.filter_unless_empty(df, "k", F.col("c") == "y"), "k", "v") == {("a", 2), ("b", 3), ("b", 4), ("c", 5)}
    assert rows(relational.unique_argmax(df.groupBy("k", "c").count(), "k", "c", "count")) == {("a", None), ("b", "x"), ("c", None)}
    near = relational.nearest(spark.createDataFrame([("k", 10.0), ("k", 14.0), ("k", 12.0), ("z", 1.0)], "k string, at double"), spark.createDataFrame([("k", 9.0, "low"), ("k", 15.0, "high")], "k string, p double, name string"), ["k"], "at", "p", "name")
    assert rows(near, "at", "nearest", "ambiguous") == {(10.0, "low", False), (14.0, "high", False), (12.0, None, True), (1.0, None, False)}
    assert relational.clamp(500, 1, 100, 20) == 100 and relational.clamp(None, 1, 100, 20) == 20
    p = relational.page(df, [F.asc("v")], 2, 2).collect()
    assert [(r.v, r.total, r.has_more) for r in p] == [(3, 5, True), (4, 5, True)]


def test_checks(spark):
    df = quality.required(spark.createDataFrame([(1, "a", None), (2, None, "b"), (3, "x", "y")], "id long, name string, c string"), "name", "c")
    assert rows(quality.rejects(df, "id"), "reason", "n") == {("name", 1), ("c", 1)} and quality.all_or_nothing(df).count() == 0 and quality.all_or_nothing(df.where("id = 3")).count() == 1
    ranks = spark.createDataFrame([("WS", i, i, 10 + i, f"u/{10 + i}", 100) for i in range(1, 98)], "category string, seq int, rank int, player_id long, profile_url string, total int")
    c = quality.complete(ranks, "category", "total").first()
    assert (c.rows, c.whole, c.usable) == (97, False, True) and quality.ranking_rows(ranks).where("size(reasons) > 0").count() == 0 and quality.prefix_sound(ranks, "category").first().sound
    raw = spark.createDataFrame([("Ev", 2024, "2024 | Ev | x"), ("Ev", 2024, "2023 | Ev | x"), ("Ev", 2024, "2024 | Other | x")], "event string, year int, raw string")
    assert quality.identity_mismatch(raw, "raw", "event", "year").count() == 2


def test_schedule(spark):
    s = spark.createDataFrame([(1, date(2025, 1, 1), "s1", "2025-01-01 10:00:30", date(2025, 1, 2)), (1, date(2025, 1, 2), "s1", "2025-01-02 10:00:00", date(2025, 1, 2)), (1, date(2025, 1, 2), "s2", "2025-01-02 10:00:00", date(2025, 1, 2))], "event_id long, local_date date, label string, start_at string, main_draw_start date").withColumn("start_at", F.col("start_at").cast("timestamp"))
    runs = schedule.session_runs(s)
    counts = {(r.source, r.label): r["count"] for r in runs.groupBy("source", "label").count().collect()}
    assert counts["live", "s1"] == 72 and counts["brackets", "s1"] == 7 and counts["official_reconcile", "s2"] == 7
    assert schedule.merged_runs(runs).where("source = 'live'").count() == 72
    assert rows(schedule.cron_ranges(runs).where("source = 'live'"), "first_hour", "last_hour", "minutes") == {(10, 15, "0,10,20,30,40,50")}
    assert {r.source for r in schedule.daily_runs(s).collect()} == {"schedule", "standings", "backup", "promote"}
    events = spark.createDataFrame([(1, "New York City", "USA"), (2, "Somewhere", "QAT"), (3, "Somewhere", "USA")], "event_id long, location string, country_code string")
    cities, countries = spark.createDataFrame([("york", "Europe/London"), ("new york", "America/New_York")], "city string, time_zone string"), spark.createDataFrame([("QAT", "Asia/Qatar"), ("USA", "America/New_York"), ("USA", "America/Chicago")], "country_code string, time_zone string")
    assert rows(schedule.infer_zone(events, cities, countries), "event_id", "time_zone", "reason") == {(1, "America/New_York", "city"), (2, "Asia/Qatar", "country"), (3, None, "multi-zone country")}


def test_views(spark):
    matches = spark.createDataFrame([(1, "B")], "match_id long, winner_side string")
    sides = spark.createDataFrame([(1, 2, 12), (1, 1, 11)], "match_id long, side_no int, side_id long")
    players = spark.createDataFrame([(11, 2, 5, "b", "CHN"), (11, 1, 6, "a", "CHN"), (12, 1, None, "z", "JPN")], "side_id long, player_order int, player_id long, player_name string, player_country string")
    r = views.match_view(matches, sides, players).first()
    assert [(s.side_no, s.team_code, [p.player_name for p in s.players], s.is_winner) for s in r.sides] == [(1, "CHN", ["a", "b"], False), (2, "JPN", ["z"], True)]
    snaps = spark.createDataFrame([(1, "women_singles", "2025-01-01"), (2, "women_singles", "2025-02-01"), (3, "men_singles", "2025-03-01")], "snapshot_id long, category string, ranking_date string")
    entries = spark.createDataFrame([(1, 7, 9), (2, 7, 1), (2, 8, 2)], "snapshot_id long, player_id long, rank int")
    people = spark.createDataFrame([(7, "Sun Y", None, "sun-y", "CHN", 10, 9, 6), (8, "Sunny B", None, "sunny-b", "JPN", 0, 0, 2), (9, "Ann Sun", None, "ann", "CHN", 5, 5, 9)], "player_id long, name string, name_zh string, slug string, country_code string, career_matches long, career_wins long, career_events long")
    assert [p.player_id for p in views.rankings(snaps, entries, people, "women_singles", 10).collect()] == [7, 8]
    assert [(p.player_id, p.win_rate) for p in views.rankings(snaps, entries, people, "women_singles", 10, by_rate=True).collect()] == [(7, 90.0)]
    assert [p.player_id for p in views.search_players(people, entries, snaps, "sun y").collect()] == [7]
    assert [p.player_id for p in views.search_players(people, entries, snaps, "Sun").collect()] == [7, 8, 9]
    assert views.search_players(people, entries, snaps.where("category <> 'women_singles'"), "sun").count() == 0
    listed = views.by_position(spark.createDataFrame([([8, 99, 7],)], "ids array<long>"), "ids", people.select("player_id", "name"), "player_id", "players").first()
    assert plain(listed.players) == [(8, "Sunny B"), (7, "Sun Y")]


def test_matching_in_passes_and_groups(spark):
    asks = spark.createDataFrame([("p", 3, "T1", "a|b"), ("q", None, "T2", "c|d"), ("r", 9, "T9", "e|f"), ("s", 1, "T8", "x|y")], "k string, no int, tab string, sides string")
    live = spark.createDataFrame([(10, 3, "T1", "z|z"), (11, 8, "T2", "c|d"), (12, 9, "T7", "e|f"), (13, 9, "T6", "e|f")], "id long, no int, tab string, sides string")
    got = schedule.match_passes(asks, live, [["no", "tab"], ["tab", "sides"], ["no", "sides"]], "k", "id")
    assert rows(got, "k", "id", "step") == {("p", 10, 1), ("q", 11, 2), ("r", 12, 3), ("s", None, None)}
    ties = spark.createDataFrame([("CHN", "JPN"), ("JPN", "KOR"), (None, "KOR")], "team_a string, team_b string")
    teams = spark.createDataFrame([("S1", "G1", "CHN"), ("S1", "G1", "JPN"), ("S1", "G2", "KOR")], "stage string, group_code string, team_code string")
    assert rows(schedule.groups_by_pair(ties, teams), "team_b", "group_code", "issue") == {("JPN", "G1", None), ("KOR", None, "no common group"), ("KOR", None, "side without one country")}


def test_override_views(spark):
    ties = spark.createDataFrame([(1, 10, "S1", "G1", "A", "B", "3-0", "A", "SF", "semi", 60), (1, 11, "S1", "G2", "C", "D", "3-1", "A", "SF", "semi", 60), (1, 12, "S2", "F", "C", "A", "0-3", "B", "F", "final", 80)], "event_id long, tie_id long, stage string, round string, team_a string, team_b string, match_score string, winner_side string, code string, label string, round_order int")
    stages = spark.createDataFrame([(1, 1, "S1", "group_round_robin", "G1", "g1"), (1, 1, "S1", "group_round_robin", "G9", "g9"), (1, 2, "S2", "round_robin", None, None)], "event_id long, position int, stage string, format string, group_code string, group_name string")
    got = {(r.stage, r.group_code): [t.tie_id for t in r.ties] for r in views.staged_view(ties, stages).collect()}
    assert got == {("S1", "G1"): [10], ("S1", "G9"): [], ("S2", None): [12]}
    moved = spark.createDataFrame([(1, 11, "B", "bronze", 70)], "event_id long, tie_id long, code string, label string, round_order int")
    assert [(r.code, [t.tie_id for t in r.ties]) for r in views.knockout_rounds(ties, moved).collect()] == [("SF", [10]), ("B", [11]), ("F", [12])]
    wanted = spark.createDataFrame([(1, "final", "A", "C"), (1, "bronze", "B", "C")], "event_id long, role string, first_code string, second_code string")
    assert rows(views.override_ties(ties, wanted)) == {(1, "final", 12), (1, "bronze", None)}
