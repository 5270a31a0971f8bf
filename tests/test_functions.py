from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rallyspark.functions import dates, payload, rounds, scores, text
from tests.helpers import values


def one(spark, cases, expr):
    assert values(spark, "x string", [(k,) for k in cases], expr) == list(cases.values())


def test_names_and_keys(spark):
    one(spark, {"  WTT  Champions, Doha. presented by ACME Inc": "wtt champions doha", None: "", "A.B": "ab"}, text.normalize_event_name(F.col("x")))
    one(spark, {"MA Long": "long ma", "long  ma ": "long ma", "": "", None: ""}, text.name_key(F.col("x")))
    one(spark, {" Éva Ñandú-2 x!": "va-and-2-x", None: ""}, text.slugify(F.col("x")))
    one(spark, {" Main Draw - Stage 2 ": "main-draw-stage-2", "--": ""}, text.stage_token(F.col("x")))
    one(spark, {"AB C--": "ABC", None: "", "-": ""}, text.match_code(F.col("x")))
    one(spark, {"LIN Gaoyuan (2001)": ["lin gaoyuan (2001)", "lin gaoyuan"], "A B": ["a b"], "": [""]}, text.name_variants(F.col("x")))
    one(spark, {"Éşpaña": "Espana", "plain": "plain"}, text.fold_accents(F.col("x")))
    one(spark, {"MA Long (CHN)": ("MA Long", "CHN"), "A (B) (CC)": ("A (B)", "CC"), "no country": ("no country", None), None: ("", None)}, text.player_token(F.col("x")))
    one(spark, {"2024 | Event | A (X) | B (Y) | MS": (["A (X)"], ["B (Y)"]), "A (X) | B (X) | C (Y) | D (Y)": (["A (X)", "B (X)"], ["C (Y)", "D (Y)"]), "A (X) | B (X) | C (Y)": ([], []), None: ([], [])}, text.row_sides(F.col("x")))
    one(spark, {"A / B": ["A", "B"], "A": ["A"], None: []}, text.rubber_names(F.col("x")))
    one(spark, {"Table 3": "T03", "t 12": "T12", "T007": "T07", "court x": "COURT X", " ": None}, text.table_label(F.col("x")))
    one(spark, {"Match 7 | x": 7, "m 12": 12, "none": None, None: None}, text.match_number(F.col("x")))
    one(spark, {"Open Doha 2024": ("Open Doha", 2024), "Open": ("Open", None)}, text.split_event_name(F.col("x")))
    one(spark, {"http://x/?eventId=12": 12, "/tournament/9/x": 9, "": None}, text.event_id_from_href(F.col("x")))
    one(spark, {"2024 | Ev": (2024, "Ev"), "x | Ev": (None, "Ev"), "": (None, None)}, text.raw_identity(F.col("x")))
    one(spark, {"1,,x, 3": [1, 3], "": [], None: []}, text.id_list(F.col("x")))
    one(spark, {" 亚锦赛 ": ["亚锦赛", "亚洲锦标赛", "亚洲团体锦标赛"], "2024 世乒赛": ["2024 世乒赛", "2024 世界乒乓球锦标赛"], "": [], "doha": ["doha"]}, text.expand_query(F.col("x")))
    got = values(spark, "n int, t string", [(3, "2025-04-18T10:00:00"), (3, None), (None, None)], text.session_label(F.col("n"), F.col("t")))
    assert got == ["Match 3 | 18 Apr, 10:00", "Match 3", None]
    assert values(spark, "a string, b string", [("new york city", "york"), ("newyork", "york"), ("x", "")], text.contains_phrase(F.col("a"), F.col("b"))) == [True, False, False]


def test_roster_keys(spark):
    p = "p array<struct<name:string,country:string,player_id:long>>"
    cases = [([("B b", "chn", None), ("A  a", "CHN", 7)],), ([("A", "CHN", 1), ("B", "JPN", None)],), ([],), ([(None, None, None)],)]
    got = values(spark, p, cases, text.side_key(F.col("p")), text.team_key(F.col("p")), text.roster_key(F.col("p")), text.single_country(F.col("p")))
    assert got == [("a  a|chn||b b|chn", "C:CHN", "R:id:7||name:b b|CHN", "CHN"), ("a|chn||b|jpn", "R:a|CHN||b|JPN", "R:id:1||name:b|JPN", None), ("", "R:", "R:", None), ("|", "R:", "R:", None)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abc ", max_size=5), st.text("XY", max_size=3)), max_size=4))
def test_keys_do_not_depend_on_order(spark, players):
    schema = "p array<struct<name:string,country:string>>"
    a, b = values(spark, schema, [(players,), (players[::-1],)], text.side_key(F.col("p")), text.team_key(F.col("p")))
    assert a == b


def test_scores(spark):
    one(spark, {"won 3 - 1 (x)": (3, 1), "": None, None: None, "3:1": None}, scores.tie_score(F.col("x")))
    one(spark, {" 3-1 ": (3, 1), "3-1 WO": None}, scores.match_score(F.col("x")))
    one(spark, {"4-2 (11-9, 8-11)": (4, 2), "x (1-0)": None, "4 - 2": (4, 2)}, scores.bracket_score(F.col("x")))
    one(spark, {"3-1": "1-3", "bye": "bye", None: None}, scores.flip_score(F.col("x")))
    one(spark, {'["11-9","0-0","9:11","x"]': [(11, 9), (9, 11)], '[{"player":11,"opponent":5},{"player":0,"opponent":0}]': [(11, 5)], "11-9, 0-0,8-11": [(11, 9), (8, 11)], None: [], "": [], "[]": []}, scores.games(F.col("x")))
    a = {"3-0": ("3-0", "A"), "3-0 WO": ("3-0 WO", "A"), "0 WO-3": ("0 WO-3", "B"), "2-2 RET": ("2-2 RET", "A"), "1-2 INJ": ("1-2 INJ", "B"), "2-2": ("2-2", None), "odd": ("odd", None), "": None, None: None}
    one(spark, a, scores.forfeit(F.col("x"), F.lit(True)))
    one(spark, {"3-0 WO": ("0 WO-3", "B"), "3-1": ("1-3", "B"), "0 WO-3": ("3-0 WO", "A")}, scores.forfeit(F.col("x"), F.lit(False)))
    assert values(spark, "x string", [("3-3",)], scores.forfeit(F.col("x"), F.lit(True), F.lit("DNS"), F.lit("team1"))) == [("3 DNS-3", "B")]
    one(spark, {"Final": 8, "R128": 2, "other": 1, None: 1}, scores.round_weight(F.col("x")))
    one(spark, {" Official ": "completed", "Canceled": "cancelled", None: "scheduled"}, scores.status_of(F.col("x")))
    names = [(None, "won by Ann", ["Ann"], ["Bob"]), ("b", "Ann", ["Ann"], ["Bob"]), (None, "Ann Bob", ["Ann"], ["Bob"]), (None, None, ["Ann"], ["Bob"])]
    assert values(spark, "e string, w string, a array<string>, b array<string>", names, scores.winner_side(F.col("e"), F.col("w"), F.col("a"), F.col("b"))) == ["A", "B", None, None]
    assert values(spark, "a long, b long", [(1, 4), (1, 0), (None, None)], scores.guarded_ratio(F.col("a"), F.col("b"))) == [25.0, 0.0, 0.0]
    assert values(spark, "s string, w string, x string", [("live", "A", "3-0"), ("completed", None, "1-3"), ("walkover", "a", None)], scores.live_winner(F.col("s"), F.col("w"), F.col("x"))) == [None, "B", "A"]


def test_rounds(spark):
    draws = [(1, "Main Draw", "Final", "Final"), (1, "Main Draw", "round of 16", "R16"), (1, "Main Draw", "Bronze", "Bronze"), (1, "Position Draw", "Final", None), (910, "Main Draw - Stage 2", "4", "SemiFinal"), (911, "Main Draw - Stage 2", "4", None), (910, "Main Draw - Stage 2 (Bronze Match)", "2", "Bronze"), (910, "Main Draw - Stage 2 (5th place)", "2", None), (1, "Main Draw", "Group 1", None)]
    assert values(spark, "e int, s string, r string", [d[:3] for d in draws], rounds.draw_round(F.col("e"), F.col("s"), F.col("r"))) == [d[3] for d in draws]
    one(spark, {"GP03": ("PRELIMINARY", "G3", "GP03"), "GP17": ("UNKNOWN", "UNKNOWN", None), "rnd2": ("PRELIMINARY", "R2", None), "8FNL": ("MAIN_DRAW", "R16", None), "FNL-": ("MAIN_DRAW", "F", None), None: ("UNKNOWN", "UNKNOWN", None)}, rounds.schedule_round(F.col("x")))
    one(spark, {"RND1": ("PRELIMINARY", "R1", 10), "GP4": ("MAIN_STAGE1", "GP4", 104), "zz": (None, "ZZ", None), None: (None, None, None)}, rounds.bracket_round(F.col("x")))
    one(spark, {"Men's Teams - Quarter-final": ("MAIN_DRAW", "QF"), "Semifinal": ("MAIN_DRAW", "SF"), "Final": ("MAIN_DRAW", "F"), "Group 03": ("PRELIMINARY", "G3"), "Qualifying Round 2": ("PRELIMINARY", "R2"), "Preliminary Round": ("PRELIMINARY", "R1"), "x": (None, None)}, rounds.category_round(F.col("x")))
    one(spark, {"Women's Quarterfinal 2": "QFNL", "Final": "FNL", "Round of 64": "R64-", "Group 5": "GP05", "x": None, None: None}, rounds.described_round(F.col("x")))
    one(spark, {"a | r16 | b": "R16", "x QF y": "QF", "Round of 32": "Round of 32", "group b": "group b", "": ""}, rounds.raw_round(F.col("x")))
    one(spark, {"Women's Doubles": "WD", "nothing": None}, rounds.discipline(F.col("x")))
    one(spark, {"SF": "SemiFinal", "R32": "R32", "G4": "Group 4", "zz": "raw"}, rounds.historical_label(F.col("x"), F.lit("raw")))
    one(spark, {"4": ("SemiFinal", "半决赛", 60), "FNL-": ("Final", "决赛", 80), "Placement": ("Placement", "Placement", 0), None: ("unknown", "轮次待补", 0)}, rounds.team_round(F.col("x"), F.lit(None).cast("string")))
    one(spark, {"Main Draw - Division 2": 2, "Position x": 199, "Qualification 第三级别": 203, "other": 399}, rounds.stage_priority(F.col("x"), F.lit(None).cast("string")))
    one(spark, {"MT": (True, True), "JBMT": (True, True), "XT": (True, True), "WS": (False, False), "U15XT": (False, True)}, F.struct(rounds.is_team_discipline(F.col("x")), rounds.is_team_title(F.col("x"))))
    one(spark, {"WTT_X": False, "ITTF": True, None: False}, rounds.non_tour(F.col("x")))
    one(spark, {"Asian Games 2026": "Continental Games", "Asian Para Games": "k"}, rounds.continental_override(F.col("x"), F.lit("k")))


def test_dates(spark):
    y = F.lit(2025)
    ranges = {"Nov": (None, None), "26-27 TBD Mar": ("2025-03-26", "2025-03-27"), "29 Apr – 2 May": ("2025-04-29", "2025-05-02"), "30 Dec - 4 Jan": ("2025-12-30", "2026-01-04"), "01-07至01-11": ("2025-01-07", "2025-01-11"), "12-30至01-02": ("2025-12-30", "2026-01-02"), "5 Sep - 2 Mar": ("2025-09-05", "2025-03-02"), "3 Foo - 4 Bar": (None, None), None: (None, None)}
    one(spark, ranges, dates.date_range(F.col("x"), y))
    one(spark, {"2026-May-5": "2026-05-05", "2026-Foo-25": "2026-01-25", "2026-05-25": "2026-05-25", "soon": "soon", "": None, None: None}, dates.expires_date(F.col("x")))
    one(spark, {"2026-05-25": "2026-05", "x": None, None: None}, dates.ranking_month(F.col("x")))
    one(spark, {"Match 3 | 18 Apr, 9:05": "2025-04-18T09:05:00", "Match 3 | 31 February, 10:00": None, "x": None, None: None}, dates.display_time(F.col("x"), y))
    one(spark, {"12/31/2024 23:59:58": "2024-12-31T23:59:58", "01/02/2024 03:04": "2024-01-02T03:04:00", "x": None}, dates.us_time(F.col("x")))
    one(spark, {"8月8日": (8, 8), "x": (None, None)}, dates.chinese_day(F.col("x")))
    zones = [("2025-03-30T01:30:00", "Europe/London"), ("2025-07-01T12:00:00", "Europe/London"), ("2025-07-01T12:00:00+08:00", None), ("2025-07-01T12:00:00Z", "bad/zone"), ("2025-07-01T12:00:00", "bad/zone"), ("", "UTC"), ("2025-10-26T01:30:00", "Europe/London")]
    got = values(spark, "x string, z string", zones, dates.local_and_utc(F.col("x"), F.col("z")))
    assert got[1] == ("2025-07-01T12:00:00", "2025-07-01T11:00:00+00:00") and got[2] == ("2025-07-01T12:00:00+08:00", "2025-07-01T04:00:00+00:00")
    assert got[3] == ("2025-07-01T12:00:00+00:00", "2025-07-01T12:00:00+00:00") and got[4] == ("2025-07-01T12:00:00", None) and got[5] == (None, None)
    assert got[6][1] == "2025-10-26T00:30:00+00:00" and got[0][1] is not None
    as_of = F.lit("2025-05-01 20:00:00").cast("timestamp")
    span = [("completed", date(2030, 1, 1), None, None), (None, date(2025, 5, 2), date(2025, 5, 3), "Asia/Shanghai"), (None, date(2025, 5, 2), date(2025, 5, 3), "bad"), (None, date(2025, 4, 1), date(2025, 4, 30), "UTC"), (None, None, None, None)]
    assert values(spark, "l string, s date, e date, z string", span, dates.display_status(F.col("l"), F.col("s"), F.col("e"), F.col("z"), as_of)) == ["completed", "in_progress", "upcoming", "finished_pending_promotion", "in_progress"]
    buckets = [(datetime(2025, 5, 1, 20), None, None), (None, datetime(2025, 5, 1, 20), "Europe/London"), (None, None, "UTC"), (None, datetime(2025, 5, 1, 20), "bad")]
    assert values(spark, "u timestamp, l timestamp_ntz, z string", buckets, dates.day_bucket(F.col("u"), F.col("l"), F.col("z"), "Asia/Shanghai")) == ["2025-05-02", "2025-05-02", "TBD", "TBD"]
    assert values(spark, "z string, n string", [(" ", "WTT Doha"), ("X/Y", "Doha"), (None, "nowhere")], dates.zone_guess(F.col("z"), F.col("n"))) == ["Asia/Qatar", "X/Y", None]


def test_payloads(spark):
    unit = '{"Competition":{"Unit":[{"Code":"A"},{"Code":"B"}]}}'
    one(spark, {unit: ["A", "B"], f"[{unit},{unit}]": ["A", "B", "A", "B"], "{}": []}, F.transform(payload.schedule_units(F.col("x")), lambda u: u["Code"]))
    one(spark, {'{"a":{"playerId":"12"},"b":[{"IfId": 7},{"playerId":"12"}]}': [12, 7], None: []}, payload.player_ids(F.col("x")))
    doc = '{"EventId":"5","Competition":{"Bracket":[{"Code":"D","BracketItems":[{"Code":"FNL-","BracketItem":[{"Unit":"U1-","Position":1,"Result":"4-2 (11-9)","CompetitorPlace":[{"Competitor":{"Organization":"CHN"}},{"Wlt":"L","PreviousUnit":{"Unit":"U0"}}]},{"Code":"U2"}]}]}]}}'
    got = payload.bracket_rows(spark.createDataFrame([(doc,)], "payload string")).orderBy("item_pos").collect()
    assert (got[0].event_id, got[0].unit_code, got[0].round.round_code, got[0].winner_side, got[0].status, got[0].side_a.team, got[0].side_b.placeholder) == (5, "U1", "F", "A", "completed", "CHN", "U0")
    assert (got[1].unit_code, got[1].winner_side, got[1].status) == ("U2", None, None)
    assert values(spark, "a string, b string, c string", [(" ", "3-0", "x"), (None, None, " 2-1 ")], payload.official_score(F.col("a"), F.col("b"), F.col("c"))) == ["3-0", "2-1"]


@pytest.mark.parametrize("text_", ["a-b", "x"])
def test_literal_tables_give_defaults(spark, text_):
    assert values(spark, "x string", [(text_,)], scores.lookup(F.col("x"), {"k": 1}, 0)) == [0]


def test_sides_of_payloads(spark):
    places = [([("2", ("X", "JPN", None, ([("9", 1, ("Mima", "ITO", None, None, None, None))],))), ("1", ("Y", " CHN ", ("China",), None))],), ([],)]
    schema = f"p array<{payload.BRACKET_PLACE}>"
    got = values(spark, schema, places, payload.bracket_players(F.col("p"), 1, F.lit("T1"), F.lit(None).cast("string")), payload.bracket_players(F.col("p"), 2, F.lit(None).cast("string"), F.lit("Winner of 3")))
    assert got == [([(None, "China", "CHN")], [(9, "ITO Mima", "JPN")]), ([(None, "T1", "T1")], [(None, "Winner of 3", None)])]
    official = [(("7", " Pair ", "KOR", [("1", " Kim ", None), ("x", "", "JPN")]),), (("7", "Solo", "KOR", None),), (None,)]
    assert values(spark, f"c {payload.OFFICIAL}", official, payload.official_players(F.col("c"))) == [[(1, "Kim", "KOR"), (None, "Pair", "JPN")], [(7, "Solo", "KOR")], []]
    broken = "é".encode().decode("cp936")
    assert values(spark, "x string", [(broken,), ("中国",), ("plain",), (None,)], payload.repaired(F.col("x"))) == ["é", "中国", "plain", None]


def test_live_cards(spark):
    card = '{"documentCode":"M1--","subEventName":"Women\'s Singles","subEventDescription":"Women\'s Singles - Semifinal","overallScores":"4-2","gameScores":"11-9, 8-11","competitiors":[{"competitiorName":"A","competitiorOrg":"CHN","competitiorId":"5"},{"competitiorName":"B"}]}'
    units = spark.createDataFrame([("M1", "WS", None, "T1", "Match 3")], "code string, sub_event string, round string, location string, label string")
    r = payload.live_rows(spark.createDataFrame([(card, "live"), ("{}", "live")], "card string, source_status string"), units).orderBy(F.desc("match_code")).collect()
    assert (r[0].match_code, r[0].sub_event, r[0].round, r[0].table_no, r[0].session_label, r[0].score, r[0].games, r[0].winner_side) == ("M1", "WS", "SFNL", "T1", "Match 3", "4-2", ["11-9", "8-11"], "A")
    assert r[0].sides[0].players[0].player_id == 5 and r[1].sides == [] and r[1].winner_side is None
    pool = spark.createDataFrame([(1, ("G", 1, 3, 2, 1, "5", 7, 3, 20, 9, "Q", ("C1", "CHN", ("China",), ([("9", 1, ("Mima", "ITO", "JPN", "7", None, None))],))))], f"event_id long, row {payload.POOL_ROW}")
    p = payload.pool_rows(pool).first()
    assert (p.group_code, p.team_name, p.rank, p.players[0].name) == ("G", "China", 1, "Mima ITO")
