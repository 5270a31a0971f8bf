"""Connected parts, running ties, bracket levels and first layers: random inputs against plain loops, nulls, repeats, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from rallyspark.functions.calendar import classified
from rallyspark.functions.rounds import stage_prefix
from rallyspark.operators import bracket, filters, relational, running
from rallyspark.operators.components import connected
from tests.helpers import rows, values

MESSAGE = "event_id long, sub_event_type_code string, seq long, external_match_code string, team1 string, team2 string, stage_code string, round_code string, table_no string, session_label string, status string, source_status string, score string"


def test_connected_parts_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(260)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [("x", "x"), (None, "y"), ("n1", "n1")]
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert rows(connected(spark.createDataFrame(edges, "a string, b string"))) == {(a, root(a)) for a in up}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def message(seq, code=None, teams=("A", "B"), round_code="UNKNOWN", table=None, session=None, status="live", source="Live", event=1):
    return (event, "MT", seq, code, *teams, "UNKNOWN" if round_code == "UNKNOWN" else "KO", round_code, table, session, status, source, f"{seq}-0")


def test_messages_find_their_tie_and_merge_it(spark):
    feed = [
        message(1, "C1", table="T01", session="Match 4", round_code="R1"), message(2, teams=("B", "A"), session="Late", round_code="R1", table="T01"),  # by table, teams in the other order
        message(3, session="M 4", round_code="R1"), message(4, round_code="R1", session="Other"),  # tie 1 is now called Late, so both open ties of their own
        message(5, table="T09"), message(6, "C2", table="T09"), message(7, table="T09", session="Match 9"),  # found by table in its own round
        message(8, "C1", status="completed", source="official", teams=("A", None)), message(9, "C1"), message(10, teams=(None, None), session="x"), message(11, teams=(None, None), session="x"), message(12, event=2),
    ]
    df = spark.createDataFrame(feed, MESSAGE)
    links = {r.seq: (r.tie, r.removes) for r in running.linked(df.repartition(3)).collect()}
    assert links == {1: (1, None), 2: (1, None), 3: (3, None), 4: (4, None), 5: (5, None), 6: (6, None), 7: (5, None), 8: (1, None), 9: (1, None), 10: (10, None), 11: (10, None), 12: (12, None)}
    states = {r.tie: r for r in running.running_ties(running.linked(df)).collect()}
    assert (states[1].final, states[1].status, states[1].code) == (True, "completed", "C1") and states[10].team1 is None
    assert running.linked(df.where("false")).count() == 0


def test_a_tie_that_stands_twice_goes(spark):
    feed = [message(1, table="T01"), message(2, "C1", table="T01", round_code="R1"), message(3, table="T01", round_code="R1", status="live")]
    links = running.linked(spark.createDataFrame(feed, MESSAGE))
    assert {r.seq: (r.tie, r.removes) for r in links.collect()} == {1: (1, None), 2: (2, None), 3: (2, 1)}
    assert rows(running.running_ties(links), "tie", "synced") == {(2, 3)}


@pytest.mark.parametrize("seed", [1, 2])
def test_lanes_and_runs_of_finals_equal_loops(spark, seed):
    rng = random.Random(seed)
    spans = [(f"w{rng.randrange(3)}", s := rng.randrange(300), s + rng.randrange(40)) for _ in range(200)]
    want = []
    for week in ("w0", "w1", "w2"):
        busy = []
        for _, s, e in sorted((x for x in spans if x[0] == week), key=lambda x: x[1:]):
            free = next((i for i, until in enumerate(busy) if until < s), len(busy))
            busy[free : free + 1] = [e]
            want.append((week, s, e, free))
    got = bracket.lanes(spark.createDataFrame([*spans, ("w0", None, 3)], "week string, s int, e int"), "week", "s", "e")
    assert sorted(map(tuple, got.select("week", "s", "e", "lane").collect())) == sorted(want)
    finals = [(rng.randrange(2), "MT", i, [f"c{rng.randrange(9)}" for _ in range(rng.randrange(4))] or None) for i in range(120)]
    groups = {}
    for event in (0, 1):
        seen, number, first = set(), 0, True
        for _, _, i, countries in (f for f in finals if f[0] == event):
            if not first and seen.isdisjoint(countries or []):
                number, seen = number + 1, set()
            seen |= set(countries or [])
            groups[i], first = number, False
    df = spark.createDataFrame(finals, "event_id int, sub_event_type_code string, match_id long, countries array<string>")
    assert {r.match_id: r.tie_group for r in bracket.disjoint_runs(df).collect()} == groups


def test_empty_brackets_and_first_layers(spark):
    none = spark.createDataFrame([], "event_id long, sub_event_type_code string, match_id long, round_order int, side_a_previous long, side_b_previous long")
    assert bracket.bracket_positions(none).columns[-1] == "bracket_position" and bracket.bracket_positions(none).count() == 0
    ties = spark.createDataFrame([], "draw string, level int, seq long, tie_id string, team_a string, team_b string, winner string")
    assert bracket.display_order(ties).count() == 0
    layer = lambda *r: spark.createDataFrame(r, "k string, v int")
    got = relational.first_layer("k", layer(("a", 1), ("a", 1)), layer(("a", 2), (None, 3)), layer(("b", 4), (None, 5)))
    assert sorted((r.k or "", r.v, r.layer) for r in got.collect()) == [("", 3, 2), ("a", 1, 1), ("a", 1, 1), ("b", 4, 3)]
    assert relational.placed(layer(), "n", F.col("v")).count() == 0


def test_filters_and_calendar_rules(spark):
    assert values(spark, "x string", [("WTT Youth Smash",), ("Asian Para Games",), ("YOUTH olympic x qualifier",), ("Tour",), (None,), ("",)], classified(F.col("x"))) == [("WTT Youth Grand Smash", "--"), ("Multi sport events", "--"), ("Youth Olympic Games Qualification", "--"), ("Continental", "Senior Championships"), None, None]
    assert values(spark, "s int", [(None,), (1,), (15,)], filters.senior(F.col("s"))) == [False, True, False]
    assert values(spark, "s string, g string", [("completed", "[]"), ("completed", "x"), (None, None)], filters.incomplete(F.col("s"), F.lit("1-0"), F.col("g"))) == [True, False, False]
    assert values(spark, "x string, z string", [("MAIN", None), ("Main Draw - Division 2", None), ("Main Draw", "正赛 - 甲"), ("Position matches 5-8 - Division 3", None), ("Positions", None), (None, None)], stage_prefix(F.col("x"), F.col("z"))) == [
        ("main", "", 0), ("main-division-2", "第2级别", 0), ("main-", "甲", 0), ("position-5-8-division-3", "排位赛 5-8 第3级别", -1000), None, None,
    ]
