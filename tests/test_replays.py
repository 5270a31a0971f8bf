"""Closed forms of message replays against the rules applied one message after the other; ties of results; countries."""

import random

from pyspark.sql import functions as F

from rallyspark.operators import identity, replay, views
from tests.helpers import rows

STATES = [("scheduled", None), ("live", "Live"), ("completed", "Live"), ("completed", "Official"), ("walkover", " COMPLETED "), (None, None)]


def final(status, source):
    return (status or "").strip().lower() in ("completed", "walkover") and (source or "").strip().lower() in ("official", "completed")


def by_steps(messages):
    """The importers' rules, message by message."""
    state = {}
    for key, _, status, source, score, table, stage, start in messages:
        old = state.get(key)
        if old is None:
            state[key] = [status, source, score, table, stage, start]
        elif not final(old[0], old[1]) or final(status, source):
            state[key] = [status, source if source is not None else old[1], score, table if table is not None else old[3], old[4] if old[4] is not None else stage, old[5]]
    return {(k, *v) for k, v in state.items()}


def test_replay_equals_the_rules_step_by_step(spark):
    # the feeds derive the status from the source, so messages without a source have no final status
    rng, messages = random.Random(7), []
    for seq in range(600):
        status, source = rng.choice(STATES)
        messages.append((rng.choice(["a", "b", "c", None] + [f"t{i}" for i in range(60)]), seq, status, source, rng.choice(["1-0", None]), rng.choice([None, f"T{seq}"]), rng.choice([None, f"S{seq}"]), rng.choice([None, f"D{seq}"])))
    df = spark.createDataFrame(messages, "tie string, seq long, status string, source_status string, score string, table_no string, stage string, start string").repartition(5)
    got = replay.replay(df, "tie", "seq", ["status", "score"], ["source_status", "table_no"], ["stage"], ["start"])
    assert rows(got, "tie", "status", "source_status", "score", "table_no", "stage", "start") == by_steps(messages)
    assert rows(replay.replay(df.limit(0), "tie", "seq", ["status"])) == set()


def test_rubbers_take_over_the_status_of_their_tie(spark):
    ties = spark.createDataFrame([("t", "completed", None, False, 9), ("u", "live", "Live", False, 1)], "tie string, status string, source_status string, final boolean, synced long")
    rubbers = spark.createDataFrame([("t", "t::R1", "live", "Live", False, 3), ("t", "t::R2", "walkover", "Official", True, 3), ("u", "u::R1", "scheduled", None, False, 2), ("v", "v::R1", "live", None, False, 1)], "tie string, rubber string, status string, source_status string, final boolean, synced long")
    assert rows(replay.cascaded(ties, rubbers, "tie"), "rubber", "status", "source_status") == {("t::R1", "completed", "Live"), ("t::R2", "walkover", "Official"), ("u::R1", "scheduled", None), ("v::R1", "live", None)}


TIE = "tie_id long, event_id long, sub_event_type_code string, external_match_code string, team1 string, team2 string, stage_code string, round_code string, group_code string, scheduled_local_at string, match_no int, table_no string"


def test_ties_by_code_then_by_teams_and_what_narrows_them(spark):
    ties = spark.createDataFrame(
        [
            (1, 1, "MT", "C1", "A", "B", None, None, None, "d1", 1, "T01"), (2, 1, "MT", "C2", "B", "A", "KO", "F", None, "d2", 2, None), (3, 1, "MT", "C3", "A", "B", None, None, "G1", "d1", 1, None), (4, 1, "MT", "C4", "X", "Y", None, None, None, None, 3, None), (5, 1, "MT", "C5", "X", "Y", None, None, None, None, 3, None),
        ],
        TIE,
    )
    wanted = spark.createDataFrame(
        [
            (1, 1, "MT", "C2", "Q", "R", None, None, None, None, None, None), (2, 1, "MT", None, "B", "A", "KO", "F", None, "d1", 1, None), (3, 1, "MT", None, "A", "B", None, None, "G1", "dX", None, None), (4, 1, "MT", None, "A", "B", None, None, None, "d1", 1, "T01"),
            (5, 1, "MT", None, "X", "Y", None, None, "", None, 3, None), (6, 1, "MT", None, "X", "Y", None, None, "", None, 3, None), (7, 1, "WT", None, "A", "B", None, "QF", None, None, None, None), (8, 1, "MT", None, None, "B", None, None, None, None, None, None),
        ],
        TIE.replace("tie_id", "wanted_id"),
    )
    assert rows(replay.found_ties(wanted, ties), "wanted_id", "tie_id") == {(1, 2), (2, 2), (3, 3), (4, 1), (5, None), (6, None), (7, None), (8, None)}
    out = replay.ensured_ties(wanted.where("wanted_id < 8"), ties)
    assert rows(out.where("tie_id is null"), "external_match_code") == {("COMP::MT::UNK::3::X-Y",), ("COMP::WT::QF::0::A-B",)}
    assert out.where("tie_id is not null").count() == 5 and out.columns == ties.columns


def test_schedule_status_never_falls_and_later_wins_on_equality(spark):
    units = spark.createDataFrame([("a", 1, "completed", "MT", "x"), ("a", 2, "walkover", "MT", None), ("a", 3, "live", "MT", None), ("b", 1, "odd", "MS", None), ("c", 1, "live", None, "x")], "code string, seq long, status string, d string, side string")
    got = replay.scheduled_units(units, F.col("d"), F.col("d") == "MT", "code", "seq", ["side"])
    assert rows(got, "kind", "code", "status", "side") == {("team_tie", "a", "walkover", "x"), ("match", "b", "odd", None)}


def test_countries_by_texts_then_by_the_table(spark):
    names = spark.createDataFrame([("CHN", "China")], "code string, name string")
    people = spark.createDataFrame([(1, None, "chn", None), (2, "c hn", "", "CHN"), (3, "XXX", " Some  land", "chn"), (4, "XXX", None, "en"), (5, None, None, None), (6, "YYY", "yyy", None)], "k long, country_code string, country string, country_en string")
    assert rows(identity.with_countries(people, names)) == {(1, "CHN", "CHINA", "CHINA"), (2, "CHN", "CHINA", "CHINA"), (3, "XXX", "SOME LAND", "SOME LAND"), (4, "XXX", "EN", "EN"), (5, None, None, None), (6, "YYY", "yyy", None)}


def test_detail_of_a_tie_lists_each_player_once(spark):
    ties = spark.createDataFrame([(1, "A", "B", "B", 1, 3, "KO:QF"), (2, "A", "B", None, 0, 0, None)], "tie_id long, team_a string, team_b string, winner_code string, score_a int, score_b int, round string")
    players = spark.createDataFrame([(1, 2, 1, 1, 7, "x", None), (1, 1, 1, 2, None, "x", ""), (1, 1, 1, 1, 5, "y", "c"), (1, 3, 2, 1, 9, "z", "c")], "tie_id long, match_id long, side_no int, player_no int, player_id long, name string, country_code string")
    got = rows(views.tie_detail(ties, players), "tie_id", "match_score", "winner_side", "round_code", "players_a.player_id", "players_b.name")
    assert got == {(1, "1-3", "B", "QF", (5, 7), ("z",)), (2, "0-0", None, None, (), ())}
