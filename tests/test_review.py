"""Running ties, reviews of rankings and repair of raw rows: nulls, ties, repeated rows and empty tables."""

from rallyspark.operators import identity, repair, views
from tests.helpers import rows

TIES = "tie_id long, event_id long, sub_event_type_code string, external_match_code string, match_score string, note string"
SIDES = "tie_id long, side_no int, team_code string, team_name string"
BRACKETS = "event_id long, sub_event_type_code string, external_unit_code string, side_a_team_code string, side_b_team_code string"
RUBBERS = "tie_id long, match_id long, winner_side string"


def test_running_ties(spark):
    ties = spark.createDataFrame([(1, 7, "MT", "U1", "3-1", "n"), (2, 7, "MT", "U2", None, None), (3, 7, "MT", None, "x", None), (4, 7, "WT", "U1", "2-3", None), (5, 7, "MT", "U1", "3-0", None)], TIES)
    sides = spark.createDataFrame([(1, 1, "CHN", "China"), (1, 2, None, None), (2, 1, None, "winner of 1"), (2, 2, "KOR", None), (3, 1, None, None), (4, 2, None, None)], SIDES)
    brackets = spark.createDataFrame([(7, "MT", "U1", "X", "JPN"), (7, "MT", "U2", "GER", "Y"), (7, "MT", "U2", "GER", "Y"), (7, "MT", None, "Z", "Z")], BRACKETS)
    rubbers = spark.createDataFrame([(1, 12, "B"), (1, 11, "A"), (9, 1, "A")], RUBBERS)
    got = {r.tie_id: r for r in views.live_tie_view(ties, sides, brackets, rubbers).collect()}
    assert set(got) == {1, 2, 3, 4}  # a tie without sides is left out
    assert tuple(got[1].team_a) == ("CHN", "China") and tuple(got[1].team_b) == ("JPN", "JPN") and (got[1].score_a, got[1].score_b, got[1].note) == (3, 1, "n")
    assert [r.match_id for r in got[1].rubbers] == [11, 12] and got[2].rubbers is None
    assert tuple(got[2].team_a) == ("GER", "winner of 1") and (got[2].score_a, got[2].score_b) == (0, 0)
    assert tuple(got[3].team_a) == ("TBD", "TBD") and tuple(got[3].team_b) == ("", "")
    assert tuple(got[4].team_a) == ("", "") and tuple(got[4].team_b) == ("TBD", "TBD")  # the bracket of another discipline is not used
    empty = [spark.createDataFrame([], s) for s in (TIES, SIDES, BRACKETS, RUBBERS)]
    assert views.live_tie_view(*empty).count() == 0


RANKING = "category string, seq long, rank int, name string, country_code string, points int, player_id string, profile_url string, id_resolution_status string"
REVIEW = "category string, item long, rank int, name string, country_code string, points int, resolved_id string, resolved_url string"


def test_reviews(spark):
    ranking = spark.createDataFrame([("c", 1, 1, "A", "CHN", 9, None, "/a", "open"), ("c", 2, 1, "A", "CHN", 9, None, None, "open"), ("c", 3, 0, None, None, 0, "3", None, "open"), ("d", 1, 1, "A", "CHN", 9, None, None, "open")], RANKING)
    review = spark.createDataFrame([
        ("c", 1, 1, "A", "CHN", 9, "10", "/x"), ("c", 2, None, "A", None, None, "11", " "),  # both are the first row's: the last id, the link that is given
        ("c", 3, 0, None, None, None, "12", None), ("c", 4, None, "", None, None, "13", None),  # a rank of 0 is empty, an empty name fits a null one
        ("d", 5, None, None, None, None, "14", None), ("d", 6, 1, "A", "CHN", 9, None, "/no"), ("d", 7, 2, "A", None, None, "15", None),
    ], REVIEW)
    got = rows(identity.apply_review(ranking, review), "category", "seq", "player_id", "profile_url", "id_resolution_status")
    assert got == {("c", 1, "11", "/x", "manual"), ("c", 2, None, None, "open"), ("c", 3, "13", None, "manual"), ("d", 1, "14", None, "manual")}
    assert rows(identity.apply_review(ranking, review.limit(0))) == rows(ranking)
    players = spark.createDataFrame([(1, "Li Na", "chn"), (2, "NA Li", "CHN"), (3, "Li Na", "JPN"), (4, "A", "CHN"), (4, "A", "CHN")], "player_id long, name string, country_code string")
    entries = spark.createDataFrame([(9, "old", "GER")], "player_id long, name string, country string")
    asked = spark.createDataFrame([("c", 1, 1, "li na", " chn", 9, "1", None), ("c", 2, 1, "A", "CHN", 9, "4", None), ("c", 3, 1, "Li Na", "JPN", 9, " ", None), ("c", 4, 1, None, None, 9, "5", None)], REVIEW)
    assert rows(identity.reviewed_same_names(entries, asked, players)) == {(9, "old", "GER"), (1, "Li Na", "CHN"), (2, "NA Li", "CHN")}


def test_repair(spark):
    schema = "player_name string, raw_row_text string, match_score string, all_players_in_row array<string>, side_a array<string>, side_b array<string>, sub_event string, round string, perspective string, result_for_player string, winner string"
    raw = "2019 | Open | WANG An (CHN) | | ITO B (JPN) | | MS | Main | main | 2-2 | | | ITO B | x"
    data = [("an wang", raw, "2-2", None, ["old"], None, "WS", "F", None, None, ""), (None, None, None, None, None, None, None, None, "unknown", "unknown", None), ("B", "short | row", "3-0", [], [], [], "MS", "", "unknown", "unknown", "")]
    a, b, c = repair.repaired_matches(spark.createDataFrame(data, schema).coalesce(1)).collect()
    assert (a.side_a, a.side_b, a.sub_event, a.round, a.perspective, a.result_for_player, a.winner) == (["WANG An (CHN)"], ["ITO B (JPN)"], "MS", "", "side_a", "loss", "ITO B / x")
    assert a.changes == ["all_players_in_row", "side_a", "side_b", "sub_event", "round", "perspective", "result_for_player", "winner"]
    assert b.changes == [] and b.winner == "" and c.changes == [] and c.sub_event == "MS"
    assert repair.repaired_matches(spark.createDataFrame([], schema)).count() == 0
