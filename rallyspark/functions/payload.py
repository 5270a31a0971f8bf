"""Nested payloads: schemas of feeds and what is taken out of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyspark.functions.rounds import bracket_round, described_round, discipline
from rallyspark.functions.scores import bracket_winner, first_filled, tie_score, winner_of
from rallyspark.functions.text import blank_to_null, match_code, nz

COMPETITOR = "struct<Code:string,Organization:string,Description:struct<TeamName:string,GivenName:string,FamilyName:string,IfId:string>>"
PLACE = f"struct<Wlt:string,Code:string,Competitor:{COMPETITOR},PreviousUnit:struct<Unit:string>>"
BRACKET = (
    "struct<EventId:string,Competition:struct<Bracket:array<struct<Code:string,BracketItems:array<struct<Code:string,"
    f"BracketItem:array<struct<Unit:string,Code:string,Position:int,Date:string,Time:string,Result:string,CompetitorPlace:array<{PLACE}>>>>>>>>>"
)
UNIT = (
    "struct<Code:string,SubEvent:string,Round:string,StartDate:string,ScheduleStatus:string,Location:string,Result:string,UpdatedAt:string,"
    "ItemName:array<struct<Language:string,Value:string>>,"
    f"StartList:struct<Start:array<struct<Competitor:struct<Code:string,Organization:string,Description:struct<TeamName:string,IfId:string,GivenName:string,FamilyName:string>,"
    "Composition:struct<Athlete:array<struct<Code:string,Order:int,Description:struct<GivenName:string,FamilyName:string,Organization:string,IfId:string>>>>>>>>>"
)
SCHEDULE = f"struct<Competition:struct<Unit:array<{UNIT}>>>"


def schedule_units(c: Column) -> Column:
    """Units of a schedule payload, whether it is one object or a list of them."""
    listed = F.startswith(F.trim(nz(c)), F.lit("["))
    wrapped = F.when(listed, c).otherwise(F.concat(F.lit("["), c, F.lit("]")))
    units = F.transform(F.from_json(wrapped, f"array<{SCHEDULE}>"), lambda x: F.coalesce(x["Competition"]["Unit"], F.array().cast(f"array<{UNIT}>")))
    return F.filter(F.flatten(units), lambda u: u.isNotNull())


def bracket_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row for each bracket item of the JSON texts, with round, sides, feeders, winner and status."""
    # an item takes only what it needs of its document along, not the document
    p = payloads.select(F.from_json(column, BRACKET).alias("p"))
    p = p.select(F.col("p.EventId").try_cast("long").alias("event_id"), F.explode("p.Competition.Bracket").alias("bracket"))
    p = p.select("event_id", F.col("bracket.Code").alias("draw_code"), F.explode("bracket.BracketItems").alias("items"))
    p = p.withColumn("round", bracket_round(F.col("items.Code")))
    p = p.select("event_id", "draw_code", "round", F.posexplode("items.BracketItem").alias("item_pos", "item"))
    place = lambda i: F.get("item.CompetitorPlace", F.lit(i))
    winner = bracket_winner(place(0)["Wlt"], place(1)["Wlt"], F.col("item.Result"))
    dated = (nz(F.col("item.Date")) != "") | (nz(F.col("item.Time")) != "")
    placed = F.exists(F.coalesce("item.CompetitorPlace", F.array().cast(f"array<{PLACE}>")), lambda x: (nz(x["Competitor"]["Organization"]) != "") | (nz(x["PreviousUnit"]["Unit"]) != ""))
    status = F.when(winner.isNotNull() | (F.trim(nz(F.col("item.Result"))) != ""), "completed").when(dated | placed, "scheduled")

    def side(i: int) -> Column:
        c = place(i)
        team = F.nullif(c["Competitor"]["Organization"], F.lit(""))
        name = first_filled(c["Competitor"]["Description"]["TeamName"], c["Competitor"]["Code"], c["Code"], c["PreviousUnit"]["Unit"])
        return F.struct(team.alias("team"), F.when(team.isNull(), name).alias("placeholder"), blank_to_null(c["PreviousUnit"]["Unit"]).alias("previous_unit"))

    return p.select(
        "event_id", "draw_code", "item_pos", match_code(F.coalesce("item.Unit", "item.Code")).alias("unit_code"),
        "round", F.col("item.Position").alias("position"), F.col("item.Result").alias("result"), side(0).alias("side_a"), side(1).alias("side_b"), winner.alias("winner_side"), status.alias("status"),
    )


def official_score(final_result: Column, result_overall: Column, overall: Column) -> Column:
    """First filled of the final result's value and the two overall scores (the importer's order)."""
    return first_filled(final_result, result_overall, overall)


def scraper_score(overall: Column, result_overall: Column, result: Column, score: Column, final: Column, final_result: Column) -> Column:
    """First filled in the scraper's order."""
    return first_filled(overall, result_overall, result, score, final, final_result)


def player_ids(c: Column, keys: tuple[str, ...] = ("playerId", "IfId", "player_id")) -> Column:
    """Distinct player ids anywhere in a JSON text, in order of appearance."""
    names = "|".join(keys)
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(nz(c), F.lit(rf'"(?:{names})"\s*:\s*"?(\d+)"?'), F.lit(1)), lambda x: x.try_cast("long")), lambda x: x.isNotNull()))


def mapped_codes(codes: Column, mapping: Column) -> Column:
    """Codes through a map column; codes that it does not hold stay."""
    return F.transform(codes, lambda c: F.coalesce(F.try_element_at(mapping, c), c))


def crossed(first: Column, second: Column) -> Column:
    """All pairs of two short arrays, as array<struct<a, b>>."""
    return F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.struct(a.alias("a"), b.alias("b")))))


def placeholder(organization: Column, name: Column) -> Column:
    """Whether a competitor stands for a place not yet filled."""
    return F.upper(nz(organization)).isin("DEF", "TBD") | (F.upper(F.trim(nz(name))) == "TBD")


ATHLETE = "struct<Code:string,Order:int,Description:struct<GivenName:string,FamilyName:string,Organization:string,IfId:string,Gender:string,BirthDate:string>>"
BRACKET_PLACE = f"struct<Pos:string,Competitor:struct<Code:string,Organization:string,Description:struct<TeamName:string>,Composition:struct<Athlete:array<{ATHLETE}>>>>"
OFFICIAL = "struct<competitiorId:string,competitiorName:string,competitiorOrg:string,players:array<struct<playerId:string,playerName:string,playerOrgCode:string>>>"
CARD = (
    f"struct<documentCode:string,subEventName:string,subEventDescription:string,tableName:string,tableNumber:string,resultOverallScores:string,overallScores:string,"
    f"resultsGameScores:string,gameScores:string,matchDateTime:struct<startDateUTC:string,startDateLocal:string>,competitiors:array<{OFFICIAL}>>"
)
POOL_ROW = f"struct<Group:string,Rank:int,Played:int,Won:int,Lost:int,Result:string,For:int,Against:int,GamesWon:int,GamesLost:int,QualificationMark:string,Competitor:struct<Code:string,Organization:string,Description:struct<TeamName:string>,Composition:struct<Athlete:array<{ATHLETE}>>>>"


def bracket_players(places: Column, side: int, team_code: Column, placeholder_text: Column) -> Column:
    """Players of one side of a bracket item: array<struct<player_id, name, country>>.

    The place is the one with that ``Pos``, else the one at that index. Without named athletes the team's name, the placeholder or the
    team's code stands as one player without id; without these there is none.
    """
    place = F.coalesce(F.get(F.filter(places, lambda p: p["Pos"].try_cast("int") == side), F.lit(0)), F.get(places, F.lit(side - 1)))
    competitor = place["Competitor"]
    team = F.coalesce(blank_to_null(competitor["Organization"]), team_code)
    person = lambda a: F.nullif(F.concat_ws(" ", blank_to_null(a["Description"]["FamilyName"]), blank_to_null(a["Description"]["GivenName"])), F.lit(""))
    named = F.transform(
        F.filter(competitor["Composition"]["Athlete"], lambda a: person(a).isNotNull()),
        lambda a: F.struct(F.trim(F.coalesce(a["Description"]["IfId"], a["Code"])).try_cast("long").alias("player_id"), person(a).alias("name"), F.coalesce(blank_to_null(a["Description"]["Organization"]), team).alias("country")),
    )
    name = F.coalesce(blank_to_null(competitor["Description"]["TeamName"]), F.nullif(placeholder_text, F.lit("")), F.nullif(team_code, F.lit("")))
    kind = "array<struct<player_id:bigint,name:string,country:string>>"
    one = F.array(F.struct(F.lit(None).cast("long").alias("player_id"), name.alias("name"), team.alias("country"))).cast(kind)
    return F.when(F.size(F.coalesce(named, F.array().cast(kind))) > 0, named.cast(kind)).when(name.isNotNull(), one).otherwise(F.array().cast(kind))


def official_players(competitor: Column) -> Column:
    """Players of an official competitor, else the competitor itself: array<struct<player_id, name, country>>."""
    kind = "array<struct<player_id:bigint,name:string,country:string>>"
    own, org = blank_to_null(competitor["competitiorName"]), blank_to_null(competitor["competitiorOrg"])
    listed = F.transform(
        competitor["players"],
        lambda p: F.struct(F.trim(p["playerId"]).try_cast("long").alias("player_id"), F.coalesce(blank_to_null(p["playerName"]), own, F.lit("Unknown")).alias("name"), F.coalesce(blank_to_null(p["playerOrgCode"]), org).alias("country")),
    )
    alone = F.array(F.struct(F.trim(competitor["competitiorId"]).try_cast("long").alias("player_id"), own.alias("name"), org.alias("country"))).cast(kind)
    return F.when(F.size(F.coalesce(listed, F.array().cast(kind))) > 0, listed.cast(kind)).when(own.isNotNull(), alone).otherwise(F.array().cast(kind))


def live_rows(cards: DataFrame, units: DataFrame, column: str = "card") -> DataFrame:
    """Match cards (JSON texts, with source_status) as canonical live rows; the schedule's units (code, sub_event, round, location, label)
    fill what a card lacks, and the unit's round and label go first."""
    c = cards.withColumn("c", F.from_json(column, CARD)).withColumn("match_code", match_code(F.col("c.documentCode")))
    u = units.select(F.col("code").alias("match_code"), F.col("sub_event").alias("_sub"), F.col("round").alias("_round"), F.col("location").alias("_loc"), F.col("label").alias("_label"))
    j = c.join(u, "match_code", "left")
    score = F.coalesce(F.nullif("c.resultOverallScores", F.lit("")), F.nullif("c.overallScores", F.lit("")))
    games = F.filter(F.transform(F.split(F.coalesce("c.resultsGameScores", "c.gameScores", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    two = F.slice(F.coalesce("c.competitiors", F.array().cast(f"array<{OFFICIAL}>")), 1, 2)
    sides = F.transform(two, lambda x: F.struct(F.coalesce(x["competitiorOrg"], F.lit("")).alias("organization"), F.coalesce(x["competitiorName"], F.lit("")).alias("display_name"), official_players(x).alias("players")))
    return j.select(
        "match_code", "source_status", F.coalesce(discipline(F.col("c.subEventName")), "_sub").alias("sub_event"), F.col("c.subEventName").alias("sub_event_name"),
        F.coalesce(F.nullif("_round", F.lit("")), described_round(F.col("c.subEventDescription"))).alias("round"), F.coalesce("c.matchDateTime.startDateUTC", "c.matchDateTime.startDateLocal").alias("scheduled_start"),
        F.coalesce(F.nullif("c.tableName", F.lit("")), F.nullif("c.tableNumber", F.lit("")), "_loc").alias("table_no"), F.coalesce("_label", "c.subEventDescription").alias("session_label"), score.alias("score"), games.alias("games"),
        F.when(F.size(two) == 2, winner_of(tie_score(score))).alias("winner_side"), sides.alias("sides"),
    )


def pool_rows(rows: DataFrame, column: str = "row") -> DataFrame:
    """Standings rows (struct POOL_ROW) flat, with the roster as an array; wrongly decoded names are repaired."""
    r = lambda c: F.col(f"{column}.{c}")
    athlete = lambda a: F.struct(a["Code"].alias("code"), a["Order"].alias("order"), a["Description"]["IfId"].alias("if_id"), a["Description"]["Organization"].alias("organization"), F.concat_ws(" ", blank_to_null(a["Description"]["GivenName"]), blank_to_null(a["Description"]["FamilyName"])).alias("name"))
    rest = [c for c in rows.columns if c != column]
    return rows.select(
        *rest, r("Group").alias("group_code"), r("Competitor.Organization").alias("organization"), r("Competitor.Code").alias("competitor_code"), repaired(r("Competitor.Description.TeamName")).alias("team_name"), r("QualificationMark").alias("qualification_mark"),
        r("Rank").alias("rank"), r("Played").alias("played"), r("Won").alias("won"), r("Lost").alias("lost"), r("For").alias("score_for"), r("Against").alias("score_against"), r("GamesWon").alias("games_won"), r("GamesLost").alias("games_lost"),
        F.transform(r("Competitor.Composition.Athlete"), athlete).alias("players"),
    )


def repaired(c: Column) -> Column:
    """Text that was UTF-8 read as GBK, read anew: only where that is possible and leaves fewer Chinese characters than before."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def fix(text: str | None) -> str | None:
            chinese = lambda t: sum("一" <= ch <= "鿿" for ch in t)
            if not text or not chinese(text):
                return text
            try:
                again = text.encode("cp936").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                return text
            return again if chinese(again) < chinese(text) else text

        return texts.map(fix, na_action="ignore")

    return run(c)
