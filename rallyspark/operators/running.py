"""Running ties: live messages with and without a code linked to the tie that they mean, twice opened ties merged.

Which tie a message belongs to depends on the ties that earlier messages have left, so linking is a fold in message order. It runs
within a connected part only: messages of one event and discipline that share a pair of teams, or whose pairs share a code. All else
(fields, scores, results that stand) is the closed form of ``replay`` over the links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyspark.functions.text import blank_to_null, match_number, nz
from rallyspark.operators import replay
from rallyspark.operators.components import connected, folded

UNIT = ["event_id", "sub_event_type_code"]
LATEST, PATCHED, FILLED = ["status", "score"], ["source_status", "session_label", "table_no", "team1", "team2"], ["stage_code", "round_code"]


def coded(messages: DataFrame) -> DataFrame:
    """Messages with ``code``: their own, else one made of discipline, round, session and teams; ``own_code`` says which, ``match_no`` is read from the session."""
    own = blank_to_null(F.col("external_match_code"))
    word = lambda c, other: F.coalesce(F.nullif(nz(c), F.lit("")), F.lit(other))
    teams = F.concat_ws("-", blank_to_null(F.col("team1")), blank_to_null(F.col("team2")))
    session = F.regexp_replace(word(F.col("session_label"), "UNKNOWN"), r"\W+", "")
    made = F.concat_ws("::", F.lit("LIVE"), "sub_event_type_code", word(F.col("round_code"), "UNKNOWN"), session, word(teams, "UNKNOWN"))
    return messages.withColumns({"code": F.coalesce(own, made), "own_code": own.isNotNull(), "match_no": match_number(F.col("session_label"))})


class Ties:
    """Ties that are open in one connected part, in the order in which they were opened. Fields are those that linking reads."""

    def __init__(self) -> None:
        self.open: list[dict] = []

    def _found(self, m: dict) -> dict | None:
        known = next((t for t in self.open if t["code"] == m["code"]), None)
        if known or m["own_code"] or not (m["team1"] and m["team2"]):
            return known
        for t in self.open:
            alike = {(t["team1"], t["team2"]), (t["team2"], t["team1"])} & {(m["team1"], m["team2"])} and all((t[c] or "") == (m[c] or "") for c in FILLED)
            if alike and any(m[c] and t[c] == m[c] for c in ("table_no", "match_no", "session_label")):
                return t
        return None

    def _twice(self, m: dict) -> dict | None:
        """A running tie that was opened with neither code nor round for the same teams and table."""
        if m["own_code"] or not (m["team1"] and m["team2"]):
            return None
        same = lambda t: (t["team1"], t["team2"], t["table_no"] or "") == (m["team1"], m["team2"], m["table_no"] or "")
        return next((t for t in self.open if t["status"] == "live" and t["code"].startswith("LIVE::") and t["round_code"] == "UNKNOWN" and same(t)), None)

    def take(self, m: dict) -> tuple[int, int | None]:
        """Number of the message's tie (that of the message that opened it), and of a tie that it removes."""
        tie, gone = self._found(m), None
        if tie is None:
            tie = {"number": m["seq"], **{c: m[c] for c in ("code", *PATCHED, *FILLED, "match_no", "status", "final")}}
            self.open.append(tie)
        elif m["final"] or not tie["final"]:
            twice = self._twice(m)
            if twice is not None and twice is not tie:
                gone = twice["number"]
                self.open.remove(twice)
            tie |= {c: m[c] for c in PATCHED if m[c] is not None} | {c: m[c] for c in FILLED if tie[c] is None} | {"status": m["status"], "final": m["final"]}
            if m["session_label"] is not None:
                tie["match_no"] = m["match_no"]
        return tie["number"], gone


def _fold(messages: Iterable[dict]) -> Iterator[tuple[int, int | None]]:
    ties = Ties()
    return (ties.take(m) for m in messages)


def linked(messages: DataFrame) -> DataFrame:
    """Messages with ``tie`` (the order of the message that opened it) and ``removes`` (a tie found to stand twice, or null).

    Needs event_id, sub_event_type_code, seq (whole and unique within both), external_match_code, team1, team2, stage_code, round_code,
    table_no, session_label, status, source_status. A message without a code and with less than two teams only meets its own made code.
    """
    low, high = F.least(nz(F.col("team1")), nz(F.col("team2"))), F.greatest(nz(F.col("team1")), nz(F.col("team2")))
    unit = F.concat_ws("\x1f", *UNIT)
    rows = coded(messages).withColumns({"final": replay.official_final(F.col("status"), F.col("source_status")), "_pair": F.concat_ws("\x1f", unit, low, high)})
    # a code that is sent with several pairs of teams connects them
    codes = rows.where("own_code").groupBy(*UNIT, "code").agg(F.min("_pair").alias("a"), F.max("_pair").alias("_hi")).where("a <> _hi").drop("_hi")
    shared = rows.where("own_code").select(*UNIT, "code", F.col("_pair").alias("b"), "team1", "team2").distinct().join(codes, [*UNIT, "code"])
    # a message with one team only mixes it with a team of another message: such a code's teams connect all pairs that they are in
    teams = lambda df, *more: df.select(*UNIT, F.explode(F.array("team1", "team2")).alias("team"), *more).where("team <> ''").distinct()
    mixed = shared.where((nz(F.col("team1")) == "") | (nz(F.col("team2")) == "")).select(*UNIT, "code").distinct()
    wide = teams(shared.join(mixed, [*UNIT, "code"], "left_semi"), "a").join(teams(rows, F.col("_pair").alias("b")), [*UNIT, "team"])
    alone = rows.where((low == "") & (high != "")).select(F.col("_pair").alias("a"), F.concat_ws("\x1f", unit, high, high).alias("b")).distinct()
    edges = shared.select("a", "b").union(wide.select("a", "b")).union(alone).where("a <> b")
    labels = connected(edges).select(F.col("node").alias("_pair"), "label")
    part = rows.join(labels.hint("merge"), "_pair", "left").withColumn("_part", F.coalesce("label", "_pair")).drop("label", "_pair")
    return folded(part, "_part", "seq", _fold, {"tie": "long", "removes": "long"}).select(*messages.columns, "code", "tie", "removes")


def running_ties(links: DataFrame) -> DataFrame:
    """States of the ties that are left, from ``linked`` messages (store them first: they are read twice).

    A tie that stood twice goes with all its messages, and with it what hangs on it.
    """
    gone = links.where("removes is not null").select(*UNIT, F.col("removes").alias("tie")).distinct()
    rows = links.join(gone, [*UNIT, "tie"], "left_anti")
    return replay.replay(rows, [*UNIT, "tie"], "seq", LATEST, PATCHED, FILLED, ["code"])
