"""Rounds, stages and disciplines as Column expressions. Rule order is part of the meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyspark.functions.scores import lookup
from rallyspark.functions.text import nz, stage_token

#: Order of draw rounds and aliases of their names.
DRAW_ORDER = {"R256": 5, "R128": 10, "R64": 20, "R32": 30, "R16": 40, "QuarterFinal": 50, "SemiFinal": 60, "Bronze": 70, "Final": 80}
DRAW_ALIASES = {
    "final": "Final", "f": "Final",
    "semifinal": "SemiFinal", "semi final": "SemiFinal", "sf": "SemiFinal",
    "quarterfinal": "QuarterFinal", "quarter final": "QuarterFinal", "qf": "QuarterFinal",
    "r16": "R16", "round of 16": "R16", "round 16": "R16",
    "r32": "R32", "round of 32": "R32", "round 32": "R32",
    "r64": "R64", "round of 64": "R64", "round 64": "R64",
    "r128": "R128", "round of 128": "R128", "round 128": "R128",
    "r256": "R256", "round of 256": "R256", "round 256": "R256", "256": "R256",
}
#: Rules of one event whose second stage names its rounds by their size: (stage, round or None, draw round or None).
EVENT_RULES = {
    910: [
        ("main draw - stage 2 (5-8th place)", None, None), ("main draw - stage 2 (7th place)", None, None), ("main draw - stage 2 (5th place)", None, None),
        ("main draw - stage 2 (bronze match)", "2", "Bronze"), ("main draw - stage 2", "8", "QuarterFinal"), ("main draw - stage 2", "4", "SemiFinal"), ("main draw - stage 2", "2", "Final"),
    ],
}
#: Codes of schedules and brackets.
SCHEDULE_ROUNDS = {"R128-": "R128", "R128": "R128", "R64-": "R64", "R64": "R64", "R32-": "R32", "R32": "R32", "R16-": "R16", "R16": "R16", "8FNL": "R16", "QFNL": "QF", "SFNL": "SF", "FNL-": "F", "FNL": "F"}
BRACKET_ROUNDS = {
    "FNL-": ("MAIN_DRAW", "F", 80), "FNL": ("MAIN_DRAW", "F", 80), "SFNL": ("MAIN_DRAW", "SF", 60), "QFNL": ("MAIN_DRAW", "QF", 50), "8FNL": ("MAIN_DRAW", "R16", 40),
    "R32-": ("MAIN_DRAW", "R32", 30), "R32": ("MAIN_DRAW", "R32", 30), "R64-": ("MAIN_DRAW", "R64", 20), "R64": ("MAIN_DRAW", "R64", 20),
    "RND1": ("PRELIMINARY", "R1", 10), "RND2": ("PRELIMINARY", "RND2", 20), "RND3": ("PRELIMINARY", "RND3", 30),
}
#: Words of category texts, tried in this order.
CATEGORY_ROUNDS = [
    ("round of 256", "R256"), ("round of 128", "R128"), ("round of 64", "R64"), ("round of 32", "R32"), ("round of 16", "R16"),
    ("quarter-final", "QF"), ("quarterfinal", "QF"), ("semi-final", "SF"), ("semifinal", "SF"), ("final", "F"),
]
#: Names of disciplines, historical round labels, numeric and short names of team rounds.
DISCIPLINES = {
    "men's teams": "MT", "women's teams": "WT", "mixed teams": "XT", "men's singles": "MS", "women's singles": "WS", "men's doubles": "MD", "women's doubles": "WD", "mixed doubles": "XD",
}
HISTORICAL = {"F": "Final", "SF": "SemiFinal", "QF": "QuarterFinal", "BR": "Bronze", "RR": "Round Robin"}
TEAM_ALIASES = {"F": "Final", "FNL": "Final", "FNL-": "Final", "SF": "SemiFinal", "SFNL": "SemiFinal", "QF": "QuarterFinal", "QFNL": "QuarterFinal", "8FNL": "R16"}
TEAM_NUMBERS = {"2": "Final", "4": "SemiFinal", "8": "QuarterFinal", "16": "R16", "32": "R32", "64": "R64", "128": "R128"}
ROUND_LABELS = {
    "Final": "决赛", "FNL": "决赛", "FNL-": "决赛", "Bronze": "铜牌赛", "SemiFinal": "半决赛", "SFNL": "半决赛", "QuarterFinal": "四分之一决赛", "QFNL": "四分之一决赛",
    "8FNL": "16 强", "R16": "16 强", "R32": "32 强", "R64": "64 强", "R128": "128 强",
}
ROUND_MISSING = "轮次待补"


def draw_round(event_id: Column, stage: Column, round_: Column) -> Column:
    """Draw round of a match: bronze by name first, then the event's own rules, then aliases in the main draw; null elsewhere."""
    s, r = F.lower(F.trim(nz(stage))), F.lower(F.trim(nz(round_)))
    out = F.when(F.contains(s, F.lit("bronze")) | F.contains(r, F.lit("bronze")), "Bronze")
    for event, rules in EVENT_RULES.items():
        for rule_stage, rule_round, draw in rules:
            hit = (event_id == event) & (s == rule_stage)
            out = out.when(hit if rule_round is None else hit & (r == rule_round), F.lit(draw))
    return out.when(s == "main draw", lookup(r, DRAW_ALIASES))


def draw_order(c: Column) -> Column:
    return lookup(c, DRAW_ORDER)


def non_tour(category: Column) -> Column:
    """Whether the category is known and no ``WTT_`` one; null is not."""
    return F.coalesce(~F.startswith(category, F.lit("WTT_")), F.lit(False))


def position_round_two(stage: Column, round_: Column) -> Column:
    return (F.trim(nz(stage)) == "Position Draw") & F.trim(nz(round_)).isin("2", "Round 2")


def _info(stage: Column | str, code: Column, group: Column | None = None) -> Column:
    stage = F.lit(stage) if isinstance(stage, str) else stage
    return F.struct(stage.alias("stage_code"), code.alias("round_code"), (F.lit(None).cast("string") if group is None else group).alias("group_code"))


def schedule_round(c: Column) -> Column:
    """struct<stage_code, round_code, group_code> of a schedule's round code."""
    raw = F.upper(F.trim(nz(c)))
    group = F.regexp_extract(raw, r"^GP(\d{2})", 1).try_cast("int")
    qualifying = F.regexp_extract(raw, r"^RND(\d+)$", 1).try_cast("int")
    direct = lookup(raw, SCHEDULE_ROUNDS)
    return (
        F.when(group.between(1, 16), _info("PRELIMINARY", F.concat(F.lit("G"), group.cast("string")), F.substring(raw, 1, 4)))
        .when(qualifying.isNotNull(), _info("PRELIMINARY", F.concat(F.lit("R"), qualifying.cast("string"))))
        .when(direct.isNotNull(), _info("MAIN_DRAW", direct))
        .otherwise(_info("UNKNOWN", F.lit("UNKNOWN")))
    )


def bracket_round(c: Column) -> Column:
    """struct<stage_code, round_code, round_order> of a bracket's round code."""
    raw = F.upper(F.trim(nz(c)))
    part = lambda i: lookup(raw, {k: v[i] for k, v in BRACKET_ROUNDS.items()})
    group = F.regexp_extract(raw, r"^GP(\d+)$", 1).try_cast("int")
    stage = F.coalesce(part(0), F.when(group.isNotNull(), "MAIN_STAGE1"))
    return F.struct(stage.alias("stage_code"), F.coalesce(part(1), F.nullif(raw, F.lit(""))).alias("round_code"), F.coalesce(part(2), group + 100).alias("round_order"))


def category_round(c: Column) -> Column:
    """struct<stage_code, round_code> of a category's text."""
    raw = F.lower(nz(c))
    number = lambda form: F.regexp_extract(raw, form, 1).try_cast("int").cast("string")
    out = F.when(F.contains(raw, F.lit("group ")), F.struct(F.lit("PRELIMINARY").alias("stage_code"), F.concat(F.lit("G"), number(r"group\s+(\d+)")).alias("round_code")))
    out = out.when(raw.rlike(r"qualifying round\s+\d+"), F.struct(F.lit("PRELIMINARY").alias("stage_code"), F.concat(F.lit("R"), number(r"qualifying round\s+(\d+)")).alias("round_code")))
    out = out.when(F.contains(raw, F.lit("preliminary round")), F.struct(F.lit("PRELIMINARY").alias("stage_code"), F.lit("R1").alias("round_code")))
    for word, code in CATEGORY_ROUNDS:
        out = out.when(F.contains(raw, F.lit(word)), F.struct(F.lit("MAIN_DRAW").alias("stage_code"), F.lit(code).alias("round_code")))
    none = F.lit(None).cast("string")
    return out.otherwise(F.struct(none.alias("stage_code"), none.alias("round_code")))


def live_round(code: Column, *texts: Column) -> Column:
    """The code's round, else what the texts say: ``Round of n``, ``Group n``, ``Preliminary Round``."""
    known, hay = schedule_round(code), F.concat_ws(" ", code, *texts)
    number = lambda form: F.regexp_extract(hay, form, 1).try_cast("int")
    of, group = number(r"(?i)Round of\s+(\d+)"), number(r"(?i)Group\s+(\d+)")
    two = F.when(F.length(group.cast("string")) < 2, F.lpad(group.cast("string"), 2, "0")).otherwise(group.cast("string"))
    return (
        F.when(known["stage_code"] != "UNKNOWN", known)
        .when(of.isNotNull(), _info("MAIN_DRAW", F.concat(F.lit("R"), of.cast("string"))))
        .when(group.isNotNull(), _info("PRELIMINARY", F.concat(F.lit("G"), group.cast("string")), F.concat(F.lit("GP"), two)))
        .when(hay.rlike("(?i)Preliminary Round"), _info("PRELIMINARY", F.lit("R1")))
        .otherwise(known)
    )


def described_round(c: Column) -> Column:
    """Schedule code of a feed's description; null where it names no round."""
    raw = F.trim(nz(c))
    size, group = F.regexp_extract(raw, r"(?i)Round of\s+(\d+)", 1), F.regexp_extract(raw, r"(?i)Group\s+(\d+)", 1).try_cast("int").cast("string")
    return (
        F.when(raw.rlike("(?i)Preliminary Round"), "RND1").when(raw.rlike("(?i)Quarterfinal"), "QFNL").when(raw.rlike("(?i)Semifinal"), "SFNL").when(raw.rlike(r"(?i)\bFinal\b"), "FNL")
        .when(size.isin("16", "32", "64", "128"), lookup(size, {"16": "8FNL", "32": "R32-", "64": "R64-", "128": "R128"}))
        .when(group.isNotNull(), F.concat(F.lit("GP"), F.when(F.length(group) < 2, F.lpad(group, 2, "0")).otherwise(group)))
    )


#: Patterns of a round in raw rows, tried in this order.
RAW_ROUNDS = [r"\b(R\d{1,3})\b", r"\b(QF|SF|F|QuarterFinal|SemiFinal|Final)\b", r"\b(Round\s+of\s+\d+)\b", r"\b(Rd\s+\d+)\b", r"\b(Group\s+[A-Z])\b", r"\b(Preliminary|Prelim|Repechage)\b"]


def raw_round(c: Column) -> Column:
    """The first pattern's first hit in a raw row, ``Rn`` in upper case; empty where none hits."""
    hits = [F.nullif(F.regexp_extract(nz(c), f"(?i){p}", 1), F.lit("")) for p in RAW_ROUNDS]
    found = F.coalesce(*hits, F.lit(""))
    return F.when(found.rlike(r"(?i)^r[\d ]+$"), F.upper(found)).otherwise(found)


def discipline(code: Column, *texts: Column) -> Column:
    """Discipline of a code's own name, else of the first text that begins with one."""
    out = lookup(F.lower(F.trim(nz(code))), DISCIPLINES)
    for text in texts:
        raw, found = F.lower(F.trim(nz(text))), F.lit(None).cast("string")
        for name, short in reversed(DISCIPLINES.items()):
            found = F.when(F.startswith(raw, F.lit(name)), short).otherwise(found)
        out = F.coalesce(out, found)
    return out


def team_class(document: Column) -> Column:
    return F.when(F.startswith(nz(document), F.lit("TTEMTEAM")), "MTEAM").when(F.startswith(nz(document), F.lit("TTEWTEAM")), "WTEAM")


def team_table(code: Column) -> Column:
    return lookup(code, {"MT": "MTEAM", "WT": "WTEAM"})


def is_team_discipline(c: Column) -> Column:
    """The importers' test: MT, WT, XT, or an age group's MT or WT."""
    code = F.upper(F.trim(nz(c)))
    return code.isin("MT", "WT", "XT") | F.endswith(code, F.lit("MT")) | F.endswith(code, F.lit("WT"))


def is_team_title(c: Column) -> Column:
    """The champion test's: any code that ends with T."""
    return F.endswith(nz(c), F.lit("T"))


def historical_label(code: Column, label: Column) -> Column:
    raw = F.upper(F.trim(nz(code)))
    group = F.regexp_extract(raw, r"^G(\d+)$", 1)
    return F.coalesce(lookup(raw, HISTORICAL), F.when(raw.rlike(r"^(R|QR)\d+$"), raw), F.when(group != "", F.concat(F.lit("Group "), group)), label)


def team_round(round_: Column, label: Column) -> Column:
    """struct<code, label, order> of a team tie's round: short names and sizes count as rounds; unknown ones keep their text, order 0."""
    raw = F.trim(nz(round_))
    name = F.coalesce(lookup(raw, TEAM_ALIASES), lookup(raw, TEAM_NUMBERS), raw)
    order = lookup(name, DRAW_ORDER | {"R256": None})
    given = F.trim(nz(label))
    standard = (given == "") | given.rlike(r"^\d+$") | lookup(F.upper(given), TEAM_ALIASES).isNotNull()
    known = F.struct(name.alias("code"), F.when(standard, lookup(name, ROUND_LABELS)).otherwise(given).alias("label"), order.alias("order"))
    other = F.struct(F.coalesce(F.nullif(round_, F.lit("")), F.lit("unknown")).alias("code"), F.coalesce(F.nullif(given, F.lit("")), F.nullif(round_, F.lit("")), F.lit(ROUND_MISSING)).alias("label"), F.lit(0).alias("order"))
    return F.when(order.isNotNull(), known).otherwise(other)


def stage_qualifier(c: Column) -> Column:
    """``Division 2`` in Chinese; other texts trimmed."""
    number = F.regexp_extract(F.trim(nz(c)), r"(?i)^Division\s+(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("第"), number, F.lit("级别"))).otherwise(F.trim(nz(c)))


def stage_prefix(stage: Column, stage_zh: Column) -> Column:
    """struct<code, label, shift> of a knockout stage of teams, null for other stages: main draws, with a part or without, and position matches.

    Position matches come a thousand places before the main draw's rounds.
    """
    text = F.trim(nz(stage))
    part = F.regexp_extract(text, r"(?i)^Main Draw\s*-\s*(.+)$", 1)
    bare = F.regexp_replace(stage_zh, r"^(主赛|正赛)\s*-\s*", "")
    said = stage_qualifier(F.coalesce(F.when(bare != stage_zh, bare), F.nullif(part, F.lit(""))))
    token = stage_token(F.when(part != "", part).otherwise(said))
    main = F.struct(F.when(said != "", F.concat(F.lit("main-"), token)).otherwise("main").alias("code"), said.alias("label"), F.lit(0).alias("shift"))
    rest = F.trim(F.regexp_replace(text, "(?i)^Position matches", ""))
    form = r"(?i)^(.*?)\s*-\s*(Division\s+\d+)$"
    split = rest.rlike(form)
    span, division = F.when(split, F.trim(F.regexp_extract(rest, form, 1))).otherwise(rest), F.when(split, F.regexp_extract(rest, form, 2)).otherwise("")
    some = lambda c: F.nullif(c, F.lit(""))
    placing = F.struct(
        F.concat_ws("-", F.lit("position"), some(stage_token(span)), some(stage_token(division))).alias("code"), F.concat_ws(" ", F.lit("排位赛"), some(span), some(stage_qualifier(division))).alias("label"), F.lit(-1000).alias("shift"),
    )
    plain = F.struct(F.lit("main").alias("code"), F.lit("").alias("label"), F.lit(0).alias("shift"))
    return F.when(text == "MAIN", plain).when(text.rlike(r"(?i)^Main Draw(\s*-\s*.+)?$"), main).when(text.rlike(r"(?i)^Position matches\b"), placing)


def round_label(round_: Column, label: Column) -> Column:
    """Standard label, else the given one, else the raw name, else the placeholder."""
    raw = F.trim(nz(round_))
    return F.coalesce(lookup(raw, ROUND_LABELS), F.nullif(F.trim(label), F.lit("")), F.nullif(raw, F.lit("")), F.lit(ROUND_MISSING))


def stage_label(c: Column) -> Column:
    return F.when(F.contains(F.lower(nz(c)), F.lit("groups")), "Groups").otherwise(F.trim(c))


def stage_priority(code: Column, label: Column) -> Column:
    """100 times the kind of stage (main, position, qualification, other) plus its division, 99 where it has none."""
    text = F.trim(F.concat_ws(" ", nz(code), nz(label)))
    lower = F.lower(text)
    number = F.nullif(F.regexp_extract(text, r"(?i)Division\s*(\d+)", 1), F.lit(""))
    chinese = F.nullif(F.regexp_extract(text, r"第([一二三四五六七八九十\d]+)级别", 1), F.lit(""))
    digits = {d: i + 1 for i, d in enumerate("一二三四五六七八九十")}
    division = F.coalesce(number.try_cast("int"), chinese.try_cast("int"), lookup(chinese, digits), F.lit(99))
    has = lambda *words: F.lit(False) if not words else _any(lower, words)
    kind = F.when(has("main draw", "正赛", "主赛"), 0).when(has("position", "排位赛"), 1).when(has("qualification", "资格赛"), 2).otherwise(3)
    return kind * 100 + division


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def classify(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The first rule (words, class) whose words the text holds, case apart; rules are a parameter in order of precedence."""
    lower, out = F.lower(nz(text)), None
    for words, value in rules:
        hit = F.contains(lower, F.lit(words.lower()))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def continental_override(name: Column, kind: Column) -> Column:
    """``Asian Games`` are Continental Games; ``Asian Para Games`` are not."""
    lower = F.lower(nz(name))
    return F.when(F.contains(lower, F.lit("asian games")) & ~F.contains(lower, F.lit("asian para games")), "Continental Games").otherwise(kind)
