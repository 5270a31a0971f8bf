"""Schedules: refresh jobs of sessions, local days, dictionaries of stages and rounds, time zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallyspark.functions.dates import known_zone
from rallyspark.functions.rounds import stage_priority, team_round
from rallyspark.functions.scores import lookup
from rallyspark.functions.text import lookup_text, nz

#: Minutes between runs and length of the window of each source, and minutes after the session's start.
WINDOWS = {"live": (10, 6 * 60, 0), "brackets": (60, 7 * 60, 0), "official_reconcile": (60, 6 * 60, 5)}
SCHEDULE_AFTER, STANDINGS_AFTER, PROMOTE_AFTER = 7 * 60, 5 * 60, 24 * 60


def _plus(at: Column, minutes: int) -> Column:
    return F.timestamp_add("MINUTE", F.lit(minutes), at)


def session_runs(sessions: DataFrame) -> DataFrame:
    """(event_id, source, label, run_at) for every session of (event_id, local_date, label, start_at, main_draw_start).

    Live data every ten minutes for six hours; brackets every hour for seven, from the main draw on; official results five minutes
    after the start, then hourly, and once at the end.
    """
    rows = sessions.withColumn("s", F.date_trunc("minute", F.col("start_at")))
    parts = []
    for source, (step, length, offset) in WINDOWS.items():
        own = rows if source != "brackets" else rows.where(F.col("local_date") >= F.col("main_draw_start"))
        points = F.sequence(_plus(F.col("s"), offset), _plus(F.col("s"), length - 1), F.expr(f"interval {step} minutes"))
        if source == "official_reconcile":
            points = F.array_append(points, _plus(F.col("s"), length))
        parts.append(own.select("event_id", F.lit(source).alias("source"), "label", F.explode(points).alias("run_at")))
    return parts[0].union(parts[1]).union(parts[2])


def daily_runs(sessions: DataFrame) -> DataFrame:
    """Daily runs: schedule and standings after the second session (else the first), a backup at the first, promotion after the last day."""
    keys = ["event_id", "local_date"]
    day = sessions.groupBy(*keys).agg(F.max("main_draw_start").alias("main_draw_start"), F.array_sort(F.collect_list("start_at")).alias("starts"))
    day = day.withColumns({"first": F.col("starts")[0], "second": F.coalesce(F.get("starts", F.lit(1)), F.col("starts")[0])})
    row = lambda df, source, at: df.select("event_id", F.lit(source).alias("source"), F.lit("daily").alias("label"), at.alias("run_at"))
    last = day.groupBy("event_id").agg(F.max_by("second", "local_date").alias("second"))
    return (
        row(day, "schedule", _plus(F.col("second"), SCHEDULE_AFTER)).union(row(day.where(F.col("local_date") < F.col("main_draw_start")), "standings", _plus(F.col("second"), STANDINGS_AFTER)))
        .union(row(day, "backup", F.col("first"))).union(row(last, "promote", _plus(F.col("second"), PROMOTE_AFTER)))
    )


def merged_runs(runs: DataFrame) -> DataFrame:
    """Runs of one minute and source are one, with all labels."""
    return runs.groupBy("event_id", "source", "run_at").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def cron_ranges(runs: DataFrame) -> DataFrame:
    """Cron lines: consecutive hours of one day and source with the same minutes are one line."""
    hours = runs.groupBy("event_id", "source", F.to_date("run_at").alias("day"), F.hour("run_at").alias("hour")).agg(F.array_join(F.array_sort(F.collect_set(F.minute("run_at"))), ",").alias("minutes"))
    run = F.col("hour") - F.row_number().over(W.partitionBy("event_id", "source", "day", "minutes").orderBy("hour"))
    return hours.withColumn("_r", run).groupBy("event_id", "source", "day", "minutes", "_r").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour")).drop("_r")


def stage_round_codes(rows: DataFrame, stages: DataFrame, rounds: DataFrame, by_stage: DataFrame) -> DataFrame:
    """Add stage_code and round_code: aliases of stages (alias, code), rounds of a stage (stage_code, alias, code), then of all (alias, code)."""
    out = rows.withColumns({"_s": F.trim(F.coalesce("stage", F.lit(""))), "_r": F.trim(F.coalesce("round", F.lit("")))})
    out = out.join(stages.select(F.col("alias").alias("_s"), F.col("code").alias("stage_code")), "_s", "left").withColumn("stage_code", F.coalesce("stage_code", F.lit("UNKNOWN")))
    out = out.join(by_stage.select("stage_code", F.col("alias").alias("_r"), F.col("code").alias("_own")), ["stage_code", "_r"], "left")
    out = out.join(rounds.select(F.col("alias").alias("_r"), F.col("code").alias("_any")), "_r", "left")
    return out.withColumn("round_code", F.coalesce("_own", "_any", F.lit("UNKNOWN"))).select(*rows.columns, "stage_code", "round_code")


def category_of(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add category_id: active mapping of type and kind (null kinds match each other), highest priority, then least id."""
    m = mapping.where("is_active = 1").groupBy("event_type", "event_kind").agg(F.min_by("category_id", F.struct(-F.col("priority"), "id")).alias("category_id")).alias("m")
    e = events.alias("e")
    return e.join(m, F.col("e.event_type").eqNullSafe(F.col("m.event_type")) & F.col("e.event_kind").eqNullSafe(F.col("m.event_kind")), "left").select("e.*", "m.category_id")


def infer_zone(events: DataFrame, cities: DataFrame, countries: DataFrame) -> DataFrame:
    """Add time_zone and reason: the longest city phrase in the location, else the country's only zone, else why not.

    events: event_id, location, country_code; cities: city, time_zone; countries: country_code, time_zone (a row for each zone). A
    location's runs of words, as long as the longest city's name, are looked up among the cities: an equi-join.
    """
    named = cities.withColumn("_phrase", lookup_text(F.col("city"))).where("_phrase <> ''")
    longest = named.agg(F.max(F.size(F.split("_phrase", " ")))).first()[0] or 1
    words = F.split(lookup_text(F.col("location")), " ")
    run = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    runs = F.explode(F.array_distinct(F.flatten(F.array(*[run(n) for n in range(1, longest + 1)]))))
    hits = events.select("event_id", runs.alias("_phrase")).join(named, "_phrase").groupBy("event_id").agg(F.max_by("time_zone", F.struct(F.length("city"), "city")).alias("_city"))
    zones = countries.groupBy("country_code").agg(F.min("time_zone").alias("_zone"), F.count_distinct("time_zone").alias("_n"))
    out = events.join(hits, "event_id", "left").join(zones, "country_code", "left")
    zone = F.coalesce(known_zone(F.col("_city")), F.when(F.col("_n") == 1, known_zone(F.col("_zone"))))
    reason = F.when(F.col("_city").isNotNull(), "city").when(F.col("_n") == 1, "country").when(F.col("_n") > 1, "multi-zone country").otherwise("unknown place")
    return out.select(*events.columns, zone.alias("time_zone"), reason.alias("reason"))


def link_rubbers(rubbers: DataFrame, ties: DataFrame) -> DataFrame:
    """Add tie_id to rubbers (match_id, event_id, sub_event_type_code, stage, round, country_a, country_b by majority): the only tie of
    that event, discipline, stage and round between the two countries in either order."""
    keys = ["event_id", "sub_event_type_code", "stage", "round"]
    pair = lambda df, a, b: df.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)})
    one = pair(ties, "team_a", "team_b").groupBy(*keys, "_lo", "_hi").agg(F.min("tie_id").alias("tie_id"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return pair(rubbers, "country_a", "country_b").join(one, [*keys, "_lo", "_hi"], "left").drop("_lo", "_hi")


def historical_codes(rows: DataFrame, dictionary: DataFrame, code: str, label: str) -> DataFrame:
    """Label and Chinese label of a code, else the raw label without one. dictionary: code, name, name_zh."""
    d = dictionary.select(F.col("code").alias(code), F.col("name").alias("_n"), F.col("name_zh").alias("_zh"))
    return rows.join(d, code, "left").withColumns({f"{label}_name": F.coalesce("_n", label), f"{label}_zh": F.col("_zh")}).drop("_n", "_zh")


def repaired_round(raw: Column, round_code: Column) -> Column:
    """``8FNL`` rows coded as quarterfinal are round of 16; others stay."""
    return F.when((F.upper(F.trim(raw)) == "8FNL") & (round_code == "QF"), "R16").otherwise(round_code)


def priority_of(c: Column, table: dict[str, int]) -> Column:
    return lookup(c, table, 0)


def match_passes(asks: DataFrame, rows: DataFrame, passes: list[list[str]], key: str, row_key: str) -> DataFrame:
    """Add ``row_key`` of the first pass that finds rows, of several the least, and the pass (from 1).

    A pass is a list of columns that must be equal and filled on both sides, such as number and table, then table and sides, then
    number and sides. Each pass is one equi-join with the least row of each set of values, so a row meets one row a pass.
    """
    found = None
    for n, columns in enumerate(passes, 1):
        least = rows.groupBy(*columns).agg(F.min(row_key).alias(row_key))
        hit = asks.select(key, *columns).join(least, columns).select(key, F.struct(F.lit(n).alias("step"), F.col(row_key).alias("row")).alias("hit"))
        found = hit if found is None else found.union(hit)
    best = found.groupBy(key).agg(F.min("hit").alias("hit"))
    return asks.join(best, key, "left").select(*asks.columns, F.col("hit.row").alias(row_key), F.col("hit.step").alias("step"))


def groups_by_pair(ties: DataFrame, groups: DataFrame) -> DataFrame:
    """Add stage and group of ties (team_a, team_b) from tables of teams in groups (stage, group_code, team_code).

    A tie belongs to the group that holds both teams; a tie without teams or of two groups has an issue. Only pairs of teams that play
    are looked up, by the groups of the one and then of the other, so the pairs within a group are never built.
    """
    g = groups.select("stage", "group_code", "team_code")
    met = ties.select("team_a", "team_b").where("team_a <> team_b").distinct()
    found = met.join(g.withColumnRenamed("team_code", "team_a"), "team_a").join(g.withColumnRenamed("team_code", "team_b"), ["stage", "group_code", "team_b"])
    out = ties.join(found, ["team_a", "team_b"], "left")
    issue = F.when(F.col("team_a").isNull() | F.col("team_b").isNull(), "side without one country").when(F.col("group_code").isNull(), "no common group")
    return out.withColumn("issue", issue)


def list_order() -> list[Column]:
    """Sort keys of a list of schedule matches: time, stage, round, group, table, session, number.

    Lists may mix rows with and without a time: a missing time is the empty text and comes first, and rows without one stand among each
    other by stage and round. The comparison of two rows tests stage and round before the time only where both lack one, where the time
    decides nothing, so these keys give the same order for any mix. Texts compare by code points; a number may be written ``cm:12``.
    """
    number = F.coalesce(F.regexp_replace(F.col("schedule_match_id").cast("string"), "^cm:", "").try_cast("double"), F.lit(0.0))
    order = F.coalesce(team_round(F.col("round_code"), F.col("round_name"))["order"], F.lit(0))
    return [nz(F.col("scheduled_local_at")), stage_priority(F.col("stage_code"), F.col("stage_name")), -order, *[nz(F.col(c)) for c in ("group_code", "table_no", "session_label")], number]


def listed(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``place`` from 1, in the order of ``list_order``, to the matches of each list (one page: an event's day or stage)."""
    return matches.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*list_order())))
