"""Steps whose cost must not grow with the square of a key's rows, nor a task's memory with the table."""

import time

from pyspark.sql import functions as F

from rallyspark.operators import identity, schedule
from rallyspark.operators import relational as R
from rallyspark.operators.components import folded

MANY = 60_000


def quick(df, seconds: int = 60):
    """The number of rows; pairs of all rows of the one key would take far longer."""
    began = time.time()
    n = df.agg(F.count(F.lit(1)), *[F.count(c) for c in df.columns]).first()[0]
    assert time.time() - began < seconds
    return n


def named(spark, key: str, *more):
    return spark.range(MANY).select(F.col("id").alias(key), F.lit("Ann Lee").alias("name"), *more)


def test_f3_name_of_very_many_with_one_rank(spark):
    profiles = named(spark, "player_id", F.lit("N1").alias("country_code"), F.lit(3).alias("profile_rank"))
    asks = named(spark, "id", F.lit("n1").alias("country_code"), F.lit(3).alias("rank"))
    out = identity.verified_by_rank(asks, profiles)
    assert quick(out) == MANY and out.where("player_id is not null").count() == 0
    assert identity.verified_by_rank(asks, profiles.limit(1)).where("player_id is null").count() == 0


def test_f4_group_of_very_many_players(spark):
    players = named(spark, "player_id", F.lit("N1").alias("country_code"))
    history = players.select(F.col("name").alias("player_name"), F.col("country_code").alias("current_country"), F.lit("N2").alias("historical_country"))
    asks = named(spark, "id", F.lit("n2").alias("country"), F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("context"))
    proof = spark.createDataFrame([(7, "c0"), (7, "c0"), (8, "c1"), (9, "c1")], "player_id long, context string")
    out = identity.resolve_players(asks, identity.player_index(players, history), identity.same_name_groups(players, history), proof)
    assert quick(out) == MANY
    assert {tuple(r) for r in out.groupBy("context", "player_id", "status").count().collect()} == {("c0", 7, "matched", MANY // 2), ("c1", None, "same_name_ambiguous", MANY // 2)}


def test_f6_group_of_very_many_teams(spark):
    groups = spark.range(MANY).select(F.lit("s").alias("stage"), F.lit("G").alias("group_code"), F.col("id").alias("team_code"))
    ties = spark.createDataFrame([(1, 2, 3), (2, 5, 5), (3, 4, -1), (4, None, 3)], "k long, team_a long, team_b long")
    out = schedule.groups_by_pair(ties, groups)
    assert quick(out) == 4 and sorted((r.k, r.group_code, r.issue) for r in out.collect()) == [(1, "G", None), (2, None, "no common group"), (3, None, "no common group"), (4, None, "side without one country")]


def test_f7_very_many_rows_of_one_key(spark):
    side = lambda name: spark.range(MANY).select((F.col("id") + 5).alias(name), F.lit(1).alias("c"))
    out = schedule.match_passes(side("k"), side("row_id"), [["c"]], "k", "row_id")
    assert quick(out) == MANY and out.where("row_id <> 5 or step <> 1").count() == 0


def test_folds_keep_groups_apart_over_batches(spark):
    rows = spark.range(25_000).select((F.col("id") % 3).alias("key"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "x").alias("note"))

    def fold(group):
        total = 0
        for row in group:
            total += row["seq"]
            yield total, row["note"]

    got = {tuple(r) for r in folded(rows, "key", "seq", fold, {"total": "long", "same": "string"}).collect()}
    want = {(k, s, "x" if s % 2 == 0 else None, sum(range(k, s + 1, 3)), "x" if s % 2 == 0 else None) for k in range(3) for s in range(k, 25_000, 997 * 3)}
    assert len(got) == 25_000 and want <= got


def test_partitions_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "DEALT_ROWS", 100)
    assert R.parts_of(spark.range(4001)) == 41 and R.dealt(spark.range(4001), "id").rdd.getNumPartitions() == 41
    assert R.parts_of(spark.range(1)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_f15_customers_and_lines_are_dealt_in_number(spark, sf_dir, monkeypatch):
    from rallyspark.plans import catalogue

    plan = lambda: catalogue.QUERIES["symmetric_pair_join"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    customers, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("customer", "lineitem"))
    monkeypatch.setattr(R, "DEALT_ROWS", 100)
    text = plan()
    assert "RepartitionByExpression [c_custkey" in text and f", {-(-customers * 25 // 100)}" in text and f", {-(-lines // 100)}" in text
