import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rallyspark.functions.payload import bracket_rows
from rallyspark.operators import merge
from rallyspark.sources import readers
from rallyspark.streaming import live
from tests.helpers import rows

S = "code string, status string, source string, at timestamp, v string"
T0 = datetime(2025, 1, 1)


def test_live_replay_keeps_official_results(spark, tmp_path):
    feed = [("a", "live", "live", 1, "x"), ("a", "completed", "official", 2, "final"), ("a", "live", "live", 3, "late"), ("b", "live", "live", 1, "y"), ("b", "live", "live", 4, "z")]
    path = tmp_path / "in"
    for i, (c, st, so, m, v) in enumerate(feed):
        spark.createDataFrame([(c, st, so, T0 + timedelta(minutes=m), v)], S).coalesce(1).write.parquet(f"{path}/{i}")
    stream = live.files(spark, f"{path}/*", spark.read.parquet(f"{path}/0").schema, per_batch=1)
    out = live.run(stream, live.latest_by(["code"], ["at"], merge.not_final() & (F.col("n.at") >= F.col("o.at"))), "append", f"file://{tmp_path}/out")
    assert rows(out, "code", "v") == {("a", "final"), ("b", "z")}


def test_rate_limit_windows_open_with_the_first_request(spark, tmp_path):
    at = [0, 10, 20, 30, 59, 61, 62, 200, 259, 260]
    spark.createDataFrame([("u", T0 + timedelta(seconds=s)) for s in at] + [("w", T0)], "user string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    with live.timed_state(spark):
        out = live.run(live.limiter(stream, "user", "ts", 60_000, 3), live.append, "update", f"file://{tmp_path}/out")
    got = [(r.user, r.used, r.allowed) for r in out.orderBy("user", "at_ms").collect()]
    assert got == [("u", i, i <= 3) for i in (1, 2, 3, 4, 5)] + [("u", 1, True), ("u", 2, True), ("u", 1, True), ("u", 2, True), ("u", 1, True)] + [("w", 1, True)]


def test_state_of_silent_keys_ends(spark, tmp_path):
    """Four batches; users of the first ones fall silent, and once the watermark is past their windows only the last user's state is left."""
    for i, (user, minutes) in enumerate([("a", 0), ("b", 1), ("c", 300), ("d", 600)]):
        spark.createDataFrame([(user, T0 + timedelta(minutes=minutes, seconds=s)) for s in range(5)], "user string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with live.timed_state(spark):
        stream = live.files(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/0").schema, per_batch=1)
        query = live.limiter(stream, "user", "ts", 60_000, 3, "1 minute").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").format("noop").trigger(availableNow=True).start()
        query.awaitTermination()
    assert query.exception() is None and len(query.recentProgress) >= 4
    values = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/state").select("key.*").collect()
    assert [r[0] for r in values] == ["d"] and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_batch_windows_equal_streamed_ones(spark, tmp_path):
    df = spark.createDataFrame([(T0 + timedelta(minutes=7 * i), i % 3) for i in range(200)], "ts timestamp, k int")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = live.tumbling(df, "ts", "1 hour", ["k"], n=F.count(F.lit(1)))
    stream = live.tumbling(live.files(spark, f"{tmp_path}/in", df.schema, time="ts"), "ts", "1 hour", ["k"], n=F.count(F.lit(1)))
    assert rows(live.run(stream, mode="complete", place=f"file://{tmp_path}/out")) == rows(batch)
    assert rows(live.sessions(df, "ts", "8 minutes", []), "n") == {(200,)}


def test_match_files_of_both_shapes(spark, tmp_path):
    m = {"sub_event": "MS", "stage": "Main Draw", "round": "Final", "side_a": ["A (X)"], "side_b": ["B (Y)"], "match_score": "4-1", "raw_row_text": "2024 | Ev"}
    (tmp_path / "event_12.json").write_text(json.dumps({"schema_version": "1", "event": "Ev", "event_year": 2024, "matches": [m, m]}))
    (tmp_path / "player_7.json").write_text(json.dumps({"player_id": 7, "player_name": "A", "years": {"2024": {"events": [{"event_name": "Ev", "event_year": "2024", "matches": [m]}]}}}))
    (tmp_path / "broken_3.json").write_text('{"event": ')
    got = readers.match_files(spark, f"{tmp_path}/*.json")
    assert rows(got, "event_id", "owner_id", "pos", "round", "event_year") == {(12, None, 0, "Final", 2024), (12, None, 1, "Final", 2024), (None, 7, 0, "Final", 2024)}
    _, bad = readers.json_files(spark, f"{tmp_path}/*.json", readers.EVENT_FILE)
    assert bad.count() == 1


def test_rankings_dictionaries_and_hashes(spark, tmp_path):
    (tmp_path / "r_1.json").write_text(json.dumps({"category": "WS", "ranking_week": "1", "ranking_date": "2025-01-01", "total_players": 2, "rankings": [{"rank": 1, "name": "A", "points": 9, "points_breakdown": [{"event": "e", "points": 9}]}, {"rank": 2, "name": "B", "points": 8}]}))
    assert rows(readers.ranking_files(spark, f"{tmp_path}/r_*.json"), "category", "seq", "rank", "name") == {("WS", 0, 1, "A"), ("WS", 1, 2, "B")}
    (tmp_path / "d.txt").write_text("WS:Women's Singles:女单\nXX:odd\n\n")
    assert rows(readers.colon_dictionary(spark, f"{tmp_path}/d.txt")) == {("WS", "Women's Singles", "女单"), ("XX", "odd", None)}
    (tmp_path / "s.txt").write_text("# note\n12, LI Wei , chn\nbad,line,x\n13,LI Wei,\n")
    assert rows(readers.same_name_file(spark, f"{tmp_path}/s.txt")) == {(12, "LI Wei", "CHN")}
    seen = spark.createDataFrame([], "file string, hash string")
    now = readers.changed_files(spark, f"{tmp_path}/d.txt", seen)
    assert now.count() == 1 and readers.changed_files(spark, f"{tmp_path}/d.txt", now).count() == 0
    docs = spark.createDataFrame([(5, " xt ", "staged_round_robin", ("chn",)), (6, "XT", "other", ("CHN",)), (None, "XT", "staged_round_robin", ("CHN",))], "event_id long, sub_event_type_code string, presentation_mode string, podium struct<champion:string>")
    assert rows(readers.override_champions(docs)) == {(5, "XT", "CHN")}
    cats = spark.createDataFrame([("c", "T", "k", ["k", "l"])], "category_id string, event_type string, event_kind string, event_kind_aliases array<string>")
    assert rows(readers.category_document(cats), "event_kind") == {("k",), ("l",)}
    (tmp_path / "b.json").write_text('{"EventId":"5","Competition":{"Bracket":[{"Code":"D","BracketItems":[{"Code":"SFNL","BracketItem":[{"Unit":"U"}]}]}]}}')
    assert rows(bracket_rows(readers.bracket_files(spark, f"{tmp_path}/b.json")), "event_id", "unit_code") == {(5, "U")}


def test_partition_commit_replaces_only_its_scope(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    merge.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "event_id int, v string"), path, "event_id")
    merge.write_partitions(spark.createDataFrame([(2, "c")], "event_id int, v string"), path, "event_id")
    assert rows(spark.read.parquet(path), "event_id", "v") == {(1, "a"), (2, "c")}


def test_documents_of_a_table_are_read_like_files(spark):
    """Sound, cut and null documents as rows (file, value): ids from names, both shapes in one pass."""
    docs = [
        ("event_7.json", '{"schema_version":"1","event":"E","matches":[{"round":"R1"},{"round":"R2"}]}'), ("event_8.json", '{"schema_version":"1","ev'), ("event_9.json", None),
        ("player_3.json", '{"player_id":4,"years":{"2020":{"events":[{"event_name":"T","event_year":"2020","matches":[{"round":"F"}]}]},"2021":null,"2022":{"events":null}}}'),
    ]
    bundle = spark.createDataFrame(docs, "file string, value string")
    assert rows(readers.match_files(spark, bundle), "file_id", "event_id", "event_name", "event_year", "owner_id", "pos", "round") == {(7, 7, "E", None, None, 0, "R1"), (7, 7, "E", None, None, 1, "R2"), (3, None, "T", 2020, 4, 0, "F")}
    assert rows(readers.json_files(spark, bundle, readers.EVENT_FILE)[1], "file") >= {("event_8.json",)}
