"""Sources and sinks: JSON feeds, text dictionaries, content hashes, partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyspark.functions.payload import BRACKET
from rallyspark.functions.text import blank_to_null, id_list

MATCH = (
    "struct<sub_event:string,stage:string,stage_zh:string,round:string,round_zh:string,side_a:array<string>,side_b:array<string>,match_score:string,"
    "games:array<string>,winner:string,perspective:string,result_for_player:string,raw_row_text:string>"
)
EVENT_FILE = f"schema_version string, event_id long, event string, event_year int, matches array<{MATCH}>"
PLAYER_FILE = f"player_id long, player_name string, years map<string,struct<events:array<struct<event_name:string,event_name_zh:string,event_year:string,matches:array<{MATCH}>>>>>"
POINTS = "array<struct<event:string,event_zh:string,category:string,category_zh:string,position:string,position_zh:string,points:int,expires_on:string,expires_on_zh:string>>"
RANKING_FILE = (
    "category string, ranking_week string, ranking_date string, scraped_at string, total_players int, "
    f"rankings array<struct<rank:int,name:string,name_zh:string,country_code:string,player_id:string,points:int,rank_change:int,points_breakdown:{POINTS}>>"
)
CORRUPT = "_corrupt_record"


def whole_files(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(value, file) of documents: of a folder with one a file, or of a table (file, value) that holds very many of them bundled.

    A file of its own costs tens of milliseconds to make, list and open, which is far more than a document of some kilobytes costs as a row.
    """
    return source.select("value", "file") if isinstance(source, DataFrame) else spark.read.option("wholetext", True).text(source).select("value", F.input_file_name().alias("file"))


def json_files(spark: SparkSession, source: str | DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Sound documents (see ``whole_files``) with ``file`` and ``file_id`` (the number at the end of its name or its folder's), and the unreadable ones."""
    raw = whole_files(spark, source)
    parsed = raw.withColumn("d", F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}))
    parsed = parsed.withColumn("file_id", F.regexp_extract("file", r"_(\d+)\.json(?:/[^/]*)?$", 1).try_cast("long"))
    sound = F.col("d").isNotNull() & F.col(f"d.{CORRUPT}").isNull()
    return parsed.where(sound).select("d.*", "file", "file_id").drop(CORRUPT), parsed.where(~sound).select("file", F.col("value").alias("text"))


def match_files(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Matches of event files and of player files in one shape: those with ``matches`` are event files, others hold a map of years."""
    documents, _ = json_files(spark, source, f"{EVENT_FILE}, {PLAYER_FILE}")
    none = F.lit(None).cast("long")
    entry = lambda event_id, name, year, owner, matches: F.struct(event_id.alias("event_id"), name.alias("event_name"), year.alias("event_year"), owner.alias("owner_id"), matches.alias("matches"))
    own = entry(F.coalesce("event_id", "file_id"), F.col("event"), F.col("event_year"), none, F.col("matches"))
    # a null among a map's years or their events has no matches
    listed = F.flatten(F.filter(F.transform(F.map_values("years"), lambda y: y["events"]), lambda x: x.isNotNull()))
    played = F.transform(listed, lambda e: entry(none, e["event_name"], e["event_year"].try_cast("int"), F.col("player_id"), e["matches"]))
    entries = documents.select("file", "file_id", F.explode(F.when(F.col("matches").isNotNull(), F.array(own)).otherwise(played)).alias("e"))
    return entries.select("file", "file_id", "e.event_id", "e.event_name", "e.event_year", "e.owner_id", F.posexplode("e.matches").alias("pos", "m")).select("file", "file_id", "event_id", "event_name", "event_year", "owner_id", "pos", "m.*")


def ranking_files(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """One row for each ranking entry, with its place in the file."""
    documents, _ = json_files(spark, source, RANKING_FILE)
    return documents.select("file", "category", "ranking_week", "ranking_date", F.posexplode("rankings").alias("seq", "r")).select("file", "category", "ranking_week", "ranking_date", F.col("seq").cast("long").alias("seq"), "r.*")


def bracket_files(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Whole bracket documents as text, for ``payload.bracket_rows``."""
    return whole_files(spark, source).select(F.col("value").alias("payload"), "file").where(F.from_json("payload", BRACKET).isNotNull())


def colon_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """code, name and name_zh of lines ``code:name:name_zh``; a line may lack the second colon."""
    parts = F.split(F.trim("value"), ":", 3)
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.trim(parts[0]).alias("code"), blank_to_null(F.get(parts, F.lit(1))).alias("name"), blank_to_null(F.get(parts, F.lit(2))).alias("name_zh"))


def same_name_file(spark: SparkSession, path: str) -> DataFrame:
    """player_id, name and country of lines ``id,name,country``; comments and other lines are left out."""
    parts = F.transform(F.split("value", ",", 3), lambda x: F.trim(x))
    rows = spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit("#"))).select(parts.alias("p")).where(F.size("p") == 3)
    return rows.select(F.col("p")[0].try_cast("long").alias("player_id"), F.col("p")[1].alias("name"), F.upper(F.col("p")[2]).alias("country")).where("player_id is not null and name <> '' and country <> ''")


def category_document(document: DataFrame) -> DataFrame:
    """One mapping row for each kind and alias of kind of (category_id, event_type, event_kind, event_kind_aliases, priority)."""
    kinds = F.array_distinct(F.concat(F.array("event_kind"), F.coalesce("event_kind_aliases", F.array().cast("array<string>"))))
    return document.withColumn("event_kind", F.explode(kinds)).drop("event_kind_aliases")


def override_champions(documents: DataFrame) -> DataFrame:
    """(event_id, sub_event_type_code, champion) of override documents with a known presentation mode."""
    mode = F.trim(F.coalesce("presentation_mode", F.lit("")))
    code, champion = F.upper(F.trim("sub_event_type_code")), F.upper(F.trim("podium.champion"))
    rows = documents.where(mode.isin("staged_round_robin", "team_knockout_with_bronze"))
    return rows.select("event_id", code.alias("sub_event_type_code"), champion.alias("champion")).where("event_id is not null and sub_event_type_code <> '' and champion <> ''")


def changed_files(spark: SparkSession, path: str, seen: DataFrame) -> DataFrame:
    """Files whose content hash differs from the one seen (file, hash), with the new hash."""
    now = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("hash"))
    return now.join(seen.select("file", "hash"), ["file", "hash"], "left_anti")


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """Name of the newest file of a folder, by its time and name."""
    return spark.read.format("binaryFile").load(path).select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("file"))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def champion_ids(c: str):
    """Ids of a stored list; empty members count as no id."""
    return id_list(F.col(c))


