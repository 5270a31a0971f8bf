"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

Documents go through in batches of ascending doc_id. A run is a table of (line hash, the document that owns it), bucketed and sorted
by the hash. Each batch is reduced to one row a hash, merge-anti-joined with the runs of every level (both sides are dealt by the
hash, so runs are never shuffled again), and what is left becomes a run of the lowest level; when a level holds FAN runs they are
merged into one of the next. As batches ascend, the first document to bring a hash is the smallest that holds it. At the end every
line is looked up in the runs, and lines owned by another document go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyspark.llm.common import discard, shared_dir, store

#: Batches of documents, and runs of a level that are merged into one of the next.
BATCHES, FAN = 6, 3
#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped at both ends, only A-Z in lower case.

    ``lower`` does the same, and much faster, where no character beyond ASCII has a lower case of its own.
    """
    bare = F.btrim(line, F.lit(BLANKS))
    beyond = F.regexp_replace(bare, r"[\x00-\x7F]+", "")
    return F.when((F.char_length(bare) == F.octet_length(bare)) | (F.lower(beyond) == beyond), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hash(key: Column) -> Column:
    """128 bits of SHA-256: equal for equal keys only, for all practical purposes, at any number of lines."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _print(text: Column) -> Column:
    """Tells texts of rows with one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def batches_of(docs: DataFrame, n: int) -> Column:
    """Number from 0 of the range of doc_id that a row falls into; null ids come last. Any bounds give right results."""
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 1000)).first()[0] if n > 1 else None
    cuts = sorted(set(bounds or []))
    return F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts), F.lit(0))).cast("int")


class Runs:
    """Levels of runs: tables of (h, owner) bucketed and sorted by h, in the shared folder."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, df: DataFrame) -> tuple[str, str]:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        df.repartition(self.buckets, "h").write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        return name, path

    def _forget(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        gone = self.spark.createDataFrame([], "h binary")
        gone._stored_at = path
        discard(gone)

    def unknown(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` (one for each h) whose h is in no run."""
        for level in self.levels:
            for name, _ in level:
                keys = keys.join(self.spark.table(name).select("h").hint("merge"), "h", "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """A new run of the lowest level; full levels are compacted."""
        new = self._write(keys)
        for depth in range(len(self.levels) + 1):
            if depth == len(self.levels):
                self.levels.append([])
            self.levels[depth].append(new)
            if len(self.levels[depth]) < self.fan:
                return
            full, self.levels[depth] = self.levels[depth], []
            new = self._write(self._all([name for name, _ in full]))
            for run in full:
                self._forget(*run)

    def _all(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def owners(self) -> DataFrame:
        """All runs as one plain table, so that the planner may split frequent lines of the side that it is joined with."""
        return self.spark.read.schema("h binary, owner struct<late:boolean,doc_id:long>").parquet(*[path for level in self.levels for _, path in level])

    def drop(self) -> None:
        for level in self.levels:
            for run in level:
                self._forget(*run)
        self.levels = []


def dropped(docs: DataFrame, min_chars: int = 10, batches: int = BATCHES) -> DataFrame:
    """doc_id, print and positions (ascending, from 0) of the lines to drop, for every text that has some."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", _print(F.col("text")).alias("print"), batches_of(docs, batches).alias("batch"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    long = rows.where(F.char_length(F.btrim("line", F.lit(BLANKS))) >= min_chars)  # the key has as many code points
    lines = store(long.select("doc_id", "print", "batch", "at", _hash(line_key(F.col("line"))).alias("h")), "lines", by="batch")
    owner = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id")
    runs = Runs(spark)
    for batch in range(batches):
        # one row for each hash and task before the shuffle, so frequent lines are no burden
        keys = lines.where(F.col("batch") == batch).groupBy("h").agg(F.min(owner).alias("owner"))
        runs.add(runs.unknown(keys))
    held = lines.select("h", "doc_id", "print", "at").join(runs.owners(), "h")
    gone = held.where(~F.col("doc_id").eqNullSafe(F.col("owner.doc_id")))
    out = store(gone.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set("at")).alias("drops")), "drops")
    runs.drop()
    discard(lines)
    return out


def _kept(drops: Column, lines: Column) -> Column:
    """Lines whose place is not among the ascending ``drops``, by a mask of one flag for each place up to the last of them."""
    gaps = F.transform(drops, lambda x, i: x - F.when(i > 0, F.get(drops, i - 1)).otherwise(-1) - 1)
    mask = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(True), g), F.array(F.lit(False)))))
    return F.filter(F.arrays_zip(lines.alias("line"), mask.alias("stays")), lambda x: x["line"].isNotNull() & F.coalesce(x["stays"], F.lit(True)))


def deduplicated(docs: DataFrame, min_chars: int = 10, batches: int = BATCHES) -> DataFrame:
    """doc_id, text without dropped lines, n_lines and n_dropped of every row of ``docs`` (doc_id, text).

    A line goes if its key (see ``line_key``) has ``min_chars`` code points or more and a smaller doc_id holds it too; the smallest
    one keeps all its lines. A null or empty text is one empty line. Rows that share a doc_id are one document; rows without an id are
    one document that comes last. Repeated rows come out as often as they went in. Empty table: no rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    drops = dropped(rows, min_chars, batches).select(F.col("doc_id").alias("_doc"), "print", "drops")
    both = rows.withColumn("p", _print(F.col("text"))).join(drops, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("p") == F.col("print")), "left")
    lines = _lines(F.col("text"))
    kept = F.array_join(F.transform(_kept(F.col("drops"), lines), lambda x: x["line"]), "\n")
    count = lambda c: F.size(c).cast("long")
    return both.select("doc_id", F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("text"), count(lines).alias("n_lines"), F.when(F.col("drops").isNull(), 0).otherwise(count("drops")).cast("long").alias("n_dropped"))


ORACLE = r"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    held AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
    keyed AS (
      SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM held),
    owned AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
    marked AS (SELECT r, line, i, owner IS NOT NULL AND owner IS DISTINCT FROM doc_id AS gone FROM keyed LEFT JOIN owned USING (k))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked JOIN docs USING (r) GROUP BY r"""
