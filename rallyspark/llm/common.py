"""Helpers of the corpus operators: table access, shared scratch tables and tokenizer paths."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch, so that rows with long texts take bounded memory in the JVM and in its Python workers.
BATCH_BYTES = 4 << 20


def modest_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes where nothing bounds them; a bound that is set for the session stays as it is.

    Plans read the setting when they run, which may be long after a table was named, so it stays with the session.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) >= (1 << 31) - 1:
        spark.conf.set(name, str(BATCH_BYTES))


#: What drops the caches of this Python worker, and the operator that it works for.
_droppers: list[Callable[[], None]] = []
_working: list[str] = []


def dropped_by(drop: Callable[[], None]) -> None:
    """Name a cache that other operators' tasks drop."""
    _droppers.append(drop)


def work_for(operator: str) -> None:
    """Called by a task in its worker: workers are used again, so what they hold for another operator goes first."""
    if _working != [operator]:
        for drop in _droppers:
            drop()
        _working[:] = [operator]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a new one only where Spark runs in one local process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rallyspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in a folder for each value of ``by``, and read it back: the lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        jvm, path = df.sparkSession._jvm, getattr(df, "_stored_at", None)
        if path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration() if hasattr(df.sparkSession, "_jsc") else df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_of(column: str = "text"):
    """The text with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def key():
    """doc_id as text: whole 64-bit ids and nulls pass through pandas unchanged."""
    return F.col("doc_id").cast("string").alias("doc_id")


def with_key(df: DataFrame) -> DataFrame:
    """doc_id as a whole number again."""
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


_GAP = re.compile("(?<! ) ")


def slices(text: str, size: int = 1 << 18):
    """Cut a text before runs of spaces into parts of about ``size`` characters, so that very long texts need bounded memory."""
    at, n = 0, len(text)
    while n - at > size:
        cut = _GAP.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]
