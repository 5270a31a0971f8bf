"""Micro-batches: event-time windows, deduplication, live upserts with a guard for official results, and a request limiter.

Windows and watermarks go beyond what the surveyed platform does (it polls); the upserts are its rules as stream sinks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from rallyspark.operators.merge import latest_incoming, upsert
from rallyspark.sources.shared import shared_dir

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def files(spark: SparkSession, path: str, schema: StructType, per_batch: int = 1000, time: str | None = None) -> DataFrame:
    """Parquet files of a path (a glob) as a stream; ``time`` becomes a TIMESTAMP, which watermarks need."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    return df.withColumn(time, F.col(time).cast("timestamp")) if time else df


def run(stream: DataFrame, merge: Merge | None = None, mode: str = "update", place: str | None = None) -> DataFrame:
    """Process all that is there and return the resulting table.

    Every batch writes the next version of the table from the version before (a Parquet folder in the shared place), so a batch that is
    repeated after a failure writes the same version again. Without ``merge`` the last batch is the table (complete mode).
    """
    spark = stream.sparkSession
    place = place or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        before = session.read.parquet(f"{place}/v{n - 1}") if n and merge else None
        (merge(before, batch) if merge else batch).write.mode("overwrite").parquet(f"{place}/v{n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    last = query.lastProgress
    return spark.read.parquet(f"{place}/v{last['batchId']}")


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], late: str = "1 hour", slide: str | None = None, **measures) -> DataFrame:
    """Aggregates by key and window of event time (sliding with ``slide``); rows later than the watermark are dropped by the stream."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    source = df.withWatermark(time, late) if df.isStreaming else df
    out = source.groupBy(w.alias("w"), *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(F.col("w.start").alias("window_start"), *keys, *measures)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Runs of a key's rows without a pause of ``gap``: start, end of the last row's gap, rows."""
    source = df.withWatermark(time, late) if df.isStreaming else df
    out = source.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def once(df: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append(before: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Sink that keeps all rows of all batches."""
    return batch if before is None else before.unionByName(batch)


def latest_by(keys: list[str], order: list[str], guard=None) -> Merge:
    """Sink that keeps one row for each key: the newest, unless ``guard`` (columns o.x, n.x) forbids the change."""

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = latest_incoming(batch, keys, *order)
        return new if before is None else upsert(before, new, keys, when=guard)

    return merge


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, which state with timers needs; the session's own choice is restored."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Windows(StatefulProcessor):
    """A key's open window: when it ends and how many requests it holds; a timer at its end removes it."""

    def __init__(self, key: str, window_ms: int, limit: int):
        self.key, self.window_ms, self.limit = key, window_ms, limit

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "reset long, used int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = np.sort(np.concatenate([part["at_ms"].to_numpy(np.int64) for part in rows]))
        held = self.open.get()
        before = reset, used = held if held is not None else (0, 0)
        places, i = np.empty(len(at), np.int64), 0
        while i < len(at):  # once for each window
            if at[i] >= reset:
                reset, used = int(at[i]) + self.window_ms, 0
            end = int(np.searchsorted(at, reset))
            places[i:end] = used + 1 + np.arange(end - i)
            used, i = used + end - i, end
        self.open.update((reset, used))
        if reset != before[0]:
            self.handle.registerTimer(reset)
        yield pd.DataFrame({self.key: [key[0]] * len(at), "at_ms": at, "used": places.astype(np.int32), "allowed": places <= self.limit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        if held is not None and held[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def limiter(df: DataFrame, key: str, time: str, window_ms: int, limit: int, late: str = "1 hour") -> DataFrame:
    """Add to each request whether it is allowed: ``limit`` requests of a key in a window that opens with its first request.

    Windows are not aligned: a key's next one opens with the first request at or after the end of the last. State is two numbers a key,
    and a timer removes it once the watermark (``late`` behind the newest request) has passed the window's end, so keys that fall silent
    cost nothing. Requests before the watermark are dropped by the stream. Start the query inside ``timed_state``.
    """
    kind = dict(df.dtypes)[key]
    at = F.col(time).cast("timestamp")
    rows = df.select(key, at.alias("at")).withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy(key).transformWithStateInPandas(_Windows(key, window_ms, limit), f"{key} {kind}, at_ms long, used int, allowed boolean", "Update", "EventTime")
