"""Connected components of edges between any nodes, so that a fold over rows that depend on each other runs on one small group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyspark.sources.shared import discard, stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that is reachable, for every node of ``edges`` (a, b); nodes may be texts or numbers.

    Each round a node takes the least label among its neighbours' and its own, then the label of that label; the number of rounds
    grows with the logarithm of the longest chain of equal descent. Rounds are stored tables. Nulls link nothing; a loop is a node.
    Joins are sorts: stored labels take far less room in files than in a driver that would broadcast them.
    """
    links = stored(edges.where("a is not null and b is not null").select("a", "b").union(edges.where("a is not null and b is not null").select("b", "a")).distinct(), "links")
    now = stored(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = links.join(now.select(F.col("node").alias("b"), F.col("label").alias("seen")).hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        moved = stored(now.join(near.hint("merge"), "node").select("node", "label", F.least("label", "seen").alias("low")), "moved")
        far = moved.select(F.col("node").alias("low"), F.col("low").alias("next"))
        after = stored(moved.join(far.hint("merge"), "low").select("node", F.least("low", "next").alias("label"), (F.least("low", "next") != F.col("label")).alias("_new")), "labels")
        changed = after.where("_new").limit(1).count()
        discard(moved, now)
        now = after.drop("_new")
        now._stored_at = after._stored_at
        if not changed:
            discard(links)
            return now


#: Rows of an Arrow batch that a fold hands back.
FOLDED_ROWS = 4096
_TYPES = {"long": pa.int64(), "string": pa.string()}


def folded(rows: DataFrame, key: str, order: str, fold: Callable[[Iterable[dict]], Iterable[tuple]], added: dict[str, str]) -> DataFrame:
    """Rows with what ``fold`` adds to each (a tuple of ``added``, names and types), given the rows of one ``key`` in ``order``.

    The groups of a sorted partition go through one pass, so very many small groups cost no call each, and no group is held whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.Schema] = []

        def seen() -> Iterator[dict]:
            for batch in batches:
                own[:] = [batch.schema]
                yield from batch.to_pylist()

        def each() -> Iterator[tuple]:
            for _, group in groupby(seen(), itemgetter(key)):
                kept: list[dict] = []
                for more in fold(_noted(group, kept)):
                    yield kept.pop(), more

        done = each()
        while part := list(islice(done, FOLDED_ROWS)):
            columns = [pa.array([r[f.name] for r, _ in part], f.type) for f in own[0]] + [pa.array([m[i] for _, m in part], _TYPES[t]) for i, t in enumerate(added.values())]
            yield pa.RecordBatch.from_arrays(columns, names=[*own[0].names, *added])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{n}` {t}" for n, t in added.items()])
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def _noted(rows: Iterable[dict], kept: list[dict]) -> Iterator[dict]:
    """Rows as they are taken; the one being worked on is in ``kept``."""
    for row in rows:
        kept.append(row)
        yield row
