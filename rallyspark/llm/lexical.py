"""Ranked lexical search with block-max pruning.

Every task reads its documents into blocks, runs of neighbouring rows. A block is a forward index (for each document its asked terms
and their counts, and its length). Corpus statistics come from all blocks; with them a block's per-term maxima of the impact
``(1000000000 * tf) div (1000 * tf + 8 * m)`` follow, and a query's bound for a block is the sum of its weights times those maxima.
In a task, a query visits blocks from the largest bound down, scores them through the forward index, and stops when a bound falls
below its k-th score. Two rounds: in the first each task scores only its best block for each query, and the best k-th score found
anywhere is where every task starts in the second. The tasks' lists, at most k rows for each query, are merged by rank.

Queries go in groups with a bounded number of terms, so the vocabulary that tasks hold and the index of asked terms are bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallyspark.llm.common import discard, store
from rallyspark.llm.words import parts_of_words, utf8

#: Documents of a block; blocks that a task orders by bound at a time; terms of a group of queries.
BLOCK, HELD, GROUP_TERMS = 128, 256, 1 << 18
_EXACT = 2**62

INDEX = "block long, ids array<long>, lengths binary, sizes binary, terms binary, counts binary"
_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("lengths", "sizes", "terms", "counts")]])


def _counted(text: bytes | None) -> Counter:
    found: Counter = Counter()
    for part in parts_of_words(text or b""):
        found.update(part)
    return found


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks (columns of INDEX) of doc_id and text: number of all terms of each document, and places and counts of its asked terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by GROUP_TERMS and the terms of one query

    def block(rows: list, number: int) -> pa.RecordBatch:
        sizes = np.array([len(r[2]) for r in rows], "<u4")
        terms, counts = (np.concatenate([r[k] for r in rows]) for k in (2, 3))
        values = [number, [r[0] for r in rows], np.array([r[1] for r in rows], "<i8").tobytes(), sizes.tobytes(), terms.astype("<u4").tobytes(), counts.astype("<i8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asked = TaskContext.get(), shared.value
        rows, number = [], (task.partitionId() if task else 0) << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                found = _counted(text)
                own = sorted((asked[t], n) for t, n in found.items() if t in asked)
                pairs = np.array(own, np.int64).reshape(-1, 2)
                rows.append((doc_id, found.total(), pairs[:, 0], pairs[:, 1]))
                if len(rows) == BLOCK:
                    yield block(rows, number)
                    rows, number = [], number + 1
        if rows:
            yield block(rows, number)

    return docs.mapInArrow(run, INDEX)


class _Block:
    """A block read back: impacts of its postings in document order, and per-term maxima."""

    def __init__(self, row: dict, all_docs: int, all_terms: int):
        self.ids = row["ids"]
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.terms = np.frombuffer(row["terms"], "<u4").astype(np.int64)
        tf = np.frombuffer(row["counts"], "<i8")
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        m = 25 + 75 * self.lengths * all_docs // max(all_terms, 1)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.of])
        order = np.argsort(self.terms, kind="stable")
        starts = np.flatnonzero(np.diff(self.terms[order], prepend=-1))
        self.asked = self.terms[order][starts]
        self.most = np.maximum.reduceat(self.impact[order], starts) if len(starts) else np.empty(0, np.int64)

    def scores(self, weight: np.ndarray) -> np.ndarray:
        """Score of every document, for a query's weights by term; whole numbers of 64 bits."""
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.of, weight[self.terms] * self.impact)
        return out


def _order(ids: list, scores: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Best first: score, then doc_id (null last), then place in the block."""
    key = np.array([i is None for i in ids]), np.array([0 if i is None else i for i in ids], np.int64)
    return np.lexsort((places, key[1], key[0], -scores))


class _Search:
    """Queries against the blocks of one task. ``queries``: number -> (terms, weights); ``floors``: number -> score that is surely reached."""

    def __init__(self, queries: dict, terms: int, k: int, stats: tuple[int, int], floors: dict[int, int]):
        self.queries, self.k, self.stats, self.floors = queries, k, stats, floors
        self.width = terms
        self.best: dict[int, list] = {q: [] for q in queries}  # (score, doc_id, block, place), best first

    def floor(self, q: int) -> int:
        held = self.best[q]
        return max(self.floors.get(q, 1), held[-1][0] if len(held) == self.k else 1)

    def take(self, q: int, block: _Block, number: int, weight: np.ndarray) -> None:
        scores = block.scores(weight)
        at = np.flatnonzero(scores >= self.floor(q))
        at = at[_order([block.ids[i] for i in at], scores[at], at)][: self.k]
        rows = self.best[q] + [(int(scores[i]), block.ids[i], number, int(i)) for i in at]
        self.best[q] = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2], r[3]))[: self.k]

    def visit(self, rows: list[dict], only_first: bool) -> int:
        """Search some blocks; returns how many were scored, over all queries."""
        blocks = [_Block(r, *self.stats) for r in rows]
        most = np.zeros((self.width, len(blocks)), np.int64)
        for i, b in enumerate(blocks):
            most[b.asked, i] = b.most
        weight, scored = np.zeros(self.width, np.int64), 0
        for q, (terms, weights) in self.queries.items():
            bounds = weights @ most[terms]
            weight[terms] = weights
            for i in np.argsort(-bounds, kind="stable")[: 1 if only_first else None]:
                if bounds[i] < self.floor(q):
                    break
                self.take(q, blocks[i], rows[i]["block"], weight)
                scored += 1
            weight[terms] = 0
        return scored


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            if len(held) == HELD:
                yield held
                held = []
    if held:
        yield held


def query_terms(queries: DataFrame, item: str) -> DataFrame:
    """q (a number of its own), item and the query's distinct terms with counts, for rows of ``queries`` that have terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(_counted(t).items()) for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.binary())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int64()))], names=["q", "item", "terms", "counts"])

    numbered = queries.select(F.monotonically_increasing_id().alias("q"), F.col(item).cast("long").alias("item"), "text")
    return store(numbered.mapInArrow(run, "q long, item long, terms array<binary>, counts array<long>").where(F.size("terms") > 0), "queries")


def _search_group(docs: DataFrame, asked: list, k: int) -> DataFrame:
    """q, doc_id, score, block and place of each task's best rows for a group of queries."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in asked for t in r.terms}))}
    index = store(forward_index(docs, vocabulary), "forward")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        # terms -1 and -2: documents with terms, and all terms
        df, docs_n, terms_n = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for row in batch.select(["lengths", "terms"]).to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i8")
                docs_n, terms_n = docs_n + int((lengths > 0).sum()), terms_n + int(lengths.sum())
                df += np.bincount(np.frombuffer(row["terms"], "<u4"), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"term": np.concatenate([[-1, -2], some]).astype(np.int64), "n": np.concatenate([[docs_n, terms_n], df[some]]).astype(np.int64)}), preserve_index=False)

    totals = dict(map(tuple, index.mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n")).collect()))  # a row for each term of the group
    n, length = totals.get(-1, 0), totals.get(-2, 0)
    queries, top = {}, 0
    for r in asked:
        at = np.array([vocabulary[bytes(t)] for t in r.terms], np.int64)
        weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * totals.get(int(t), 0) + 1))) * c for t, c in zip(at, r.counts, strict=True)]
        queries[r.q], top = (at, np.array(weights, np.int64)), max(top, sum(weights))
    if top * 1_000_000 > _EXACT:
        raise ValueError("a query's scores may exceed 64 bits")
    shared = spark.sparkContext.broadcast(queries)
    width, stats = len(vocabulary), (n, length)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        search = _Search(shared.value, width, k, stats, {})
        for rows in _rows(batches):
            search.visit(rows, True)
        full = [(q, held[-1][0]) for q, held in search.best.items() if len(held) == k]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in full], pa.int64()) for i in (0, 1)], names=["q", "score"])

    floors = dict(map(tuple, index.mapInArrow(seed, "q long, score long").groupBy("q").agg(F.max("score")).collect()))  # a number for each query of the group

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(shared.value, width, k, stats, floors)
        for rows in _rows(batches):
            search.visit(rows, False)
        found = [(q, *r) for q, held in search.best.items() for r in held]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(5)], names=["q", "score", "doc_id", "block", "place"])

    out = store(index.mapInArrow(best, "q long, score long, doc_id long, block long, place long"), "found")
    discard(index)
    return out


def search(docs: DataFrame, queries: DataFrame, item: str = "item_id", k: int = 10, group_terms: int = GROUP_TERMS) -> DataFrame:
    """``item``, rank, doc_id and score of the ``k`` best rows of ``docs`` (doc_id, text) for every row of ``queries`` (``item``, text).

    Scores are whole numbers and above 0; ties go to the smaller doc_id (null last), then to the stored order. Null and empty texts
    have no terms: such documents are not found and do not count, such queries give no rows. Repeated rows, of either table, are rows
    of their own, each repeated query with ranks of its own. Empty tables: no rows. Other columns are not read.
    ``docs`` is read once for each group of queries with about ``group_terms`` terms.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    asked = query_terms(queries, item)
    groups = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // group_terms))
    found = None
    for g in range(groups):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == g).collect()  # about group_terms terms
        if part:
            more = _search_group(rows, part, k)
            found = more if found is None else found.unionByName(more)
    if found is None:
        return asked.select(F.col("item").alias(item), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).join(asked.select("q", "item"), "q").select(F.col("item").alias(item), "rank", "doc_id", "score")


ORACLE = r"""
    WITH texts AS (
      SELECT 0 AS corpus, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
    terms AS (
      SELECT corpus, r, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
    tf AS (SELECT corpus, r, id, term, count(*) AS tf FROM terms GROUP BY ALL),
    lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM tf WHERE corpus = 0 GROUP BY r),
    total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
    weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total WHERE corpus = 0 GROUP BY term, docs),
    scores AS (
      SELECT q.r AS q, q.id AS item_id, d.r, d.id AS doc_id, sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
      FROM tf q JOIN tf d ON q.term = d.term AND q.corpus = 1 AND d.corpus = 0 JOIN weights ON weights.term = d.term JOIN lengths ON lengths.r = d.r, total GROUP BY ALL)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""
