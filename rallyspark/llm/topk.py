"""Exact top-k by inner product with block-at-a-time pruning.

Vectors and queries are dealt to a grid of bounded cells. In a cell, vectors are ordered so that alike ones stand together and cut
into ranges (blocks); a block has a forward index (its vectors) and the largest and least value of every component. A query's bound
for a block sums, over its components, the larger of the products with those two. Each query visits blocks from the largest bound
down and stops when a bound falls below its k-th score. The cells' lists, at most k rows for each query, are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallyspark.llm.common import store

SCALE = 1024
BLOCK = 64
#: Vectors of a cell: between these, a 64th of the table in the middle. Queries of a cell.
CELL = (1024, 65536)
QUERIES = 16384
_EXACT = 2.0**53


def quantised(df: DataFrame, key: str, vector: str) -> DataFrame:
    """row, key and ``floor(1024 * component)`` of the vectors without null or non-finite components; rows with a null key go."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(sound)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.transform(x, lambda c: F.floor(c * SCALE).cast("double")).alias("v"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; beyond the range where doubles are exact, whole numbers clipped to 64 bits."""
    if exact:
        return a @ b.T
    whole = a.astype(object) @ b.T.astype(object)
    return np.clip(whole, -(2**63), 2**63 - 1)


def search_cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int, block: int = BLOCK) -> pd.DataFrame:
    """The k best rows of a cell for each query (columns row, key, v): larger score first, then smaller key, then row."""
    columns = ["query_row", "query_id", "row", "vec_id", "score"]
    if queries.empty or rows.empty:
        return pd.DataFrame(columns=columns).astype("int64")
    width = max(queries["v"].map(len).max(), rows["v"].map(len).max(), 1)
    q, x = _matrix(queries["v"], width), _matrix(rows["v"], width)
    exact = float(np.abs(q).max()) * float(np.abs(x).max()) * width < _EXACT
    # alike vectors stand together: the strongest component and its sign, then the next one
    strong = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :2]
    sign = np.take_along_axis(x, strong, 1) < 0
    order = np.lexsort((sign[:, -1], strong[:, -1], sign[:, 0], strong[:, 0]))
    x, key, row = x[order], rows["key"].to_numpy()[order], rows["row"].to_numpy()[order]
    starts = np.arange(0, len(x), block)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    bound = (_products(np.maximum(q, 0), high, exact) + _products(np.minimum(q, 0), low, exact)).astype(np.float64)
    if not exact:
        bound = np.nextafter(bound * (1 + np.sign(bound) * 1e-12), np.inf)
    visit = np.argsort(-bound, axis=1, kind="stable")
    own = queries["row"].to_numpy()
    n = len(q)
    best = np.full((n, k), np.iinfo(np.int64).min, np.int64)
    who, where = np.full((n, k), np.iinfo(np.int64).max, np.int64), np.full((n, k), -1, np.int64)
    full = np.zeros(n, np.int64)
    for step in range(len(starts)):
        at = visit[:, step]
        live = np.flatnonzero((full < k) | (bound[np.arange(n), at] >= best[:, -1]))
        if not len(live):
            break
        for b in np.unique(at[live]):
            asks = live[at[live] == b]
            part = slice(starts[b], starts[b] + block)
            score = _products(q[asks], x[part], exact).astype(np.int64)
            keys, places = np.broadcast_to(key[part], score.shape), np.broadcast_to(row[part], score.shape)
            mine = places == own[asks][:, None]
            all_s = np.concatenate([best[asks], np.where(mine, np.iinfo(np.int64).min, score)], 1)
            all_k = np.concatenate([who[asks], np.where(mine, np.iinfo(np.int64).max, keys)], 1)
            all_p = np.concatenate([where[asks], np.where(mine, -1, places)], 1)
            first = np.lexsort((all_p, all_k, -all_s.astype(np.float64) if exact else ~all_s, all_p < 0), axis=1)[:, :k]
            best[asks], who[asks], where[asks] = (np.take_along_axis(a, first, 1) for a in (all_s, all_k, all_p))
            full[asks] = (where[asks] >= 0).sum(1)
    some = where >= 0
    ask = np.repeat(np.arange(n), some.sum(1))
    return pd.DataFrame({"query_row": own[ask], "query_id": queries["key"].to_numpy()[ask], "row": where[some], "vec_id": who[some], "score": best[some]}, columns=columns)


def top_k(df: DataFrame, key: str, vector: str, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for every row whose key is divisible by ``every``.

    A row is its own query only once: repeated keys are rows like others and each repeated query is answered by itself. Vectors of
    unequal length are filled with zeros. Empty table: no rows. Cells hold at most 65536 vectors and about 16384 queries.
    """
    rows = store(quantised(df, key, vector), "vectors")
    counts = rows.agg(F.count(F.lit(1)), F.count_if(F.col("key") % every == 0)).first()
    size = min(max(CELL[0], counts[0] // 64), CELL[1])
    across, down = max(1, -(-counts[0] // size)), max(1, -(-counts[1] // QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # attributes of its own: both sides of the cogroup read one table
    held = own.withColumn("c", deal(across)).withColumn("d", span(down))
    asked = rows.where(F.col("key") % every == 0).withColumn("d", deal(down)).withColumn("c", span(across))
    schema = "query_row long, query_id long, row long, vec_id long, score long"
    found = asked.groupBy("c", "d").cogroup(held.groupBy("c", "d")).applyInPandas(lambda a, b: search_cell(a, b, k), schema)
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
