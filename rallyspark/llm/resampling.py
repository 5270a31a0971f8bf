"""Importance resampling towards a target corpus, by bucket-partitioned inverted postings.

Features are runs of one and two words, hashed into buckets. Every task turns its documents into blocks and each block's counts into
postings (bucket, document, count), ordered by bucket and cut into ranges of buckets. Postings of both corpora are shuffled by range,
and a range in turn by groups of input splits, so that a range holds many tasks' postings but no group grows with the corpus. There
each bucket's counts are summed, its gain follows from both corpora's counts, and each posting contributes its count times that gain
to its document; contributions are summed in the task by block and range, and a block's sums meet to give its documents' weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallyspark.llm.common import discard, store
from rallyspark.llm.words import parts_of_words, utf8

BUCKETS = 10_000
#: Ranges of buckets, and input splits whose postings of one range may stand in one group.
RANGES, SPLITS = 16, 16
WIDTH = -(-BUCKETS // RANGES)
#: A block ends at so many bytes of text or so many documents; places in a block take 16 bits.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 1 << 14

POSTINGS = "corpus int, block long, salt int, range int, n int, postings binary, sums array<long>, ids array<long>, words array<long>"
_ARROW = pa.schema([
    ("corpus", pa.int32()), ("block", pa.int64()), ("salt", pa.int32()), ("range", pa.int32()), ("n", pa.int32()), ("postings", pa.binary()),
    ("sums", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())),
])


def bucket_counts(text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words of a whole text; its buckets in ascending order and their counts."""
    total, words, last = np.zeros(BUCKETS, np.int64), 0, None
    for part in parts_of_words(text or b""):
        if not part:
            continue
        one = list(map(crc32, part))
        # the checksum of "a b" goes on from that of "a"
        before = [crc32(b" ", c) for c in (one[:-1] if last is None else [last, *one[:-1]])]
        two = list(map(crc32, part[1:] if last is None else part, before))
        last, words = one[-1], words + len(part)
        total += np.bincount(np.array(one + two, np.uint32) % np.uint32(BUCKETS), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return words, at, total[at]


def _packed(docs: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> bytes:
    """Postings of a range: how many each bucket has, steps of document places as two planes of bytes, counts in as few bytes as hold them."""
    steps = np.diff(docs, prepend=docs[:1] * 0).astype(np.uint16)
    kind = next(k for k in ("u1", "u2", "u4", "u8") if not len(counts) or counts.max() <= np.iinfo(k).max)
    planes = [sizes.astype("<u4").tobytes(), (steps & 255).astype("u1").tobytes(), (steps >> 8).astype("u1").tobytes(), counts.astype("<" + kind).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    sizes = np.frombuffer(raw, "<u4", WIDTH)
    n, at = int(sizes.sum()), 4 * WIDTH
    low, high = np.frombuffer(raw, "u1", n, at), np.frombuffer(raw, "u1", n, at + n)
    kind = f"<u{(len(raw) - at - 2 * n) // n}" if n else "u1"
    steps = low.astype(np.uint16) | high.astype(np.uint16) << np.uint16(8)
    return sizes, np.cumsum(steps, dtype=np.uint16), np.frombuffer(raw, kind, -1, at + 2 * n)


def _block(rows: list, corpus: int, block: int, salt: int, postings: bool) -> pa.RecordBatch:
    """A block's rows: one for each range of buckets, and one (range -1) with ids and numbers of words."""
    buckets, counts = (np.concatenate([r[k] for r in rows]) for k in (2, 3))
    docs = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    order = np.argsort(buckets.astype(np.uint16), kind="stable")
    buckets, counts, docs = buckets[order], counts[order], docs[order]
    made = {name: [] for name in _ARROW.names}
    for r in range(RANGES):
        part = slice(*np.searchsorted(buckets, [r * WIDTH, (r + 1) * WIDTH]))
        own = buckets[part] - r * WIDTH
        sums = np.bincount(own, counts[part], WIDTH).astype(np.int64)
        packed = _packed(docs[part], counts[part], np.bincount(own, minlength=WIDTH)) if postings else None
        for name, value in zip(_ARROW.names, (corpus, block, salt, r, len(rows), packed, sums, None, None), strict=True):
            made[name].append(value)
    if postings:
        for name, value in zip(_ARROW.names, (corpus, block, salt, -1, len(rows), None, None, [r[0] for r in rows], [r[1] for r in rows]), strict=True):
            made[name].append(value)
    return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in _ARROW], schema=_ARROW)


def inverted(docs: DataFrame, corpus: int) -> DataFrame:
    """Blocks of postings (columns of POSTINGS) of doc_id and text; the target corpus (1) needs only its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        split = task.partitionId() if task else 0
        rows, size, made = [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                rows.append((doc_id, *bucket_counts(text)))
                size += len(text or b"")
                if size >= BLOCK_BYTES or len(rows) >= BLOCK_DOCS:
                    yield _block(rows, corpus, split << 32 | made, split // SPLITS, corpus == 0)
                    rows, size, made = [], 0, made + 1
        if rows:
            yield _block(rows, corpus, split << 32 | made, split // SPLITS, corpus == 0)

    return docs.mapInArrow(run, POSTINGS)


def gains(postings: DataFrame) -> DataFrame:
    """range and its buckets' gains, from the counts of both corpora that meet in each bucket."""
    counts = postings.where("range >= 0").select("corpus", "range", F.posexplode("sums").alias("place", "n"))
    of = lambda corpus: F.sum(F.when(F.col("corpus") == corpus, F.col("n")).otherwise(0))
    by = counts.groupBy("range", "place").agg(of(0).alias("s"), of(1).alias("t"))
    # one row, and one for each of a fixed number of buckets
    both = by.crossJoin(F.broadcast(by.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))
    d = lambda c, more: F.col(c).cast("double") + more
    gain = F.floor(1000 * F.ln(d("t", 1) * d("all_s", BUCKETS) / (d("s", 1) * d("all_t", BUCKETS))))
    return both.groupBy("range").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", gain.alias("gain")))), lambda x: x["gain"]).alias("gains"))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (block, n, postings, gains, ids, words): each document's part of the sum, for the range at hand."""
    for batch in batches:
        parts = []
        for n, raw, gain in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            if raw is None:
                parts.append(None)
                continue
            sizes, docs, counts = _unpacked(raw)
            part = np.zeros(n, np.int64)
            np.add.at(part, docs, np.repeat(np.array(gain, np.int64), sizes) * counts.astype(np.int64))
            parts.append(part)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.int64())), batch.column(4).cast(pa.list_(pa.int64())), batch.column(5).cast(pa.list_(pa.int64()))], names=["block", "part", "ids", "words"])


def _weights(block: pa.Table) -> pa.Table:
    """A block's documents from its contributions of all ranges."""
    head = next(r for r in block.to_pylist() if r["ids"] is not None)
    words = np.array(head["words"], np.int64)
    features = np.maximum(2 * words - 1, 0)
    total = np.zeros(len(words), np.int64)
    for part in block.column("part").to_pylist():
        if part is not None:
            total += np.array(part, np.int64)
    weight = np.where(features > 0, total // np.maximum(features, 1), 0)
    return pa.table({"doc_id": pa.array(head["ids"], pa.int64()), "n_words": words, "n_features": features, "weight": weight})


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of ``docs`` (doc_id, text) against the texts of ``target``.

    Null and empty texts have no features and weight 0. Repeated rows count, and are weighed, as often as they occur; equal doc_ids
    are rows like others. An empty corpus or target gives gains from zero counts; empty ``docs`` give no rows. Other columns are not
    read. ``docs`` should be a table or another input that gives the same rows in the same order when a lost task runs again.
    """
    both = inverted(docs.select(F.col("doc_id").cast("long"), "text"), 0).unionByName(inverted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), 1))
    postings = store(both.repartition("range", "salt"), "postings")
    # at most RANGES rows of WIDTH numbers: broadcast whatever the corpus
    own = postings.where("corpus = 0").select("block", "n", "postings", "range", "ids", "words").join(F.broadcast(gains(postings)), "range", "left")
    parts = own.select("block", "n", "postings", "gains", "ids", "words").mapInArrow(_contributions, "block long, part array<long>, ids array<long>, words array<long>")
    out = store(parts.groupBy("block").applyInArrow(_weights, "doc_id long, n_words long, n_features long, weight long"), "weights")
    discard(postings)
    return out


def uniform(seed: int, doc_id: Column) -> Column:
    """Double between 0 and 1 from the first 32 bits of sha256(``seed:doc_id``); a null id is the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Add ``name``, the place from 1 of every row of a whole table in ``order``, which must tell all rows apart.

    Rows are dealt to ranges of the order; the ranges' sizes (one number each) give where each begins.
    """
    spark = df.sparkSession
    ranged = store(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    starts, before = [], 0
    for part, n in sorted(tuple(r) for r in ranged.groupBy("_part").count().collect()):  # a row for each shuffle partition
        starts.append((part, before))
        before += n
    begins = spark.createDataFrame(starts, "_part int, _before long")
    rank = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(begins), "_part").withColumn(name, rank + F.col("_before")).drop("_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, min_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; ``percent`` of the rows with ``min_words`` words or more are drawn.

    The score is the weight plus Gumbel noise from ``seed`` and doc_id, so that the best scores are a draw without replacement in
    proportion to the weights. Ties go to the smaller doc_id (null last), then to more features, then to the stored order. Rows that
    are not drawn have no rank. Cases of nulls, repeats and empty tables: see ``weights``.
    """
    noise = F.floor(-1000 * F.ln(-F.ln(uniform(seed, F.col("doc_id")))))
    scored = store(weights(docs, target).withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= min_words
    drawn = scored.where(able).count() * percent // 100
    placed = numbered(scored.where(able), "_place", F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.col("_row"))
    ranked = placed.withColumn("rank", F.when(F.col("_place") <= drawn, F.col("_place")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))


#: The checksum of a feature is computed in SQL from a table of 256 remainders, itself made by the rule; each distinct feature once.
ORACLE = r"""
    WITH crc AS (SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS r),
    texts AS (
      SELECT 0 AS corpus, row_number() OVER () AS d, doc_id, text FROM documents
      UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
    worded AS (
      SELECT corpus, d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
    features AS (
      SELECT corpus, d, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded),
    counted AS (SELECT corpus, d, f, count(*) AS n FROM features GROUP BY ALL),
    sums AS (
      SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hex(f)) // 2), lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
      FROM (SELECT DISTINCT f FROM counted), crc),
    placed AS (SELECT corpus, d, b, sum(n)::BIGINT AS n FROM counted JOIN sums USING (f) GROUP BY ALL),
    per AS (SELECT b, coalesce(sum(n) FILTER (corpus = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (corpus = 1), 0)::DOUBLE AS t FROM placed GROUP BY b),
    gain AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM per) + 10000) / ((s + 1) * ((SELECT sum(t) FROM per) + 10000))))::BIGINT AS g FROM per),
    weighed AS (SELECT d, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM placed JOIN gain USING (b) WHERE corpus = 0 GROUP BY d),
    scored AS (
      SELECT d, doc_id, len(w) AS words, greatest(2 * len(w) - 1, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM worded LEFT JOIN weighed USING (d) WHERE corpus = 0),
    drawn AS (SELECT d, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM drawn) THEN place END::BIGINT AS rank FROM scored LEFT JOIN drawn USING (d)"""
