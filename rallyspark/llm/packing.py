"""Hierarchical multi-length packing of token streams.

Every task packs the rows it reads, chunk by chunk, so nothing is shuffled and no group can grow hot. Whole windows of the
longest tier are cut first; what remains of a document goes to the shortest tier that holds it. Tiers are packed from the longest:
a window opens with its tier's longest rest, takes the longest rests of shorter tiers that fit, and closes its last gap with a cut
piece of a shorter rest. Rests that cannot fill a window wait for the next chunk; a task's last rests are cut to powers of two.
Sequences of a chunk are dealt to step groups of nearly equal token counts, longest first to the least loaded.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyspark.llm.common import key, text_of, with_key, work_for
from rallyspark.llm.tokens import CACHE_WORDS, WordIds, word_ids

TIERS = (512, 1024, 2048, 4096)
END = 2
#: Tokens of a chunk, and of a step group.
CHUNK = 1 << 20
STEP = 1 << 16
COLUMNS = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

#: A piece: document's number in the pool, start, length.
Piece = tuple[int, int, int]


class Tiers:
    """Rests of documents by tier, each tier sorted by length."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.sums = tiers, [0] * len(tiers)
        self.rests: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (length, document, start)

    def add(self, doc: int, start: int, length: int) -> None:
        if length:
            tier = next(i for i, t in enumerate(self.tiers) if length <= t)
            insort(self.rests[tier], (length, doc, start))
            self.sums[tier] += length

    def tokens(self, upto: int) -> int:
        return sum(self.sums[:upto])

    def _pop(self, tier: int, i: int) -> tuple[int, int, int]:
        rest = self.rests[tier].pop(i)
        self.sums[tier] -= rest[0]
        return rest

    def _take(self, upto: int, most: int) -> tuple[int, int, int] | None:
        """The longest rest of at most ``most`` tokens in the tiers below ``upto``."""
        for tier in range(upto - 1, -1, -1):
            if i := bisect_left(self.rests[tier], (most + 1,)):
                return self._pop(tier, i - 1)
        return None

    def _cut(self, upto: int, size: int) -> tuple[int, int, int] | None:
        """A piece of exactly ``size`` tokens from the shortest rest that is longer."""
        for tier in range(upto):
            i = bisect_left(self.rests[tier], (size + 1,))
            if i < len(self.rests[tier]):
                length, doc, start = self._pop(tier, i)
                self.add(doc, start + size, length - size)
                return size, doc, start
        return None

    def windows(self, final: bool) -> Iterator[tuple[int, list[Piece]]]:
        """Full windows, tier by tier; with ``final`` also windows of lesser powers of two until nothing remains."""
        for level in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[level]
            while self.rests[level] and self.tokens(level + 1) >= size:
                yield size, self._fill(level, size)
        while final and (left := self.tokens(len(self.tiers))):
            size = min(1 << (left.bit_length() - 1), self.tiers[-1])
            yield size, self._fill(len(self.tiers) - 1, size)

    def _fill(self, level: int, size: int) -> list[Piece]:
        pieces, gap = [], size
        while gap:
            got = self._take(level + 1, gap) or self._cut(level + 1, gap)
            pieces.append((got[1], got[2], got[0]))
            gap -= got[0]
        return pieces


def step_groups(sizes: list[int], step: int = STEP) -> list[int]:
    """A step group for each sequence: longest first to the least loaded of ceil(tokens / step) groups."""
    loads = [(0, g) for g in range(max(1, -(-sum(sizes) // step)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(loads)
        out[i] = g
        heapq.heappush(loads, (load + sizes[i], g))
    return out


def _encoded(batch: pd.DataFrame, encoder: WordIds, rows: int = 500) -> Iterator[tuple[str | None, np.ndarray]]:
    for i in range(0, len(batch), rows):
        part = batch.iloc[i : i + rows]
        for doc_id, ids in zip(part["doc_id"], encoder.ids(part["text"].tolist()), strict=True):
            yield doc_id, np.append(ids, np.uint32(END)).astype("<u4")


def _packed(batches: Iterator[pd.DataFrame], path: str, tiers: tuple[int, ...], chunk: int, words: int = CACHE_WORDS) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    work_for("packing")
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 40
    encoder, pool, ids, docs = word_ids(path, words), Tiers(tiers), {}, {}
    sequence, group, held, count = 0, 0, 0, 0
    longest = tiers[-1]

    def emit(windows: list[tuple[int, list[Piece]]]) -> pd.DataFrame:
        nonlocal sequence, group
        rows, groups = [], step_groups([w[0] for w in windows])
        for (size, pieces), g in zip(windows, groups, strict=True):
            offset = 0
            for doc, start, length in pieces:
                part = ids[doc][start : start + length]
                rows.append((docs[doc][0], start, length, zlib.crc32(part.tobytes()), len(ids[doc]), base + sequence, offset, size, base + group + g))
                docs[doc][1] -= length
                offset += length
                if not docs[doc][1]:
                    del docs[doc], ids[doc]
            sequence += 1
        group += max(groups, default=-1) + 1
        return pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    ready: list[tuple[int, list[Piece]]] = []
    for batch in batches:
        for doc_id, own in _encoded(batch, encoder):
            ids[count], docs[count] = own, [doc_id, len(own)]
            whole = len(own) // longest * longest
            ready += [(longest, [(count, at, longest)]) for at in range(0, whole, longest)]
            pool.add(count, whole, len(own) - whole)
            count += 1
            held += len(own)
            if held >= chunk:
                yield emit(ready + list(pool.windows(False)))
                ready, held = [], 0
    if count:
        yield emit(ready + list(pool.windows(True)))


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, chunk: int = CHUNK, words: int = CACHE_WORDS) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence, the sequence's tier and its step group.

    Null and empty texts hold the end id alone. Null doc_ids and repeated rows are packed like others, each row by itself. Every
    sequence is full: a power of two of at most the longest tier. Empty table: no rows. Memory: one chunk, one document's ids and
    a cache of ``words`` words in each Python worker; ids do not depend on it.
    """
    if any(a >= b for a, b in zip(tiers, tiers[1:], strict=False)) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are rising powers of two")
    rows = docs.select(key(), text_of().alias("text"))
    return with_key(rows.mapInPandas(lambda batches: _packed(batches, path, tiers, chunk, words), COLUMNS))
