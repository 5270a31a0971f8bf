"""Encoding and decoding with a merge-pair piece model by vectorised merge rounds.

A piece table is read from the model file. Words start where a space follows other characters (no piece spans such a place), and
are cut further wherever no piece holds the two neighbouring characters together. All new words of a batch form one flat array of
symbols: each round finds the least pair rank of every segment, merges its leftmost non-overlapping occurrences at once and
compacts the array, until no pair remains. Where a merged piece could outrank its own rank with a neighbour, only the leftmost
occurrence is merged in that round, which keeps the order of the sequential rule. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyspark.llm.common import dropped_by, key, text_of, with_key, work_for
from rallyspark.llm.tokens import WordCache

SPACE = "▁"
_NONE = np.int64(1) << 40
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = model.vocab_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        names, kinds = [model.id_to_piece(i) for i in range(n)], [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.bytes_at = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        plain = {names[i]: i for i in range(n) if not kinds[i]}
        _, ranks = np.unique([-model.get_score(i) for i in range(n)], return_inverse=True)
        self.rank = ranks.astype(np.int64)
        # pairs of pieces that make a piece, and pieces that a neighbour could draw into a piece of better rank
        pairs, self.eager = {}, np.zeros(n, bool)
        for name, i in plain.items():
            for cut in range(1, len(name)):
                a, b = plain.get(name[:cut]), plain.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
                for x in (a, b):
                    if x is not None and self.rank[i] <= self.rank[x]:
                        self.eager[x] = True
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_piece = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.char_piece = np.full(0x110000, -1, np.int64)
        for name, i in plain.items():
            if len(name) == 1:
                self.char_piece[ord(name)] = i
        together = {ord(x) << 21 | ord(y) for name in plain for x, y in zip(name, name[1:], strict=False)}
        self.together = np.array(sorted(together), np.int64)
        # decoding: bytes of every piece; control pieces have none
        raw = [b"" if kinds[i] else names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.bytes_at.tolist()):
            raw[i] = bytes([b])
        for i in range(n):
            if model.is_unknown(i):
                raw[i] = " ⁇ ".encode()
        self.piece_len = np.array(list(map(len, raw)), np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_raw = np.frombuffer(b"".join(raw), np.uint8)
        self.words = WordCache(self._split, self._learn)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key, -1 where there is none."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return np.where(keys[at] == wanted, at, -1)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._find(self.pair_keys, np.where((left < 0) | (right < 0), -1, left * self.size + right))
        piece = np.where(at < 0, -1, self.pair_piece[at]) if len(self.pair_keys) else at
        return piece, np.where(piece < 0, _NONE, self.rank[piece])

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (spaces already marked)."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array(list(map(len, words)), np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        symbol = self.char_piece[points]
        symbol = np.where(symbol < 0, -1 - points, symbol)  # no piece: kept as a negative code point
        cut = np.ones(len(points), bool)
        cut[1:] = (word[1:] != word[:-1]) | (self._find(self.together, points[:-1] << 21 | points[1:]) < 0)
        segment = np.cumsum(cut) - 1
        place = np.arange(len(points))  # order of the final symbols
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, piece = np.full(len(points), _NONE), np.full(len(points), -1, np.int64)
        fresh = np.ones(len(points), bool)
        while len(symbol):
            at = np.flatnonzero(fresh[:-1] | fresh[1:]) if len(symbol) > 1 else np.empty(0, np.int64)
            rank[-1], piece[-1] = _NONE, -1
            if len(at):
                piece[at], rank[at] = self._pair(symbol[at], symbol[at + 1])
                apart = at[segment[at] != segment[at + 1]]
                piece[apart], rank[apart] = -1, _NONE
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbol)])
            live = np.repeat(best < _NONE, lengths)
            if not live.all():
                done.append((place[~live], word[~live], symbol[~live]))
                symbol, segment, word, place, rank, piece = (x[live] for x in (symbol, segment, word, place, rank, piece))
                if not len(symbol):
                    break
                keep = best < _NONE
                best, lengths = best[keep], lengths[keep]
                starts = np.r_[0, np.cumsum(lengths)[:-1]]
            hit = rank == np.repeat(best, lengths)
            # of touching hits every second one is taken, from the left
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit, -1, np.arange(len(hit)))) - 1
            hit &= run % 2 == 0
            eager = hit & self.eager[np.maximum(piece, 0)]
            if eager.any():  # only the first hit of its segment
                order = np.cumsum(hit) - np.repeat((np.cumsum(hit) - hit)[starts], lengths)
                hit &= ~np.repeat(np.logical_or.reduceat(eager, starts), lengths) | (order == 1)
            symbol = np.where(hit, piece, symbol)
            keep = np.r_[True, ~hit[:-1]]
            fresh = hit[keep]
            symbol, segment, word, place, rank, piece = (x[keep] for x in (symbol, segment, word, place, rank, piece))
        place, word, symbol = (np.concatenate([d[i] for d in done]) if done else np.empty(0, np.int64) for i in range(3))
        order = np.argsort(place)
        word, symbol = word[order], symbol[order]
        if (symbol < 0).any():
            word, symbol = self._spell(word, symbol)
        ends = np.searchsorted(word, np.arange(len(words) + 1))
        return [symbol[ends[i] : ends[i + 1]] for i in range(len(words))]

    def _spell(self, word: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces for the characters without a piece."""
        raw = [[int(s)] if s >= 0 else self.bytes_at[np.frombuffer(chr(-1 - int(s)).encode(), np.uint8)].tolist() for s in symbol]
        return np.repeat(word, list(map(len, raw))), np.array([x for r in raw for x in r], np.int64)

    def _split(self, part: str, first: bool) -> list[str]:
        return _WORD.findall((SPACE if first and part else "") + part.replace(" ", SPACE))

    def _learn(self, words: list[str], step: int = 20_000) -> dict[str, bytes]:
        out = {}
        for i in range(0, len(words), step):
            some = words[i : i + step]
            out.update((w, x.astype("<u4").tobytes()) for w, x in zip(some, self.merge(some), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with begin and end ids."""
        begin, end = (np.array([x], "<u4").tobytes() for x in (self.begin, self.end))
        return [np.frombuffer(begin + x + end, "<u4") for x in self.words.encode(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text in UTF-8: bytes of all pieces without the mark before the first; bytes that are no text become U+FFFD."""
        n = self.piece_len[ids]
        total = int(n.sum())
        at = np.repeat(self.piece_at[ids] - (np.cumsum(n) - n), n) + np.arange(total)
        raw = self.piece_raw[at].tobytes()
        raw = raw[1:] if raw[:1] == b" " else raw
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


dropped_by(piece_model.cache_clear)


def _coded(batches: Iterator[pd.DataFrame], path: str, rows: int = 500) -> Iterator[pd.DataFrame]:
    work_for("pieces")
    model = piece_model(path)
    for batch in batches:
        for i in range(0, len(batch), rows):
            part = batch.iloc[i : i + rows]
            ids = model.encode(part["text"].tolist())
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "ids": [i.tobytes() for i in ids], "n_tokens": list(map(len, ids)), "decoded": [model.decode(i).decode() for i in ids]})


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens and the text decoded from them, for every row.

    Null and empty texts: the begin and end ids, decoded as the empty text. Rows are independent: null ids and repeats stay.
    """
    rows = docs.select(key(), text_of().alias("text"))
    return with_key(rows.mapInPandas(lambda batches: _coded(batches, path), "doc_id string, ids binary, n_tokens long, decoded string"))


def _digests(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    for batch in _coded(batches, path):
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": batch["n_tokens"], "ids_sha256": [sha(x) for x in batch["ids"]], "decoded_sha256": [sha(x.encode()) for x in batch["decoded"]]})


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_decode``, with digests of ids and decoded text made in the same task."""
    rows = docs.select(key(), text_of().alias("text"))
    return with_key(rows.mapInPandas(lambda batches: _digests(batches, path), "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"))
