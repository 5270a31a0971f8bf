"""Token ids of whole texts through bounded caches of words."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from rallyspark.llm.common import dropped_by, slices

#: Words held at once in a worker (about 65 MB with what they stand for), and the longest word that is held.
CACHE_WORDS = 400_000
CACHE_CHARS = 16


def runs(texts: list[str], size: int = 1 << 20) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of (text's number, part's number, part) with about ``size`` characters."""
    out, held = [], 0
    for i, text in enumerate(texts):
        for j, part in enumerate(slices(text)):
            out.append((i, j, part))
            held += len(part)
            if held >= size:
                yield out
                out, held = [], 0
    if out:
        yield out


class WordCache:
    """Bytes of each word by a dictionary; a run's new words are learnt in one call."""

    def __init__(self, split: Callable[[str, bool], list[str]], learn: Callable[[list[str]], dict[str, bytes]], limit: int = CACHE_WORDS):
        self.split, self.learn, self.held, self.limit = split, learn, {}, limit

    def encode(self, texts: list[str]) -> list[bytes]:
        parts: list[list[bytes]] = [[] for _ in texts]
        held = self.held
        for run in runs(texts):
            lists = [self.split(part, j == 0) for _, j, part in run]
            seen = set().union(*lists)
            new = seen.difference(held)
            if len(held) + len(new) > self.limit:  # the words in use now stay, among them the frequent ones
                kept = {w: held[w] for w in seen if w in held}
                held.clear()
                held.update(kept)
            held.update(self.learn(list(new)))
            for (i, _, _), words in zip(run, lists, strict=True):
                parts[i].append(b"".join(map(held.__getitem__, words)))
            for w in new:
                if len(w) > CACHE_CHARS:
                    del held[w]
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]


#: Texts outside these are not lower-cased before the tokenizer does so itself.
_ODD = re.compile("[^\x00-įı-ſ]")
#: A word of letters with punctuation behind, which the tokenizer parts there.
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,!?;:&%$*#|]*)")
_SAMPLE = ["the", "the,", "haus!!", "été.", "niño|", "straße", "überall***", "a", "zzzz", "çaàéè;"]


class _Spelling(dict):
    """Characters as the byte-level alphabet writes them, for str.translate."""

    def __missing__(self, point: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        self[point] = found = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(point))[0][0]
        return found


class WordIds:
    """Ids of a tokenizer that never merges across a space or a line feed and folds case: each such part is encoded by itself."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.cores: dict[str, bytes] = {}
        self.spelt, self.model = _Spelling(), self.tokenizer.model
        self.words, self.limit = WordCache(self._split, self._learn, limit), limit
        self.quick = True
        self.quick = all(self._quickly([w]) == self._slowly([w]) for w in _SAMPLE)

    def _split(self, part: str, first: bool) -> list[str]:
        if "<|" not in part and (part.isascii() or not _ODD.search(part)):
            part = part.lower()
        return part.replace("\n", " ").split(" ")

    def _slowly(self, words: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch(words, add_special_tokens=False)
        return {w: np.array(e.ids, self.dtype).tobytes() for w, e in zip(words, found, strict=True)}

    def _core(self, core: str) -> bytes:
        """Ids of letters, or of punctuation, by the tokenizer's model alone."""
        found = self.cores.get(core)
        if found is None:
            spelt = core if core.isascii() else core.translate(self.spelt)
            found = np.array([t.id for t in self.model.tokenize(spelt)], self.dtype).tobytes()
            if len(self.cores) > self.limit // 4:
                self.cores.clear()
            if len(core) <= CACHE_CHARS // 2:
                self.cores[core] = found
        return found

    def _quickly(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for w in words:
            if m := _PLAIN.fullmatch(w):
                core, tail = m.groups()
                out[w] = self._core(core) + (self._core(tail) if tail else b"")
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        out = self._quickly(words) if self.quick else {}
        rest = [w for w in words if w not in out]
        for i in range(0, len(rest), 10_000):
            out |= self._slowly(rest[i : i + 10_000])
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        return [np.frombuffer(x, self.dtype).astype("<u4") for x in self.words.encode(texts)]


@lru_cache(maxsize=2)
def word_ids(path: str, limit: int = CACHE_WORDS) -> WordIds:
    return WordIds(path, limit)


dropped_by(word_ids.cache_clear)
