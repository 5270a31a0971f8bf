"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's bytes (A-Z in lower case) are cut into windows of 256. Bytes are embedded, filters of widths 2, 3 and 4 run over each
window, every filter keeps its largest answer, and a softmax layer names the language. A document's distribution is the mean of its
windows' log-probabilities, weighted by their bytes. Training takes a bounded sample of labelled rows (at most ``SAMPLE`` for each
language and ``ROWS`` in all, up to ``WINDOWS`` windows spread over the whole text of each); prediction reads every window of every
text.

One class more than there are languages stands for what is none of them. Its windows are made from the sample: bytes of a window in
another order, letters drawn alike, and bytes drawn alike. It takes no part in naming a language; the filter of documents drops a
text where it is far likelier than all languages together, at any length (a short text's evidence counts less, so it stays in doubt).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallyspark.llm.common import work_for

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 6
#: Sample that is fitted: most documents of a language, most documents of all languages (a language has one at least, so with more
#: languages than this the rarest are not learnt), and windows of each document.
SAMPLE = 300
ROWS = 19_200
WINDOWS = 6
EPOCHS = 12
UNKNOWN = "und"
#: The class of texts in no language; no language's name, since it has a line feed.
NOISE = "\nnoise"
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPAN = max(WIDTHS)


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of WINDOW bytes, zero-filled, each with the next window's first bytes behind it; and the bytes of each."""
    x = _LOWER[np.frombuffer(raw, np.uint8)]
    n = max(1, -(-len(x) // WINDOW))
    padded = np.zeros(n * WINDOW + _SPAN - 1, np.uint8)
    padded[: len(x)] = x
    rows = np.lib.stride_tricks.as_strided(padded, (n, WINDOW + _SPAN - 1), (WINDOW, 1))
    return rows, np.minimum(WINDOW, np.maximum(1, len(x) - np.arange(n) * WINDOW))


def has_letter(text: str) -> bool:
    """Whether any character is a letter by Unicode; number signs such as those of fractions and Roman numerals are none."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


@dataclass
class Network:
    classes: list[str]
    embed: np.ndarray  # 256, EMBED
    filters: np.ndarray  # _SPAN * EMBED, filters of all widths; zero beyond a filter's width
    bias: np.ndarray
    dense: np.ndarray  # filters, classes
    dense_bias: np.ndarray

    def _columns(self, rows: np.ndarray) -> np.ndarray:
        e = self.embed[rows]  # n, WINDOW + _SPAN - 1, EMBED
        return np.concatenate([e[:, j : j + WINDOW] for j in range(_SPAN)], 2).reshape(-1, _SPAN * EMBED)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum((self._columns(rows) @ self.filters).reshape(len(rows), WINDOW, -1).max(1) + self.bias, 0)

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        z = self.pooled(rows) @ self.dense + self.dense_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _mask() -> np.ndarray:
    """Which weights of each filter are in use: the first ``width`` bytes."""
    return np.concatenate([np.repeat((np.arange(_SPAN) < w)[:, None], EMBED, 0)[:, [0] * FILTERS] for w in WIDTHS], 1).astype(np.float32)


def train(rows: np.ndarray, labels: np.ndarray, classes: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the softmax loss over sampled windows; deterministic for a given sample."""
    rng = np.random.default_rng(seed)
    mask, n_filters, k = _mask(), len(WIDTHS) * FILTERS, len(classes)
    p = [rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.3, mask.shape) * mask, np.zeros(n_filters), rng.normal(0, 0.3, (n_filters, k)), np.zeros(k)]
    p = [x.astype(np.float32) for x in p]
    m, v, t, batch = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0, 32
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            net = Network(classes, *p)
            columns = net._columns(rows[pick])
            answers = (columns @ p[1]).reshape(len(pick), WINDOW, -1)
            at = answers.argmax(1)
            top = np.take_along_axis(answers, at[:, None], 1)[:, 0] + p[2]
            pooled = np.maximum(top, 0)
            z = pooled @ p[3] + p[4]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(pick)), labels[pick]] -= 1
            z /= len(pick)
            d_top = (z @ p[3].T) * (top > 0)
            spots = (np.arange(len(pick))[:, None] * WINDOW + at).ravel()
            d_filters = np.einsum("ifd,if->df", columns[spots].reshape(len(pick), n_filters, -1), d_top) * mask
            d_columns = (d_top[:, :, None] * p[1].T[None]).reshape(-1, _SPAN, EMBED)
            d_embed = np.zeros_like(p[0])
            byte = np.take_along_axis(rows[pick], (at[:, :, None] + np.arange(_SPAN)).reshape(len(pick), -1), 1)
            np.add.at(d_embed, byte.ravel(), d_columns.reshape(-1, EMBED))
            grads = [d_embed, d_filters, d_top.sum(0), pooled.T @ z, z.sum(0)]
            t += 1
            rate = 0.01 * (1 - epoch / epochs)
            for x, g, a, b in zip(p, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-7)
    return Network(classes, *p)


def noise(rows: np.ndarray, seed: int = 11) -> np.ndarray:
    """Windows in no language, as long as those of ``rows``: of each four, two with their bytes in another order, one of letters drawn alike, one of bytes drawn alike."""
    rng, out = np.random.default_rng(seed), np.zeros_like(rows)
    for i, row in enumerate(rows):
        own = row[: np.flatnonzero(row)[-1] + 1] if row.any() else row[:1]
        if i % 4 < 2:
            out[i, : len(own)] = rng.permutation(own)
        else:
            out[i, : len(own)] = rng.integers(97, 123, len(own)) if i % 4 == 2 else rng.integers(1, 256, len(own))
    return out


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            rows, _ = windows(text.encode())
            for i in sorted({len(rows) * j // WINDOWS for j in range(WINDOWS)}):
                out.append((lang, rows[i].tobytes()))
        yield pd.DataFrame(out, columns=["lang", "window"])


def fit(labelled: DataFrame) -> Network | None:
    """A network from rows (doc_id, text, lang); None where no row has both text and lang.

    Every language is learnt, from its rows with the least hash of doc_id and length: SAMPLE of them, or fewer where there are so many
    languages that ROWS would be exceeded. Rows with one hash count once, so repeated and null ids do not add to what the driver gets.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", F.octet_length("text")).alias("h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(ROWS).collect()  # bounded: ROWS
    if not counts:
        return None
    each = max(1, min(SAMPLE, ROWS // len(counts)))
    sized = labelled.sparkSession.createDataFrame([(r["lang"], r["rows"]) for r in counts], "lang string, rows long")
    # a share of each language that is expected to hold four times what is taken is ranked, a row for each hash; all of it where rows repeat
    place = F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20))
    near = rows.select("lang", "h").join(F.broadcast(sized), "lang").where((place * F.col("rows") < 4 * max(each, 16))).select("lang", "h").distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy(place, "h"))
    picked = near.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "h")
    texts = rows.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    found = texts.select("lang", "text").mapInPandas(_sampled, "lang string, window binary").toPandas()
    missing = [r["lang"] for r in counts if r["lang"] not in set(found["lang"])]
    if missing:  # languages of few different hashes, none of them near: a row of each
        wanted = sized.where(F.col("lang").isin(missing)).select("lang")
        more = rows.join(F.broadcast(wanted), "lang").groupBy("lang").agg(F.min("text").alias("text"))
        found = pd.concat([found, more.mapInPandas(_sampled, "lang string, window binary").toPandas()])
    found = found.sort_values(["lang", "window"], kind="stable")
    classes = sorted(found["lang"].unique())
    x = np.stack([np.frombuffer(w, np.uint8) for w in found["window"]])
    y = np.searchsorted(classes, found["lang"])
    fill = noise(x[:: max(1, min(len(classes), 8))])
    return train(np.concatenate([x, fill]), np.concatenate([y, np.full(len(fill), len(classes))]), [*classes, NOISE])


def predict(texts: pd.Series, net: Network | None) -> pd.DataFrame:
    """lang_pred, score and noise of each text, windows of many texts going through the network together.

    ``score`` is the named language's share among the languages, ``noise`` the share of texts in no language among all classes.
    """
    names, scores, noisy = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    queue: list[tuple[int, np.ndarray, np.ndarray]] = []
    totals: dict[int, tuple[np.ndarray, float]] = {}

    def flush():
        if not queue:
            return
        rows, sizes = np.concatenate([r for _, r, _ in queue]), np.concatenate([s for _, _, s in queue])
        logs = net.log_probabilities(rows) * sizes[:, None]
        at = 0
        for i, r, s in queue:
            old = totals.get(i, (0.0, 0.0))
            totals[i] = old[0] + logs[at : at + len(r)].sum(0, dtype=np.float64), old[1] + float(s.sum())
            at += len(r)
        queue.clear()

    held = 0
    for i, text in enumerate(texts):
        if net is None or text is None or not has_letter(text):
            continue
        rows, sizes = windows(text.encode())
        for j in range(0, len(rows), 256):
            part = rows[j : j + 256]
            queue.append((i, part, sizes[j : j + 256]))
            held += len(part)
            if held >= 256:
                flush()
                held = 0
    flush()
    for i, (logs, size) in totals.items():
        mean = logs / size * min(4.0, size / 64)
        p = np.exp(mean - mean.max())
        if net.classes[-1] == NOISE:
            noisy[i] = p[-1] / p.sum()
            p = np.exp(mean[:-1] - mean[:-1].max())
        p /= p.sum()
        names[i], scores[i] = net.classes[int(p.argmax())], float(p.max())
    return pd.DataFrame({"lang_pred": names, "score": scores, "noise": noisy}, index=texts.index)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predicted(net: Network | None):
    """A column function: text -> struct<lang_pred, score, noise>.

    Null texts, texts without a letter, and all texts where nothing could be learnt: ``und`` with score 0.
    """

    @F.pandas_udf("lang_pred string, score double, noise double")
    def run(texts: pd.Series) -> pd.DataFrame:
        work_for("langid")
        return predict(texts, net)

    return run


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row; rows are independent, so null and repeated ids do not matter."""
    return docs.select("doc_id", predicted(net)(F.col("text")).alias("p")).select("doc_id", "p.lang_pred", "p.score")


def accepted(docs: DataFrame, net: Network | None, most: float = 0.99) -> DataFrame:
    """The rows of ``docs`` in a known language; all rows where nothing could be learnt.

    Texts without a letter go, and texts whose share of the class of no language is above ``most``: at 0.99 the text must be a hundred
    times likelier there than in all languages together, as fits a corpus of which one text in a hundred is in no learnt language.
    """
    if net is None:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = docs.select(row, predicted(net)(F.col("text")).alias("p"))
    return judged.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.noise") <= most)).select("row.*")
