"""Quality classifier by hierarchical empirical Bayes.

A logistic model over whole-text features, fitted on a bounded labelled sample, gives each document its evidence (log-odds of good).
Documents' expected goodness is summed by path within host and by host. Beta-binomial posteriors shrink each host toward the corpus
rate and each path toward its host; the strengths of shrinkage come from the spread between sites by the method of moments, so sparse
sites stay near their prior. A document's score adds its path's log-odds, relative to the corpus and without the document itself, to
its own evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyspark.llm.common import discard, store, work_for

#: Labelled documents that the model is fitted on (least hashes first), and words of a window of the type-token ratio.
SAMPLE = 4000
SPAN = 64
#: Share of the site's log-odds that counts, and the least probability of a document that is kept.
SITE_WEIGHT = 1.0
KEEP = 0.3
FEATURES = ("log_words", "fresh", "low_fresh", "symbols", "pipes", "upper", "digits", "stutter", "same_lines", "word_length", "shouts")
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#$%&*+<=>@[]^_`{}~\\", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTERS = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_DIGITS = (np.arange(256) >= 48) & (np.arange(256) <= 57)


def features(text: str) -> list[float]:
    """Of a whole text, in the order of FEATURES."""
    words = text.split()
    n = max(1, len(words))
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    total, letters = max(1, counts.sum()), max(1, counts[_LETTERS].sum())
    ratios = [len(set(words[i : i + SPAN])) / len(words[i : i + SPAN]) for i in range(0, len(words), SPAN)] or [1.0]
    if len(ratios) > 1 and len(words) % SPAN < SPAN // 2 and len(words) % SPAN:
        ratios.pop()  # a short last window would look fresh
    lines = text.split("\n")
    return [
        np.log1p(len(words)), sum(ratios) / len(ratios), sum(r < 0.55 for r in ratios) / len(ratios), counts[_SYMBOLS].sum() / total, counts[124] / n, counts[_UPPER].sum() / letters,
        counts[_DIGITS].sum() / total, sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), min(30.0, total / n), counts[33] / n,
    ]


@dataclass
class Evidence:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def _basis(z: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(z), 1)), z, np.abs(z)], 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(self._basis(z) @ self.weights, -12, 12)


def fit_evidence(x: np.ndarray, good: np.ndarray, ridge: float = 0.3) -> Evidence:
    """Ridge logistic regression by Newton's method on standardised features and their absolute values."""
    if len(x) == 0 or good.min() == good.max():  # nothing to tell apart: all documents alike
        k = len(FEATURES)
        w = np.zeros(2 * k + 1)
        w[0] = 4.0 if len(x) == 0 or good.max() else -4.0
        return Evidence(np.zeros(k), np.ones(k), w)
    model = Evidence(x.mean(0), np.maximum(x.std(0), 1e-6), np.zeros(2 * x.shape[1] + 1))
    b = model._basis(np.clip((x - model.mean) / model.scale, -8, 8))
    penalty = np.full(b.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(b @ model.weights, -30, 30)))
        step = np.linalg.solve((b * (p * (1 - p))[:, None]).T @ b + np.diag(penalty), b.T @ (good - p) - penalty * model.weights)
        model.weights = model.weights + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return model


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"]
        yield batch.drop(columns=["text"]).assign(features=[features(t) if t else None for t in texts])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """features and quality of at most ``sample`` labelled documents, least hash of doc_id first.

    Of labels that differ the larger counts; of rows that share a doc_id the least text, so the sample is bounded whatever repeats.
    """
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = good.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).drop("h")
    rows = docs.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))
    return rows.select("quality", "text").mapInPandas(_measured, "quality int, features array<double>").toPandas()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Evidence:
    got = labelled_sample(docs, labels.select("doc_id", F.col("quality").cast("int").alias("quality")), sample)
    if got.empty:
        return fit_evidence(np.empty((0, len(FEATURES))), np.empty(0))
    got = got.assign(key=got["features"].map(tuple)).sort_values(["key", "quality"])
    return fit_evidence(np.stack(got["features"]), got["quality"].to_numpy(np.float64))


def evidence(model: Evidence):
    """A column function: text -> evidence; null and empty texts have none (null)."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        work_for("quality")
        found = pd.Series(np.nan, index=texts.index)
        some = [i for i, t in enumerate(texts) if t]
        if some:
            found.iloc[some] = model.log_odds(np.array([features(texts.iloc[i]) for i in some]))
        return found

    return lambda text: F.nanvl(run(text), F.lit(None).cast("double"))


def _strength(groups: DataFrame, prior: str, good: str, n: str) -> float:
    """Pseudo-count of the prior by the method of moments over groups: large where groups differ no more than chance."""
    p, m = F.col(prior), F.col(good) / F.col(n)
    chance, seen = F.sum(p * (1 - p)), F.sum(F.col(n) * (m - p) ** 2)
    row = groups.where(F.col(n) > 1).agg(chance.alias("chance"), seen.alias("seen"), F.sum(p * (1 - p) * (F.col(n) - 1)).alias("over")).first()
    if not row["over"] or row["seen"] is None:
        return 100.0
    between = max(1e-6, (row["seen"] - row["chance"]) / row["over"])  # share of the variance that lies between groups
    return float(np.clip(1 / min(between, 0.999) - 1, 1.0, 1000.0))


@dataclass(frozen=True)
class Shrinkage:
    """The corpus rate, and the pseudo-counts with which hosts lean on it and paths on their host."""

    rate: float
    host: float
    path: float


def site_sums(scored: DataFrame) -> tuple[DataFrame, Shrinkage]:
    """Stored table (host, path, n, good, host_n, host_good) of documents' expected goodness, and how much sites are shrunk."""
    rows = scored.where(F.col("evidence").isNotNull())
    paths = store(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(_goodness()).alias("good")), "paths")
    total = paths.agg(F.sum("n"), F.sum("good")).first()
    rate = float(np.clip((total[1] or 0.0) / total[0], 0.001, 0.999)) if total[0] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")).withColumn("prior", F.lit(rate))
    k_host = _strength(hosts, "prior", "host_good", "host_n")
    out = store(paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"]), "sites")
    discard(paths)
    host_rate = (F.col("host_good") + k_host * rate) / (F.col("host_n") + k_host)
    return out.drop("prior"), Shrinkage(rate, k_host, _strength(out.withColumn("host_rate", host_rate), "host_rate", "good", "n"))


def _goodness() -> Column:
    return 1 / (1 + F.exp(-F.col("evidence")))


def combined(scored: DataFrame, sites: DataFrame, by: Shrinkage) -> DataFrame:
    """Add host_rate, path_rate, score (0 to 1) and kept to rows with host, path and evidence.

    A row's rates are those of its host and path without the row itself, so that its evidence counts once; a site of one document is at
    its prior. The sites are joined by (host, path), null being a value: where they are few the planner broadcasts the stored table,
    else a hot site's rows are split by the skew join.
    """
    s = sites.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "n", "good", "host_n", "host_good")
    own = ["site_host", "site_path", "n", "good", "host_n", "host_good"]
    rows = scored.select(F.struct("*").alias("_row"), "host", "path", "evidence")
    out = rows.join(s, rows["host"].eqNullSafe(s["site_host"]) & rows["path"].eqNullSafe(s["site_path"]), "left")
    near = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    host = near((F.col("host_good") - _goodness() + by.host * by.rate) / (F.col("host_n") - 1 + by.host))
    out = out.withColumn("host_rate", F.coalesce(host, F.lit(by.rate)))
    path = near((F.col("good") - _goodness() + by.path * F.col("host_rate")) / (F.col("n") - 1 + by.path))
    out = out.withColumn("path_rate", F.coalesce(path, F.col("host_rate"))).drop(*own)
    lean = SITE_WEIGHT * (F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - float(np.log(by.rate / (1 - by.rate))))
    score = F.coalesce(1 / (1 + F.exp(-(F.col("evidence") + lean))), F.lit(0.0))
    return out.withColumn("score", score).withColumn("kept", F.col("score") >= KEEP).select("_row.*", "host_rate", "path_rate", "score", "kept")


def _judged(docs: DataFrame, labels: DataFrame, host: str, path: str) -> tuple[DataFrame, DataFrame, Shrinkage, Evidence]:
    model = train(docs, labels)
    scored = store(docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), evidence(model)(F.col("text")).alias("evidence")), "evidence")
    return scored, *site_sums(scored), model


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, score and kept for every row of ``docs``.

    Null and empty texts have no evidence, score 0 and are not kept. Null hosts and paths are sites of their own. Without labels, or
    with labels of one kind only, all texts get that kind's evidence. Repeated rows count each.
    """
    scored, sites, by, _ = _judged(docs, labels, host, path)
    return combined(scored, sites, by)


def kept_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; rows are judged where they lie, so null and repeated ids do not matter."""
    scored, sites, by, model = _judged(docs, labels, host, path)
    discard(scored)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), evidence(model)(F.col("text")).alias("evidence"))
    return combined(rows, sites, by).where("kept").select("row.*")
