"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A pair prefers a document of label 1 to one of label 0; the probability that the preference holds is
``sigmoid(u(good) - u(bad))`` with a utility ``u`` that is linear in features of the whole text. The
weights minimise the logistic loss on feature differences. The cut is a quantile of the utilities of
the training documents: the one whose accept or reject decisions agree best with the labels. Scores are
``sigmoid(u - u(cut) + logit(THRESHOLD))``, so that the cut lies at ``THRESHOLD`` and the ranking is
that of the utilities.

Fitting reads at most ``MAX_TRAINING`` labelled documents (those of smallest id hash); their feature
rows, of fixed width, are the only data that reach the driver. Scoring is one pass without a shuffle.

Defined results: a null text counts as empty; an empty text has all features 0 and is scored like any
other; without labels of both kinds every score is 0.5. Repeated rows are scored alike, and columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import bounded_batches, crc_mod, raw

THRESHOLD = 0.3
MAX_TRAINING = 12_000
MAX_PAIRS = 40_000

#: Byte classes: other control, blank, line end, lower, upper, digit, punctuation, non-ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = 1
_CLASS[10] = 2
_CLASS[33:127] = 6
_CLASS[97:123] = 3
_CLASS[65:91] = 4
_CLASS[48:58] = 5
_CLASS[128:] = 7
_PUNCTUATION = np.flatnonzero(_CLASS == 6)
WIDTH = 64 + len(_PUNCTUATION) + 14


def features(text: bytes | None) -> np.ndarray:
    """Shape of a whole text: byte classes and their order, punctuation, words, lines, repetition."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    data = np.frombuffer(text, np.uint8)
    kind = _CLASS[data]
    out[:64] = np.bincount(kind[:-1] * np.uint8(8) + kind[1:], minlength=64) / len(data)
    count = np.bincount(data, minlength=256)
    marks = count[_PUNCTUATION]
    out[64 : 64 + len(marks)] = np.sqrt(marks / len(data))
    words, lines = text.split(), text.split(b"\n")
    n = len(words)
    out[-14] = np.log1p(len(data))
    out[-13] = len(set(lines)) / len(lines)
    out[-12] = np.log1p(len(data) / len(lines))
    out[-11] = np.sqrt(marks.sum() / len(data))
    out[-10] = np.count_nonzero(count) / 64
    if n:
        sizes = np.fromiter(map(len, words), np.int64, n)
        out[-9] = np.log1p(n)
        out[-8] = np.log1p(sizes.mean())
        out[-7] = np.log1p(sizes.std())
        out[-6] = np.log1p(sizes.max())
        out[-5] = (sizes <= 2).mean()
        out[-4] = len(set(words)) / n
        out[-3] = sum(map(bytes.istitle, words)) / n
        out[-2] = len(set(zip(words, words[1:], words[2:]))) / n
        out[-1] = sum(map(bytes.isupper, words)) / n
    return out


@dataclass
class Ranking:
    """Weights over standardised features and the utility at which documents are cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return _spread((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.utility(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _spread(z: np.ndarray) -> np.ndarray:
    """Each standardised feature, and how far it lies above and below one deviation."""
    z = np.clip(z, -8, 8)
    return np.concatenate([z, np.maximum(z - 1, 0), np.maximum(-1 - z, 0)], axis=1)


def fit_ranking(x: np.ndarray, label: np.ndarray, penalty: float = 3.0, seed: int = 7) -> Ranking:
    """Bradley-Terry weights by Newton steps on the loss of all preference pairs, or ``MAX_PAIRS`` drawn."""
    x = x.astype(np.float64)
    mean = x.mean(0) if len(x) else np.zeros(WIDTH)
    scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(WIDTH)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranking(mean, scale, np.zeros(3 * WIDTH), float(np.log(THRESHOLD / (1 - THRESHOLD))))
    z = _spread((x - mean) / scale)
    rng = np.random.default_rng(seed)
    possible = len(good) * len(bad)
    pair = np.arange(possible) if possible <= MAX_PAIRS else rng.integers(possible, size=MAX_PAIRS)
    pairs, first, second = len(pair), good[pair % len(good)], bad[pair // len(good)]
    weights = np.zeros(z.shape[1])
    for _ in range(12):
        gradient = penalty * weights
        curvature = penalty * np.eye(len(weights))
        for start in range(0, pairs, 4000):
            d = z[first[start : start + 4000]] - z[second[start : start + 4000]]
            wrong = 1 / (1 + np.exp(np.clip(d @ weights, -500, 500)))
            gradient -= d.T @ wrong
            curvature += (d * (wrong * (1 - wrong))[:, None]).T @ d
        step = np.linalg.solve(curvature, gradient)
        weights -= step
        if np.abs(step).max() < 1e-4:
            break
    return Ranking(mean, scale, weights, _best_quantile(z @ weights, label))


def _best_quantile(utility: np.ndarray, label: np.ndarray) -> float:
    """The utility quantile whose cut makes the fewest errors; between two documents, half way."""
    order = np.argsort(utility, kind="stable")
    u, good = utility[order], label[order] == 1
    errors = np.concatenate([[0], np.cumsum(good)]) + (~good).sum() - np.concatenate([[0], np.cumsum(~good)])
    at = int(np.argmin(errors))
    low = u[at - 1] if at else u[0] - 1
    high = u[at] if at < len(u) else u[-1] + 1
    return float((low + high) / 2)


def fit(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Ranking:
    """Fit on labelled documents whose id has a CRC-32 not divisible by 5."""
    sample = (
        labels.select("doc_id", "quality")
        .where(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), 5) != 0))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(max_training)
    )
    rows = (
        bounded_batches(docs)
        .select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", "quality", _features_of(raw(F.col("text"))).alias("x"))
        .groupBy("doc_id", "quality")
        .agg(F.min("x").alias("x"))  # one of the rows that share an id
        .toPandas()
    )
    rows["x"] = rows["x"].map(bytes)
    rows = rows.sort_values(["doc_id", "quality"])
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, WIDTH)
    return fit_ranking(x, rows["quality"].to_numpy(dtype=np.int64))


@F.pandas_udf(T.BinaryType())
def _features_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: features(t).tobytes())


def score(model: Ranking, text: Column) -> Column:
    """The score of a text column, 0 to 1."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for start in range(0, len(texts), 1024):
            x = np.stack([features(t) for t in texts.iloc[start : start + 1024]])
            out[start : start + 1024] = model.score(x.astype(np.float64))
        return pd.Series(out)

    return scored(raw(text))


def classify(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = fit(docs, labels, max_training)
    scored = docs.select("doc_id", score(model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        (F.coalesce(crc_mod(F.col("doc_id"), 5), F.lit(1)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    return docs.where(score(fit(docs, labels, max_training), F.col("text")) >= THRESHOLD)
