"""Language identification with string kernels.

Two texts are compared by the blended-spectrum presence kernel: the number of distinct n-grams of code
points, for n from 1 to ``MAX_N``, that occur in both, divided by the geometric mean of how many each
has. N-grams are taken from the lower-cased whole text and kept as exact numbers, not hashes, so the kernel
is exact however long a text is. The Nystroem method replaces the kernel by its values against landmark
texts, whitened by the landmarks' own kernel matrix; on these features one kernel ridge regression is fitted
for each language against all others, and the language with the largest output is predicted.

Only n-grams that some landmark has can count, so an index of the landmarks' n-grams gives all kernel values
of a text; whitening and ridge weights fold into one matrix of landmarks by languages. Scoring is one pass
without a shuffle.

Every language that occurs is learned. Fitting reads at most ``MAX_TRAINING`` documents of each (those of smallest id hash),
fewer where that makes more than ``MAX_ROWS`` in all, but one at least. About ``LANDMARKS`` of them in all serve as
landmarks, one of each language at least. Landmarks are whole texts: those of a language are taken in order
while they fit its share of ``LANDMARK_POINTS`` code points, and if none fits, its shortest. The landmarks' n-grams
reach the driver, and of every other document one kernel value for each landmark, computed in tasks from its whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Without a document to
learn from every text is ``und``; with one language every text with a letter has that language. Ties go
to the language that sorts first. Rows that share an id are judged each by its own text; columns other
than ``doc_id``, ``text`` and ``lang`` are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import crc_mod, mixed, written

MAX_N = 3
SLOTS = 1 << 14
MAX_TRAINING = 400
MAX_ROWS = 80_000
LANDMARKS = 256
LANDMARK_POINTS = 1 << 21
UNDETERMINED = "und"
_BATCH = 128
_HASHES = 1 << 40
_CHUNK = 1 << 20


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of a whole text as ascending numbers, each its own."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.zeros(0, np.uint64)
    for at in range(0, len(points), _CHUNK):
        # a chunk's last n-grams reach into the next
        own = points[at : at + _CHUNK + MAX_N - 1]
        codes, parts = np.zeros(len(own), np.uint64), [found]
        for n in range(1, min(MAX_N, len(own)) + 1):
            codes = codes[: len(own) - n + 1] * np.uint64(0x110000) + own[n - 1 :]
            # the length is part of the number; code points and their pairs and triples fit 63 bits
            parts.append(codes * np.uint64(4) + np.uint64(n))
        found = np.unique(np.concatenate(parts))
    return found


def slots(text: str) -> np.ndarray:
    """The n-grams of a text hashed to ``SLOTS`` booleans: a view for small comparisons, not used to judge."""
    out = np.zeros(SLOTS, bool)
    out[mixed(grams(text)) & np.uint64(SLOTS - 1)] = True
    return out


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Landmarks:
    """Which landmarks have an n-gram: ``owner[first[k] : first[k + 1]]`` for ``grams[k]``."""

    grams: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Landmarks:
        sizes = np.array([len(own) for own in sets], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(every, kind="stable")
        found, first = np.unique(every[order], return_index=True)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
        return cls(found, np.append(first, len(every)), owner, sizes)

    def kernel(self, own: np.ndarray) -> np.ndarray:
        """Kernel values of a text against all landmarks."""
        at = np.searchsorted(self.grams, own)
        at = at[self.grams[np.minimum(at, len(self.grams) - 1)] == own] if len(self.grams) else at[:0]
        counts = self.first[at + 1] - self.first[at]
        ends = np.cumsum(counts)
        places = np.repeat(self.first[at] - ends + counts, counts) + np.arange(counts.sum())
        shared = np.bincount(self.owner[places], minlength=len(self.sizes))
        return shared / np.sqrt(np.maximum(self.sizes, 1) * max(len(own), 1))


def _numbers(occupied: np.ndarray) -> list[np.ndarray]:
    """Rows of booleans as the numbers of their true columns."""
    return [np.flatnonzero(row).astype(np.uint64) for row in occupied]


@dataclass
class Languages:
    """Languages in sorted order, the landmarks and the folded weights of the classifiers."""

    names: list[str]
    marks: Landmarks
    weights: np.ndarray

    def judged(self, texts: Iterable[np.ndarray]) -> np.ndarray:
        """One output per language for the n-grams of each text: 1 for, -1 against."""
        return np.stack([self.marks.kernel(own) for own in texts]) @ self.weights

    def outputs(self, occupied: np.ndarray) -> np.ndarray:
        """The same for n-grams given as rows of booleans."""
        return self.judged(_numbers(occupied))


def _fitted(names: list[str], marks: Landmarks, own: np.ndarray, rows: np.ndarray, lang: np.ndarray, ridge: float) -> Languages:
    """One ridge regression for each language, from kernel values of landmarks and of labelled texts."""
    values, vectors = np.linalg.eigh(own)
    sound = values > 1e-6 * values.max()
    whiten = vectors[:, sound] / np.sqrt(values[sound])
    z = rows @ whiten
    target = np.where(lang[:, None] == np.array(names, object)[None, :], 1.0, -1.0)
    # every language weighs the same, however many documents it has
    count = dict(zip(*np.unique(lang.astype(str), return_counts=True)))
    weight = 1 / np.array([count[x] for x in lang])
    gram = (z * weight[:, None]).T @ z + ridge * np.eye(z.shape[1])
    solved = np.linalg.solve(gram, (z * weight[:, None]).T @ target)
    return Languages(names, marks, whiten @ solved)


def fit_languages(occupied: np.ndarray, lang: np.ndarray, landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Languages:
    """Fit on n-grams given as rows of booleans; the first texts of each language are its landmarks."""
    names = sorted(set(lang))
    if not names:
        return _UNTAUGHT
    share = max(1, landmarks // len(names))
    texts = _numbers(occupied)
    marks = Landmarks.of([texts[k] for name in names for k in np.flatnonzero(lang == name)[:share]])
    chosen = np.concatenate([np.flatnonzero(lang == name)[:share] for name in names])
    rows = np.stack([marks.kernel(own) for own in texts])
    return _fitted(names, marks, rows[chosen], rows, lang, ridge)


_UNTAUGHT = Languages([], Landmarks.of([]), np.zeros((0, 0)))


@F.pandas_udf(T.BinaryType())
def _grams_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: grams(t).tobytes())


def _kernel_of(marks: Broadcast, text: Column) -> Column:
    """Kernel values of a text against all landmarks, as bytes."""

    @F.pandas_udf(T.BinaryType())
    def values(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: marks.value.kernel(grams(t)).astype(np.float32).tobytes())

    return values(text)


def landmark_places(sizes: list[tuple[str, int, int]], share: int, points: int) -> list[tuple[str, int]]:
    """Which of the (language, place, length) serve as landmarks: whole texts, ``share`` for each language at most."""
    chosen, own = [], {}
    for lang, place, length in sorted(sizes):
        own.setdefault(lang, []).append((place, length))
    for lang, texts in own.items():
        left, taken = points, []
        for place, length in texts:
            if len(taken) < share and length <= left:
                taken.append(place)
                left -= length
        chosen += [(lang, place) for place in taken or [min(texts, key=lambda t: (t[1], t[0]))[0]]]
    return chosen


def fit(docs: DataFrame, max_training: int = MAX_TRAINING, landmarks: int = LANDMARKS) -> Languages:
    """Fit on documents with a language whose id has a CRC-32 that is not 2 modulo 4."""
    usable = docs.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES)).alias("at")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)
    )
    counts = {row["lang"]: row["count"] for row in usable.groupBy("lang").count().collect()}
    if not counts:
        return _UNTAUGHT
    max_training = max(1, min(max_training, MAX_ROWS // len(counts)))
    # Below a hash that leaves about three times the rows wanted, one task can rank those of a language.
    below = {lang: max(1, _HASHES * 3 * max_training // n) for lang, n in counts.items()}
    bound = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))
    sample = (
        usable.where(F.col("at") < F.element_at(bound, F.col("lang")))
        .distinct()
        .withColumn("place", ranked)
        .where(F.col("place") <= max_training)
        .select("doc_id", "lang", "place")
    )
    texts = written(
        docs.select("doc_id", "lang", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(sample), ["doc_id", "lang"])
        .groupBy("lang", "place")
        .agg(F.min("text").alias("text"))  # one of the rows that share an id
    )
    sizes = [tuple(row) for row in texts.select("lang", "place", F.length("text")).collect()]
    chosen = landmark_places(sizes, max(1, landmarks // len(counts)), LANDMARK_POINTS // len(counts))
    first = texts.join(F.broadcast(texts.sparkSession.createDataFrame(chosen, "lang string, place int")), ["lang", "place"])
    first = first.select("lang", "place", _grams_of(F.col("text")).alias("grams")).toPandas().sort_values(["lang", "place"])
    sets = [np.frombuffer(bytes(own), np.uint64) for own in first["grams"]]
    marks = Landmarks.of(sets)
    shared = docs.sparkSession.sparkContext.broadcast(marks)
    rows = texts.select("lang", "place", _kernel_of(shared, F.col("text")).alias("kernel")).toPandas()
    shared.destroy()
    rows = rows.sort_values(["lang", "place"])
    values = np.frombuffer(b"".join(map(bytes, rows["kernel"])), np.float32).reshape(len(rows), len(sets))
    own = np.stack([marks.kernel(x) for x in sets])
    return _fitted(sorted(counts), marks, own, values, rows["lang"].to_numpy(dtype=object), ridge=1e-2)


def predicted(model: Languages, text: Column) -> Column:
    """Struct (lang_pred, score) of a text column."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        judged = [k for k, t in enumerate(texts) if model.names and _has_letter(t)]
        for start in range(0, len(judged), _BATCH):
            batch = judged[start : start + _BATCH]
            out = model.judged(grams(texts.iloc[k]) for k in batch)
            best = out.argmax(1)
            # half the distance above -1: 1 is the target of the own language
            scores[batch] = np.clip((out[np.arange(len(batch)), best] + 1) / 2, 0, 1)
            for k, b in zip(batch, best):
                langs[k] = model.names[b]
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return scored(text)


def identify(docs: DataFrame, max_training: int = MAX_TRAINING, landmarks: int = LANDMARKS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document."""
    model = fit(docs, max_training, landmarks)
    found = docs.select("doc_id", predicted(model, F.col("text")).alias("found"))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4), F.lit(0)) == 2
    return found.select("doc_id", held_out.alias("held_out"), "found.lang_pred", "found.score")
