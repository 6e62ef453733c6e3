"""Substring dedup by seed and extend on words.

Any two equal windows of ``WINDOW`` words choose the same seed: the smallest hash among their word
``SEED``-grams (the last of several, as winnowing does). Each seed occurrence stands for the segment of all
windows that choose it. Documents are joined on seeds:

* a seed found once is in no repeat;
* if all occurrences of a seed have the same segment, the match extends over the whole segment in both
  directions, and all of it repeats;
* otherwise occurrences match over different lengths. Classes of equal segments with several members
  repeat as a whole; for the others, the windows of one member of each class are extended from the seed,
  one by one, and compared by (seed, window), which finds the maximal stretch that recurs elsewhere.

Every word covered by a window whose words also start anywhere else is removed. Windows are judged on the
input, and by 64-bit hashes of the seed and of the whole window or segment, both of which have to agree.

No pairs of occurrences are formed: seeds, classes and windows are counted with map-side aggregation, and
occurrences are joined with those counts from written tables, which adaptive execution can split.

Defined results: a null or empty text has no words, removes nothing and has the digest of the empty
string. Equal rows, also with equal ids, repeat each other. Words are separated by ASCII white space and
kept unchanged. Columns other than ``doc_id`` and ``text`` are ignored, and ``doc_id`` only names rows. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import arrow_map, mixed, raw, rolled, written

WINDOW = 35
SEED = 8
_STRETCH = 1 << 16
_NAME = ["row", "row2"]


def _word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def seeds(hashes: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed hash, first window and number of windows of each seed occurrence, in order."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = rolled(hashes, seed, 0)
    width = window - seed + 1
    chosen = np.empty(n, np.int64)
    for at in range(0, n, _STRETCH):
        part = grams[at : min(n, at + _STRETCH) + width - 1]
        views = np.lib.stride_tricks.sliding_window_view(part, width)
        # argmin takes the first of equal values: look from the end
        chosen[at : at + len(views)] = at + np.arange(len(views)) + width - 1 - views[:, ::-1].argmin(1)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    return grams[chosen[first]], first, np.diff(np.concatenate([first, [n]]))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _stretches(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each stretch of words, from prefix sums of a polynomial modulo 2**64."""
    base = 0xD6E8FEB86659FD93
    powers, down = _powers(base, len(hashes)), _powers(pow(base, -1, 1 << 64), len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes) * powers[:-1], dtype=np.uint64)])
    return mixed((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))


def _rows(docs: DataFrame) -> DataFrame:
    """Rows named by two hashes of id and text, so that rows which share an id stay apart."""
    return docs.select("doc_id", *row_names(), raw(F.col("text")).alias("text"))


def row_names() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text", "doc_id", F.lit(1)).alias("row2")]


def occurrences(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(seed, segment, row, row2, first, windows): every seed occurrence of every row."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        owners, found = [], []
        for k, text in enumerate(batch.column("text")):
            hashes = _word_hashes(text.as_py())
            marks, first, windows = seeds(hashes, window, seed)
            if len(marks):
                found.append((marks, _stretches(hashes, first, windows + window - 1), first, windows))
                owners.append(np.full(len(marks), k))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2
        owner = pa.array(np.concatenate(owners) if owners else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0].view(np.int64)),
                pa.array(columns[1].view(np.int64)),
                *(batch.column(name).take(owner) for name in _NAME),
                pa.array(columns[2].astype(np.int32)),
                pa.array(columns[3].astype(np.int16)),
            ],
            names=["seed", "segment", *_NAME, "first", "windows"],
        )

    schema = "seed bigint, segment bigint, row bigint, row2 bigint, first int, windows smallint"
    return arrow_map(_rows(docs).select(*_NAME, "text"), rows, schema)


def _windows(probes: DataFrame, window: int) -> DataFrame:
    """(seed, window, copies, row, row2, first): the single windows of segments, from (row, row2, text, wanted)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple] = []
        for k, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("wanted"), strict=True)):
            hashes = rolled(_word_hashes(text.as_py()), window, 1)
            for w in wanted.as_py():
                at = np.arange(w["first"], w["first"] + w["windows"])
                found.append((np.full(len(at), w["seed"]), hashes[at], np.full(len(at), w["copies"]), np.full(len(at), k), at))
        if found:
            mark, own, copies, owner, at = map(np.concatenate, zip(*found))
        else:
            mark, copies, owner, at = (np.zeros(0, np.int64) for _ in range(4))
            own = np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(mark),
                pa.array(own.view(np.int64)),
                pa.array(copies),
                *(batch.column(name).take(pa.array(owner)) for name in _NAME),
                pa.array(at.astype(np.int32)),
            ],
            names=["seed", "window", "copies", *_NAME, "first"],
        )

    schema = "seed bigint, window bigint, copies bigint, row bigint, row2 bigint, first int"
    return arrow_map(probes, rows, schema)


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(row, row2, first, windows): runs of windows that also start elsewhere."""
    found = written(occurrences(docs, window, seed))
    recurring = written(
        found.groupBy("seed")
        .agg(F.count("*").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"))
        .where("n > 1")
        .select("seed", (F.col("low") == F.col("high")).alias("alike"))
    )
    met = written(found.join(recurring, "seed"))
    classes = written(
        met.where("NOT alike")
        .groupBy("seed", "segment")
        .agg(F.count("*").alias("copies"), F.min(F.struct(*_NAME, "first", "windows")).alias("member"))
    )
    again = classes.where("copies > 1").select("seed", "segment")
    whole = met.where("alike").union(met.where("NOT alike").join(written(again), ["seed", "segment"], "left_semi").select(met.columns))
    wanted = classes.groupBy("member.row", "member.row2").agg(
        F.collect_list(F.struct("seed", "member.first", "member.windows", "copies")).alias("wanted")
    )
    # rows that are equal in id and text share a name, but then no segment of theirs has one member
    probes = _rows(docs).join(wanted, _NAME).select(*_NAME, "text", "wanted")
    single = written(_windows(probes, window))
    twice = written(
        single.groupBy("seed", "window").agg(F.sum("copies").alias("copies")).where("copies > 1").select("seed", "window")
    )
    extended = single.where("copies = 1").join(twice, ["seed", "window"], "left_semi")
    one = F.lit(1).cast("smallint").alias("windows")
    return written(whole.select(*_NAME, "first", "windows").union(extended.select(*_NAME, "first", one)))


def _covered(n: int, runs: list, window: int) -> np.ndarray:
    """Which of ``n`` words some run of windows covers."""
    edge = np.zeros(n + 1, np.int64)
    for run in runs:
        edge[run["first"]] += 1
        edge[run["first"] + run["windows"] + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def report(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for every row.

    ``spans`` are the removed stretches of words, end exclusive.
    """
    runs = repeated_windows(docs, window, seed).groupBy(*_NAME).agg(F.collect_set(F.struct("first", "windows")).alias("runs"))
    joined = _rows(docs).join(runs, _NAME, "left").select("doc_id", "text", "runs")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, removed, digests, spans = [], [], [], []
        for text, own in zip(batch.column("text"), batch.column("runs"), strict=True):
            words = (text.as_py() or b"").split()
            gone = _covered(len(words), own.as_py() or [], window)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(spans, pa.list_(span)),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(
        joined,
        rows,
        f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string,"
        " spans array<struct<start: bigint, end: bigint>>",
    )
