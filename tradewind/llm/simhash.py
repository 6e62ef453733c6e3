"""SimHash near-dedup with an inverted index over byte positions.

The fingerprint of a text has a bit set where more than half of its shingle hashes have it. Two
fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so at least 5
positional bytes match: that is the count the tally has to reach. Lists of one positional byte would
hold a 256th of all documents, and every pair in them would be tallied. The index therefore files each
fingerprint under groups of four positional bytes, the 14 groups of positions i < j < k < l with
i ^ j ^ k ^ l = 0. Any 5 positions contain at least one such group, so a pair that reaches the count
meets in some list, and a list holds a 2^32th of the documents, besides near copies. For each pair that
meets, all 8 positional bytes are tallied, pairs with at least 5 matches are retained, and the bit
distance verifies them.

Equal fingerprints are folded first. A list of more than ``BLOCK`` fingerprints is split into blocks, and
each pair of blocks goes to a task of its own. A task passes on a spanning forest of the links that it
finds, never all pairs.

Defined results: a null text counts as empty; a text without words has fingerprint 0, linked like any
other; with fewer words than a shingle the whole sequence is the one shingle. Rows that share an id keep
a row each; null ids are ignored when the smallest id is chosen. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import (
    arrow_map,
    forest,
    lower_hex,
    paired_blocks,
    pairs_in_runs,
    raw,
    whole_runs,
    written,
)
from tradewind.llm.components import components

SHINGLE = 3
MAX_BITS = 3
BLOCK = 1024
_CHUNK = 1 << 16
_LIST = ["list", "key"]
_POSITIONS = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, as a signed number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    ends = starts[min(shingle, len(words)) :] - 1
    n, ones = len(ends), np.zeros(64, np.int64)
    view = memoryview(joined)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(view[s:e], 42) for s, e in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *carried: str) -> DataFrame:
    """(doc_id, carried columns, fp) for every row."""
    names = ["doc_id", *carried]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(text.as_py(), shingle) for text in batch.column("text")]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(found, pa.int64())], names=[*names, "fp"]
        )

    schema = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in names)
    return arrow_map(docs.select(*names, raw(F.col("text")).alias("text")), rows, f"{schema}fp bigint")


def _postings(fps: DataFrame) -> DataFrame:
    """(list, key, fp): each fingerprint under every group of four of its positional bytes."""

    def part(position: int):
        return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))

    keys = [
        F.struct(
            F.lit(k).alias("list"),
            sum((part(p) * (1 << 8 * slot) for slot, p in enumerate(group)), F.lit(0).cast("bigint")).alias("key"),
        )
        for k, group in enumerate(_POSITIONS)
    ]
    return fps.select("fp", F.inline(F.array(*keys)))


def _verified(left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs share enough positional bytes and lie within the bit distance."""
    differing = left ^ right
    same = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    near = np.flatnonzero(same >= 8 - max_bits)
    return near[np.bitwise_count(differing[near]) <= max_bits]


def _links_of(runs: pa.Table, max_bits: int) -> pa.RecordBatch:
    """A spanning forest of the links within whole runs."""
    fp = runs.column("fp").to_numpy().view(np.uint64)
    a = b = np.zeros(0, np.uint64)
    for left, right in pairs_in_runs(runs, _LIST):
        near = _verified(fp[left], fp[right], max_bits)
        a, b = np.concatenate([a, fp[left[near]]]), np.concatenate([b, fp[right[near]]])
        if len(a) > 4 * len(fp):
            a, b = forest(a, b)
    a, b = forest(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within ``max_bits`` bits, at most 3."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the guaranteed count holds up to 3 differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in whole_runs(batches, [*_LIST, "row", "col"]):
            yield _links_of(runs, max_bits)

    dealt = paired_blocks(_postings(fps), _LIST, "fp", BLOCK)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _labelled(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, least, label): each distinct fingerprint, its smallest id and the label of its component."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(near_links(classes.select("fp"), max_bits))
    return classes.join(labels, classes["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest id that links reach."""
    fps = written(fingerprints(docs, shingle))
    placed = _labelled(fps, max_bits)
    least = written(placed.groupBy("label").agg(F.min("least").alias("component_id")))
    named = written(placed.select("fp", "label").join(least, "label").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", lower_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _digest():
    """SHA-256 of the text; empty for a null text."""
    return F.coalesce(F.sha2(raw(F.col("text")), 256), F.lit("")).alias("digest")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: the one of smallest id, then of smallest digest of its text.

    Rows that share an id but not a group are apart. Of rows with equal id and text, the other columns
    decide. Rows without an id cannot be told apart by one, so all of them stay.
    """
    fps = written(fingerprints(docs.select("doc_id", "text", _digest()), shingle, "digest"))
    placed = _labelled(fps, max_bits).select("fp", "label")
    keepers = (
        fps.where("doc_id IS NOT NULL")
        .join(placed, "fp")
        .groupBy("label")
        .agg(F.min(F.struct("doc_id", "digest")).alias("keeper"))
        .select("keeper.*")
    )
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.to_json(F.struct(*others)) if others else F.lit("")
    rows = docs.select("doc_id", _digest(), tie.alias("tie"), F.struct("*").alias("row"))
    chosen = rows.join(keepers, ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest")
    kept = chosen.agg(F.min_by("row", "tie").alias("row")).select("row")
    unnamed = rows.where("doc_id IS NULL").select("row")
    return kept.union(unnamed).select([F.col(f"row.`{c}`") for c in docs.columns])
