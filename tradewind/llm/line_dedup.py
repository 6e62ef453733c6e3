"""Line dedup over levelled sorted runs of line hashes.

The corpus is taken in batches of about ``BATCH_DOCS`` documents, four at least, from the largest document ids down; a
small sample of ids says where to cut, which decides nothing but the sizes. A run is a table bucketed and
sorted by line hash. Each batch merge-anti-joins every live run: lines that no run holds belong to the
largest document so far, their keeper, and form a new run at the lowest level; all others are repeats
and go to a log. When a level holds ``fanout`` runs they are merged into one run of the next level, so
a batch meets a number of runs that is logarithmic in the number of batches. Runs are written tables
with one entry for each distinct line; the log has one for each further copy. A line is common when its
keeper and its repeats reach ``min_docs``; the repeats of common lines are dropped.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; only keys of at least
``min_chars`` code points count. Keys are compared by 128-bit hash. A document that holds a key
several times counts once and keeps or loses all its copies.

Rows are named by 128 bits of hash of id and text, so that what a row gives up is gathered row by row, however many rows
share an id or have none.

Defined results: a null or empty text is one empty line. Documents with a null id count as one document
below all others. Rows that share an id count as one document and are treated alike, each with its own
lines. Ids of any type that has an order will do. Columns other than ``doc_id`` and ``text`` pass through ``dedup_lines`` unchanged, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import arrow_map, bounded_batches, shared_folder, written

MIN_CHARS = 40
MIN_DOCS = 5
BATCH_DOCS = 1 << 26
LEAST_BATCHES = 4
_CUT_SAMPLE = 4096
_PLACES = 1 << 40
_NAME = ["r1", "r2"]
_STRIPPED = " \t\n\x0b\x0c\r"


def _key(line: str, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, or None if the key is too short to count."""
    line = line.strip(_STRIPPED)
    if len(line) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line.encode().lower())


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with a name for each row; rows alike in id and text share it, as they share their fate."""
    names = {"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64("text", "doc_id", F.lit(1))}
    return docs.withColumns(names)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(r1, r2, doc_id, h1, h2): the keys of each row."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        owners, digests = [], []
        for k, text in enumerate(batch.column("text")):
            found = {_key(line, min_chars) for line in (text.as_py() or "").split("\n")} - {None}
            owners += [k] * len(found)
            digests += found
        h = _halves(digests)
        owners = pa.array(owners, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(owners) for c in (*_NAME, "doc_id")), pa.array(h[:, 0]), pa.array(h[:, 1])],
            names=[*_NAME, "doc_id", "h1", "h2"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = _named(docs.select("doc_id", "text"))
    return arrow_map(named, rows, f"r1 bigint, r2 bigint, doc_id {kind}, h1 bigint, h2 bigint")


def _cuts(docs: DataFrame, batches: int, n_docs: int) -> list:
    """Ids that cut the documents into batches of about the same size, from about ``_CUT_SAMPLE`` of their ids."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_PLACES))
    sample = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (place < _PLACES * _CUT_SAMPLE // max(1, n_docs)))
    ids = [row[0] for row in sample.distinct().orderBy("doc_id").collect()]
    return [ids[len(ids) * k // batches] for k in range(1, batches)] if ids else []


class _Runs:
    """Levels of bucketed, sorted tables of (h1, h2)."""

    def __init__(self, spark, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def unseen(self, entries: DataFrame) -> DataFrame:
        """The entries whose key no run holds."""
        for name in self.names():
            entries = entries.join(self.spark.table(name), ["h1", "h2"], "left_anti")
        return entries

    def add(self, keys: DataFrame, level: int = 0) -> None:
        """Write keys that no run holds as a run; merge a level that is full."""
        name = f"run_{uuid4().hex}"
        (
            keys.select("h1", "h2")
            .repartition(self.buckets, "h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", f"{shared_folder(self.spark)}/{name}")
            .saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:
                merged = merged.union(self.spark.table(other))
            self.add(merged, level + 1)
            self.forget(full)

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")


def repeated_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int | None = None,
    fanout: int = 3,
) -> DataFrame:
    """(r1, r2, h1, h2): the line keys that each row has to give up. ``batches`` replaces the number of batches."""
    spark = docs.sparkSession
    keys = line_keys(docs, min_chars)
    n_docs = docs.count()
    cuts = _cuts(docs, batches or max(LEAST_BATCHES, -(-n_docs // BATCH_DOCS)), n_docs)
    batch = sum((F.coalesce(F.col("doc_id") < cut, F.lit(True)).cast("int") for cut in cuts), F.lit(0))
    keys = written(keys.withColumn("batch", batch))
    runs = _Runs(spark, fanout)
    log = None
    for number in range(len(cuts) + 1):
        own = keys.where(F.col("batch") == number).drop("batch")
        largest = own.groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"))
        keepers = written(runs.unseen(largest))
        runs.add(keepers)
        held = keepers.select("h1", "h2", F.col("keeper").alias("doc_id"), F.lit(True).alias("kept"))
        same = [own[c].eqNullSafe(held[c]) for c in ("h1", "h2", "doc_id")]
        repeats = own.join(held, same, "left_anti")
        log = repeats if log is None else log.union(repeats)
    log = written(log)
    runs.forget(runs.names())
    others = log.select("doc_id", "h1", "h2").distinct().groupBy("h1", "h2").count()
    common = written(others.where(F.col("count") + 1 >= min_docs).select("h1", "h2"))
    return log.join(common, ["h1", "h2"], "left_semi").select(*_NAME, "h1", "h2")


def _with_given_up(docs: DataFrame, min_chars: int, min_docs: int, **runs) -> DataFrame:
    """(row, given_up): each row of ``docs`` as a struct, and the keys it gives up, 16 bytes each."""
    gone = (
        repeated_lines(docs.select("doc_id", "text"), min_chars, min_docs, **runs)
        .groupBy(*_NAME)
        .agg(F.collect_set(F.struct("h1", "h2")).alias("given_up"))
    )
    rows = _named(docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"))).drop("doc_id", "text")
    return rows.join(gone, _NAME, "left").select("row", "given_up")


def _kept(text: str | None, given_up: list | None, min_chars: int) -> tuple[int, list[str]]:
    lines = (text or "").split("\n")
    if given_up is None:
        return len(lines), lines
    gone = {h.tobytes() for h in np.array([(g["h1"], g["h2"]) for g in given_up], np.int64)}
    return len(lines), [line for line in lines if _key(line, min_chars) not in gone]


def dedup_report(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, **runs
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every document."""
    joined = _with_given_up(docs.select("doc_id", "text"), min_chars, min_docs, **runs)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, dropped, digests = [], [], []
        for text, given_up in zip(batch.column("text"), batch.column("given_up"), strict=True):
            n, lines = _kept(text.as_py(), given_up.as_py(), min_chars)
            counts.append(n)
            dropped.append(n - len(lines))
            digests.append(hashlib.sha256("\n".join(lines).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(
        joined.select("row.doc_id", "row.text", "given_up"),
        rows,
        f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string",
    )


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, **runs
) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; a null text stays null."""
    joined = _with_given_up(bounded_batches(docs), min_chars, min_docs, **runs)

    @F.pandas_udf("string")
    def kept(texts: pd.Series, given_up: pd.Series) -> pd.Series:
        return pd.Series(
            [
                text if text is None or gone is None else "\n".join(_kept(text, gone, min_chars)[1])
                for text, gone in zip(texts, given_up, strict=True)
            ],
            dtype=object,
        )

    text = kept(F.col("row.text"), F.col("given_up"))
    return joined.select([text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
