"""Benchmark decontamination by Wu-Manber search over words.

Every 13 consecutive words of a benchmark item are a window; an item of fewer words, but not none, is
one window. Windows of one length are searched together. The last two words under the search position
are the block: the shift table gives how far the next window can end at the earliest, so positions at
which no window can end are skipped. Where the shift is 0, the block's hash selects a bucket of windows
that end in it, and comparing all their words confirms an occurrence.

The distinct pairs of a window and its item are written once, numbered by hash in sets of about ``MAX_WORDS``
words. A set at a time is fetched, broadcast and searched for, its hits are written, and the broadcast is
destroyed before the next is fetched, so neither the driver nor a task holds more than one. Hits are filed by
the SHA-256 of the text that has them and join the documents after the last set. With a single set, documents
are searched in one pass without a shuffle.

Defined results: null texts have no words; a document without words is not contaminated; an item without
words has no window. Items that share an id count once. Rows that share a document id are judged each by
its own text. Empty tables give empty results or documents without hits. Columns other than ``doc_id``,
``text`` and ``item_id`` are ignored; ``clean`` returns all columns of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import arrow_map, bounded_batches, raw, written

WINDOW = 13
MAX_WORDS = 2_000_000

#: ASCII letters in lower case and digits stay, other ASCII separates, non-ASCII stays.
_FOLD = bytes(
    c if c >= 128 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a text."""
    return (text or b"").translate(_FOLD).split()


class _Search:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, windows: list[tuple[int, ...]], length: int, vocabulary: int):
        self.length, self.base = length, vocabulary
        self.block = min(2, length)
        self.farthest = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[int]] = {}
        for number, window in enumerate(windows):
            for end in range(self.block, length + 1):
                key = self._key(window, end)
                self.shift[key] = min(self.shift.get(key, self.farthest), length - end)
            self.bucket.setdefault(self._key(window, length), []).append(number)
        self.windows = windows

    def _key(self, ids, end: int) -> int:
        return ids[end - 1] if self.block == 1 else ids[end - 2] * self.base + ids[end - 1]

    def occurrences(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(start, number of the window) for each occurrence; id -1 is in no window."""
        end, n, length, base, farthest = self.length, len(ids), self.length, self.base, self.farthest
        shift, pairs = self.shift, self.block == 2
        while end <= n:
            last = ids[end - 1]
            if last < 0:
                end += length
                continue
            key = ids[end - 2] * base + last if pairs else last
            step = shift.get(key, farthest)
            if step:
                end += step
                continue
            here = tuple(ids[end - length : end])
            for number in self.bucket[key]:
                if self.windows[number] == here:
                    yield end - length, number
            end += 1


class Windows:
    """A set of benchmark windows, ready to be searched; built once in each Python worker."""

    def __init__(self, items_of: dict[tuple[bytes, ...], list[str]]):
        self.items_of = items_of
        self._built = None

    def __getstate__(self):
        return {"items_of": self.items_of, "_built": None}

    def _tables(self):
        if self._built is None:
            number = {}
            for window in self.items_of:
                for word in window:
                    number.setdefault(word, len(number))
            by_length: dict[int, list] = {}
            for window, items in self.items_of.items():
                by_length.setdefault(len(window), []).append((tuple(number[w] for w in window), items))
            self._built = number, [
                (_Search([w for w, _ in group], length, len(number) + 1), [i for _, i in group])
                for length, group in sorted(by_length.items())
            ]
        return self._built

    def find(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, covered word spans and the items with occurring windows."""
        number, searches = self._tables()
        ids = [number.get(w, -1) for w in words(text)]
        spans, items = [], set()
        for search, owners in searches:
            for start, found in search.occurrences(ids):
                spans.append((start, start + search.length))
                items.update(owners[found])
        return len(ids), spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, item, size): each distinct pair of a window and the id of an item that has it, as text."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found, sizes = [], [], []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = words(text)
            for start in range(max(1, len(own) - window + 1) if own else 0):
                ids.append(item)
                found.append(b" ".join(own[start : start + window]))
                sizes.append(min(window, len(own)) + 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.binary()), pa.array(ids, pa.string()), pa.array(sizes, pa.int64())],
            names=["words", "item", "size"],
        )

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), raw(F.col("text")).alias("text"))
    return arrow_map(items, rows, "words binary, item string, size bigint").distinct()


def _fetched(pairs: DataFrame) -> Windows:
    """One set of windows, in the driver."""
    own: dict[tuple[bytes, ...], list[str]] = {}
    for row in pairs.select("words", "item").toLocalIterator():
        items = own.setdefault(tuple(bytes(row["words"]).split()), [])
        if row["item"] is not None:
            items.append(row["item"])
    return Windows(own)


def window_sets(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> tuple[int, Iterator[Windows]]:
    """The number of sets of bounded size, and the benchmark's windows in them, each fetched when it is asked for."""
    pairs = written(benchmark_windows(benchmark, window))
    size = pairs.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-size // max_words))
    if n == 1:
        return n, (_fetched(pairs) for _ in range(n))
    number = F.pmod(F.xxhash64("words", "item"), F.lit(n)).cast("int")
    numbered = written(pairs.withColumn("set", number).repartition(n, "set"), "set")
    return n, (_fetched(numbered.where(F.col("set") == k)) for k in range(n))


def _scan(df: DataFrame, shared: Broadcast) -> DataFrame:
    """Fill the columns n_words, spans and items with what one set of windows finds."""
    schema = df.schema

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        search = shared.value
        counts, spans, items = [], [], []
        for text in batch.column("text"):
            n, found, hit = search.find(text.as_py())
            counts.append(n)
            spans.append([list(s) for s in _merged(found)])
            items.append(sorted(hit))
        columns = {
            "n_words": pa.array(counts, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            "items": pa.array(items, pa.list_(pa.string())),
        }
        names = batch.schema.names
        return pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in names], names=names)

    return bounded_batches(df).mapInArrow(lambda batches: map(rows, batches), schema)


def _unsearched(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns, the text and room for what is found in it."""
    return docs.select(
        *columns,
        raw(F.col("text")).alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<array<bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )


def _hits(docs: DataFrame, sets: Iterator[Windows]) -> DataFrame:
    """(key, spans, items): what all sets find in each distinct text that has hits, by SHA-256 of the text."""
    sc = docs.sparkSession.sparkContext
    found = []
    for windows in sets:
        shared = sc.broadcast(windows)
        del windows
        hit = _scan(_unsearched(docs), shared).where(F.size("spans") > 0)
        found.append(written(hit.select(F.sha2("text", 256).alias("key"), "spans", "items").distinct()))
        shared.destroy(blocking=True)
    together = reduce(DataFrame.union, found).groupBy("key")
    listed = together.agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[list(s) for s in _merged([(a, b) for a, b in own])] for own in batch.column("spans").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(spans, pa.list_(pa.list_(pa.int64()))), batch.column("items")],
            names=["key", "spans", "items"],
        )

    sets_of = listed.withColumn("items", F.sort_array(F.array_distinct("items")))
    return written(arrow_map(sets_of, merged, "key string, spans array<array<bigint>>, items array<string>"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS
) -> DataFrame:
    """(row, n_words, spans, items): each document as a struct, its covered word spans and its items."""
    sc = docs.sparkSession.sparkContext
    n, sets = window_sets(benchmark, window, max_words)
    row = F.struct("*").alias("row")
    if n == 1:
        return _scan(_unsearched(docs, row), sc.broadcast(next(sets))).drop("text")
    hits = _hits(docs, sets)
    counted = _scan(_unsearched(docs, row), sc.broadcast(Windows({})))
    keyed = counted.select("row", "n_words", F.sha2("text", 256).alias("key"))
    none = {c: F.array().cast(hits.schema[c].dataType) for c in ("spans", "items")}
    return keyed.join(hits, "key", "left").select(
        "row", "n_words", *(F.coalesce(c, empty).alias(c) for c, empty in none.items())
    )


def _n_hit():
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document."""
    found = contamination(docs.select("doc_id", "text"), benchmark, window, max_words)
    counted = found.select("row.doc_id", "n_words", _n_hit().alias("n_hit"), "items")
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = contamination(docs, benchmark, window, max_words)
    hit = _n_hit()
    return found.where((hit == 0) | (20 * hit < F.col("n_words"))).select(
        [F.col(f"row.`{c}`") for c in docs.columns]
    )
