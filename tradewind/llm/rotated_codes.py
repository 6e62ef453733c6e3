"""Nearest neighbours by inner product over randomly rotated one-bit codes.

The index holds for each vector x, less a common centre c, the signs of its rotated direction as packed bits and
two correction scalars: the length of x - c, and the sum of absolute rotated components (the inner product of the
direction with its code, but for a constant). A short vector is rotated into ``MIN_BITS`` dimensions, so that its
code has as many bits. With s the signs, q' the rotated query and l the length::

    <q, x>  is about  <q, c> + l * <s, q'> / sum |components|

and errs by at most ``DEVIATIONS`` standard deviations, known from the correction scalars, but for one pair in
30,000. A task unpacks the bits of a block of rows, estimates all its products with the queries by one matrix
product, and reranks by the exact product only the rows whose upper bound reaches what the query's ``k`` nearest so
far ask for.

Rows are dealt to waves, the first of ``FIRST`` rows and each together with those before it ``GROWTH`` times as
large as the last. The ``k`` nearest found in all waves so far give each query its limit for the next wave, so a
wave passes on some ``k * GROWTH`` rows a query however large it is. Queries are numbered by hash in sets of about
``SET_VALUES`` components; one set at a time goes through the driver and is broadcast.

The only sample is that of the centre: ``CENTRE_ROWS`` rows, the smallest by hash. Any centre gives right
results. All rows are indexed and all are searched.

Defined results: a vector that is null, empty, zero or holds null or non-finite components takes no part, neither
as a query nor as a candidate. Vectors of another length than the query's are no candidates for it. A query has
all candidates if there are fewer than ``k``. The query's own row is told by its id: rows that share an id are each
a query, and none is a candidate for the others; rows alike in id and vector are one query, but each of them is a
candidate for others. Rows without an id are candidates, after others of their score. Ids are whole numbers.
Columns other than ``vec_id`` and ``embedding`` are ignored. An empty table, or one without queries, gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import written

NEIGHBOURS = 20
MIN_BITS = 256
DEVIATIONS = 4.0
FIRST = 1024
GROWTH = 4
CENTRE_ROWS = 1024
SET_VALUES = 1 << 20
_ROWS, _QUERIES, _PAIRS = 2048, 1024, 1 << 16
_SPREAD = 1 << 40
_FOUND = "query int, query_id bigint, vec_id bigint, score double"


@lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """The first ``dim`` columns of a random rotation of as many dimensions as a code has bits."""
    bits = max(MIN_BITS, -(-dim // 8) * 8)
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((bits, dim)))[0]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The parts of a batch that have one vector length."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch if (dims == dim).all() else batch.take(pa.array(np.flatnonzero(dims == dim)))


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim, place) of the vectors that take part; ``place`` is an even hash."""
    embedding = F.col("embedding")
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(finite & F.exists(embedding, lambda x: x != 0)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        "embedding",
        F.size(embedding).alias("dim"),
        F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(_SPREAD)).alias("place"),
    )


def centres(rows: DataFrame, n_rows: int) -> dict[int, np.ndarray]:
    """The mean of a bounded sample, for each vector length in it."""
    sample: dict[int, list] = {}
    # few more than those wanted pass the filter, so that tasks send few to be ordered
    some = rows.where(F.col("place") < 2 * CENTRE_ROWS * _SPREAD // max(1, n_rows))
    for row in some.orderBy("place").limit(CENTRE_ROWS).select("embedding").collect():
        sample.setdefault(len(row[0]), []).append(row[0])
    return {dim: np.mean(np.array(part, np.float64), axis=0) for dim, part in sample.items()}


def encoded(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths and sums of absolute rotated components of the vectors in ``x``."""
    rest = x - centre
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.where(length > 0, length, 1)[:, None]) @ rotation(x.shape[1]).T
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(1)


def waves(rows: int, first: int = FIRST) -> list[int]:
    """Up to which place each wave reaches."""
    ends, reach = [], first
    while reach < rows:
        ends.append(_SPREAD * reach // rows)
        reach *= GROWTH
    return [*ends, _SPREAD]


def index(vectors: DataFrame, first: int = FIRST) -> tuple[DataFrame, int, dict[int, np.ndarray]]:
    """The written index of all vectors that take part, by wave; the number of waves; the centres."""
    rows = sound(vectors)
    n_rows = rows.count()
    centre, ends = centres(rows, n_rows), waves(n_rows, first)
    middle = rows.sparkSession.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_dim(batch):
                x = matrix(part.column("embedding"), dim)
                code, length, total = encoded(x, middle.value.get(dim, np.zeros(dim)))
                wave = np.searchsorted(np.array(ends), part.column("place").to_numpy(), side="right")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"),
                        part.column("embedding"),
                        part.column("dim"),
                        pa.array([bytes(c) for c in code], pa.binary()),
                        pa.array(length),
                        pa.array(total),
                        pa.array(wave.astype(np.int32)),
                    ],
                    names=["vec_id", "embedding", "dim", "code", "length", "total", "wave"],
                )

    kind = rows.schema["embedding"].dataType.simpleString()
    schema = f"vec_id bigint, embedding {kind}, dim int, code binary, length double, total double, wave int"
    return written(rows.mapInArrow(run, schema), "wave"), len(ends), centre


class Queries:
    """The queries of one length, turned for estimates, with the least score that still counts."""

    def __init__(self, numbers: list[int], ids: list[int], x: np.ndarray, least: list[float], centre: np.ndarray):
        self.number, self.id, self.x = np.array(numbers, np.int32), np.array(ids, np.int64), x
        self.least = np.array(least, np.float64)
        self.norm = np.linalg.norm(x, axis=1)
        unit = x / self.norm[:, None]
        self.turned = (unit @ rotation(x.shape[1]).T).astype(np.float32)
        self.sum = self.turned.sum(1)
        with np.errstate(over="ignore"):
            self.base = (unit @ centre).astype(np.float32)
        self.far = float(np.linalg.norm(centre))


class Nearest:
    """The ``k`` nearest rows that a task has met, for each of some queries of one length."""

    def __init__(self, queries: Queries, k: int):
        self.q, self.k, self.least = queries, k, queries.least.copy()
        self.at = np.zeros(0, np.int64)
        self.score, self.id, self.no_id = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, batch: pa.RecordBatch) -> None:
        """Estimate the products of all queries with the rows of a batch, and rerank what may be near."""
        q, dim = self.q, self.q.x.shape[1]
        x = matrix(batch.column("embedding"), dim)
        bits = rotation(dim).shape[0]
        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        length, total = batch.column("length").to_numpy(), batch.column("total").to_numpy()
        ids = batch.column("vec_id")
        no_id, ids = ids.is_null().to_numpy(False), ids.fill_null(0).to_numpy()
        safe = np.where(total > 0, total, 1)
        shared = np.clip(safe / sqrt(bits), 1e-3, 1)
        doubt = DEVIATIONS * np.sqrt((1 - shared**2) / (bits - 1)) / shared
        doubt = (np.minimum(length, 1e30) * (doubt + 1e-5) + min(q.far, 1e30) * 1e-5).astype(np.float32)
        doubt[(length + q.far > 1e30) | (length < 1e-30) & (length > 0)] = np.inf  # beyond single precision: rerank
        factor = (np.minimum(length, 1e30) / safe).astype(np.float32)
        for top in range(0, len(x), _ROWS):
            rows = slice(top, top + _ROWS)
            signs = np.unpackbits(code[rows], axis=1).astype(np.float32)
            for first in range(0, len(q.x), _QUERIES):
                own = slice(first, first + _QUERIES)
                bound = signs @ q.turned[own].T
                bound *= 2
                bound -= q.sum[own]
                bound *= factor[rows, None]
                bound += q.base[own]
                bound += doubt[rows, None]
                low = (self.least[own] / q.norm[own]).astype(np.float32)
                row, query = np.nonzero(~(bound < low - np.abs(low) * np.float32(1e-6)))
                for at in range(0, len(row), _PAIRS):
                    self._rerank(x, row[at : at + _PAIRS] + top, query[at : at + _PAIRS] + first, ids, no_id)
                self._cut()

    def _rerank(self, x: np.ndarray, row: np.ndarray, query: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        other = no_id[row] | (ids[row] != self.q.id[query])
        row, query = row[other], query[other]
        left, right = x[row], self.q.x[query]
        near = np.einsum("ij,ij->i", left, right)
        slack = 1e-9 * np.linalg.norm(left, axis=1) * self.q.norm[query]
        close = np.flatnonzero(~(near < self.least[query] - slack))
        score = np.zeros(len(close))
        for k in range(x.shape[1]):  # component by component, so that a product is the same wherever it is formed
            score += left[close, k] * right[close, k]
        row, query = row[close], query[close]
        self.at, self.score = np.concatenate([self.at, query]), np.concatenate([self.score, score])
        self.id, self.no_id = np.concatenate([self.id, ids[row]]), np.concatenate([self.no_id, no_id[row]])
        if len(self.at) > self.k * len(self.q.x) + 4 * _PAIRS:
            self._cut()

    def _cut(self) -> None:
        """Drop what is not among the nearest of its query, and raise the limits of full queries."""
        order = np.lexsort((self.id, self.no_id, -self.score, self.at))
        at = self.at[order]
        starts = np.searchsorted(at, np.arange(len(self.q.x)))
        rank = np.arange(len(at)) - starts[at]
        kept, last = order[rank < self.k], order[rank == self.k - 1]
        self.least[self.at[last]] = np.maximum(self.least[self.at[last]], self.score[last])
        self.at, self.score, self.id, self.no_id = (v[kept] for v in (self.at, self.score, self.id, self.no_id))

    def found(self) -> pa.RecordBatch:
        keep = self.score >= self.q.least[self.at]
        at = self.at[keep]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.q.number[at]),
                pa.array(self.q.id[at]),
                pa.array(self.id[keep], mask=self.no_id[keep]),
                pa.array(self.score[keep]),
            ],
            names=["query", "query_id", "vec_id", "score"],
        )


def _searched(rows: DataFrame, queries: Broadcast, k: int) -> DataFrame:
    """What each task finds for the queries among its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, Nearest] = {}
        for batch in batches:
            for dim, part in by_dim(batch):
                if dim in queries.value:
                    near.setdefault(dim, Nearest(queries.value[dim], k)).add(part)
        for one in near.values():
            yield one.found()

    return rows.mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _set_found(rows: DataFrame, n_waves: int, queries: list, centre: dict[int, np.ndarray], k: int) -> DataFrame:
    """The ``k`` nearest of a set of queries, wave by wave."""
    context = rows.sparkSession.sparkContext
    least = np.full(len(queries), -np.inf)
    groups: dict[int, list[int]] = {}
    for number, (_, embedding) in enumerate(queries):
        groups.setdefault(len(embedding), []).append(number)
    best = None
    for wave in range(n_waves):
        turned = context.broadcast(
            {
                dim: Queries(
                    numbers,
                    [queries[n][0] for n in numbers],
                    np.array([queries[n][1] for n in numbers], np.float64),
                    [least[n] for n in numbers],
                    centre.get(dim, np.zeros(dim)),
                )
                for dim, numbers in groups.items()
            }
        )
        found = _searched(rows.where(F.col("wave") == wave), turned, k)
        best = written(_best(found if best is None else best.drop("rank").union(found), k))
        turned.destroy()
        if wave < n_waves - 1:
            for row in best.where(F.col("rank") == k).select("query", "score").collect():
                least[row["query"]] = row["score"]
    return best


def nearest(
    vectors: DataFrame, is_query: Column | str, k: int = NEIGHBOURS, first: int = FIRST, set_values: int = SET_VALUES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner products for each query row."""
    rows, n_waves, centre = index(vectors, first)
    asked = rows.where(is_query).select("vec_id", "embedding", "dim").distinct()
    sets = -(-(asked.agg(F.sum("dim")).first()[0] or 0) // set_values)
    number = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(max(1, sets))).cast("int").alias("number")
    asked = written(asked.select("vec_id", "embedding", number), "number")
    found = []
    for number in range(sets):
        queries = asked.where(F.col("number") == number).select("vec_id", "embedding").collect()
        if queries:
            found.append(_set_found(rows, n_waves, queries, centre, k))
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return reduce(DataFrame.union, found).select("query_id", "rank", "vec_id", "score")
