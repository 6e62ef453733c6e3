"""Embedding near-dedup by collision counting on one-dimensional projections.

Unit vectors of cosine c or more lie within ``sqrt(2 - 2c)`` of each other, and their projections on a
random Gaussian direction differ by a normal variable of that deviation. Two vectors collide on a
direction if one lies in the window centred on the other's projection. Per pair, the collisions on
``PROJECTIONS`` directions are counted; the count that a pair has to pass is calibrated from the binomial
law, so that a pair just at the threshold passes with probability ``1 - MISS``. Passing pairs are
verified by their cosine in double precision.

Which pairs are counted is decided by sorting as well: several times, into tables, vectors are sorted by label and
by their cells on further directions, cells of ``CELL`` deviations with a random offset. The collisions are
counted within each run of equal cells. A pair at the threshold shares a run of one table with probability
p = (1 - 0.8 / CELL) ** directions, and two unrelated vectors do in ``STRANGERS`` ** directions. So many
directions are taken that a vector meets about ``MATES`` strangers in a table, and then so many tables that a
pair at the threshold is missed by all with a probability of at most ``LOST``: both follow the logarithm of the number of
distinct vectors of the largest label, and pairs counted grow little faster than vectors. A vector carries its cells
of all tables, and a pair is counted only in the first table in which it meets.

Equal vectors of a label are folded before, by value. Crowded runs are split into blocks, and each pair of blocks is
a run of its own. A task passes on, for each vector, how many others it links with, and a spanning forest
of the links, never all pairs.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose label
is null, links with nothing and is its own component. Vectors of different lengths never link. Rows that
share an id are rows of their own, each linked by its vector; a row without an id counts as a link of
others and has as component the smallest id it reaches. Columns other than ``vec_id``, ``embedding`` and
``label`` are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, erf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import forest, mixed, paired_blocks, pairs_in_runs, whole_runs, written
from tradewind.llm.components import components

MIN_COSINE = 0.98
PROJECTIONS = 32
WINDOW = 2.5
MISS = 1e-6
CELL = 8.0
STRANGERS = 0.41
MATES = 24
LOST = 1e-5
BLOCK = 1024
_RUN = ["label", "dim", "table", "cell"]
_PAIRS = 1 << 18


@lru_cache(8)
def _counted(dim: int) -> np.ndarray:
    """The directions on which collisions are counted, for one vector length."""
    return np.random.default_rng(dim).standard_normal((dim, PROJECTIONS))


@lru_cache(8)
def _sorted(dim: int, tables: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions by which tables are sorted, and the offsets of their cells."""
    rng = np.random.default_rng([dim, tables, each])
    return rng.standard_normal((dim, tables * each)), rng.random(tables * each)


def layout(most: int) -> tuple[int, int]:
    """(tables, directions of each) for at most so many distinct vectors of one label."""
    each = max(1, ceil(log(max(1.0, most / MATES)) / -log(STRANGERS)))
    shared = (1 - 0.8 / CELL) ** each
    return ceil(log(LOST) / log(1 - shared)), each


def required_collisions(miss: float = MISS) -> int:
    """The largest count that a pair at the threshold reaches with probability 1 - ``miss``."""
    p = erf(WINDOW / sqrt(2))
    below = 0.0
    for count in range(PROJECTIONS + 1):
        below += comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if below > miss:
            return count
    return PROJECTIONS


def _cells(unit: np.ndarray, min_cosine: float, tables: int, each: int) -> np.ndarray:
    """The cell of each vector in each table, as one number."""
    directions, offsets = _sorted(unit.shape[1], tables, each)
    width = CELL * sqrt(2 - 2 * min_cosine)
    cells = np.floor(unit @ directions / width + offsets).astype(np.int64).view(np.uint64)
    out = np.zeros((len(unit), tables), np.uint64)
    for k in range(each):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, k::each])
    return out.view(np.int64)


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_dim(table, column: str = "dim"):
    """The parts of a table or batch that have one vector length."""
    dims = table.column(column).to_numpy()
    for dim in np.unique(dims):
        yield int(dim), table.take(pa.array(np.flatnonzero(dims == dim)))


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as (vec_id, label, embedding), null where nothing can link, and the numbered classes of equal vectors."""
    embedding = F.col("embedding")
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    linkable = F.col("label").isNotNull() & finite & F.exists(embedding, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(linkable, F.col("label")).alias("label"), F.when(linkable, embedding).alias("embedding"))
    classes = (
        rows.where("embedding IS NOT NULL")
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    return rows, written(classes)


def _filed(classes: DataFrame, min_cosine: float, tables: int, each: int) -> DataFrame:
    """Each distinct vector under its cell in every table, with its cells of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                x = _vectors(part.column("embedding"), dim)
                cells = _cells(x / np.linalg.norm(x, axis=1, keepdims=True), min_cosine, tables, each)
                carried = pa.array([row.tobytes() for row in cells], pa.binary())
                for table in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("label"),
                            part.column("dim"),
                            pa.array(np.full(len(x), table, np.int32)),
                            pa.array(cells[:, table]),
                            part.column("node"),
                            part.column("copies"),
                            part.column("embedding"),
                            carried,
                        ],
                        names=[*_RUN, "node", "copies", "embedding", "cells"],
                    )

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    dim = F.size("embedding").alias("dim")
    return classes.select("label", dim, "node", "copies", "embedding").mapInArrow(
        run,
        f"label {kinds['label']}, dim int, table int, cell bigint, node bigint, copies bigint,"
        f" embedding {kinds['embedding']}, cells binary",
    )


def _linked(runs: pa.Table, dim: int, min_cosine: float) -> pa.RecordBatch:
    """What the links within whole runs add to each vector, and a spanning forest of them."""
    x = _vectors(runs.column("embedding"), dim)
    norm = np.linalg.norm(x, axis=1)
    unit = x / norm[:, None]
    distance = sqrt(2 - 2 * min_cosine)
    projected = (unit @ _counted(dim)).astype(np.float32)
    cells = np.frombuffer(b"".join(runs.column("cells").to_pylist()), np.int64).reshape(len(x), -1)
    earlier, table = np.arange(cells.shape[1]), runs.column("table").to_numpy()
    node, copies = runs.column("node").to_numpy(), runs.column("copies").to_numpy()
    needed, links = required_collisions(), np.zeros(len(x), np.int64)
    a = b = np.zeros(0, np.int64)
    for left_, right_ in pairs_in_runs(runs, _RUN):
        for at in range(0, len(left_), _PAIRS):
            left, right = left_[at : at + _PAIRS], right_[at : at + _PAIRS]
            collisions = np.zeros(len(left), np.int8)
            for k in range(PROJECTIONS):
                own = projected[:, k]
                collisions += np.abs(own[left] - own[right]) <= WINDOW * distance
                if k % 8 == 7:  # pairs that cannot reach the count any more go
                    able = collisions + (PROJECTIONS - 1 - k) >= needed
                    left, right, collisions = left[able], right[able], collisions[able]
            cosine = np.einsum("ij,ij->i", x[left], x[right]) / (norm[left] * norm[right])
            close = cosine >= min_cosine
            left, right = left[close], right[close]
            met = (cells[left] == cells[right]) & (earlier < table[left][:, None])
            first = ~met.any(1)
            left, right = left[first], right[first]
            np.add.at(links, left, copies[right])
            np.add.at(links, right, copies[left])
            a, b = np.concatenate([a, node[left]]), np.concatenate([b, node[right]])
        if len(a) > 4 * len(x):
            a, b = forest(a, b)
    a, b = forest(a, b)
    some = links > 0
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([a, node[some]])),
            pa.array(np.concatenate([b, node[some]])),
            pa.array(np.concatenate([np.zeros(len(a), np.int64), links[some]])),
        ],
        names=["a", "b", "links"],
    )


def near_links(classes: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(a, b, links): links between distinct vectors, and as a = b how many rows a vector links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in whole_runs(batches, [*_RUN, "row", "col"]):
            for dim, part in _by_dim(runs):
                yield _linked(part, dim, min_cosine)

    kinds = classes.groupBy("label", F.size("embedding").alias("dim")).count()
    tables, each = layout(kinds.agg(F.max("count")).first()[0] or 0)
    dealt = paired_blocks(_filed(classes, min_cosine, tables, each), _RUN, "node", BLOCK)
    return dealt.mapInArrow(run, "a bigint, b bigint, links bigint")


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows, classes = distinct_vectors(vectors)
    links = written(near_links(classes, min_cosine))
    labels = components(links.where("a != b").select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    placed = written(
        classes.join(labels, classes["node"] == labels["node"], "left")
        .select(classes["node"], "least", "copies", F.coalesce(labels["label"], classes["node"]).alias("top"))
        .join(counts.withColumnRenamed("a", "node"), "node", "left")
        .select("node", "least", "top", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    tops = written(placed.groupBy("top").agg(F.min("least").alias("component")))
    found = written(placed.join(tops, "top").select("node", "n_links", "component"))
    found = classes.join(found, "node").select("label", "embedding", "n_links", "component")
    component = F.coalesce("component", "vec_id")
    return rows.join(found, ["label", "embedding"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.cast("bigint").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
