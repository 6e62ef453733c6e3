"""What the text operators share: written intermediate tables and Arrow batches of whole texts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch, one row at least. Each task holds several copies of a batch, in the JVM's own memory outside
#: its heap and in the Python worker, and neither gives all of it back.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session cuts Arrow batches at ``BATCH_BYTES`` from now on unless it was told a size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode without it, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tradewind-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no rerun.

    Columns in ``by`` partition the files and come last. The shuffle files of the write are no longer needed then, and Spark is told to remove them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    with _shuffles_removed(spark):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of each query that ends meanwhile."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def raw(text: Column) -> Column:
    """UTF-8 bytes of a text column."""
    return text.cast("binary")


def crc_mod(doc_id: Column, n: int) -> Column:
    """CRC-32 of the id written as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def lower_hex(number: Column) -> Column:
    """A BIGINT as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def arrow_map(
    df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """Apply ``rows`` to each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch)

    return bounded_batches(df).mapInArrow(run, schema)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive entries of ``h``."""
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15 + 2 * seed) + h[k : k + len(out)]
    return mixed(out)


def paired_blocks(members: DataFrame, group: list[str], member: str, block: int) -> DataFrame:
    """Deal the members of each group so that any two of them meet in one sorted run of bounded size.

    A group of more than ``block`` members is split by hash into blocks, and each pair of blocks is a run
    of its own, with the key ``(*group, row, col)``; ``side`` tells the block of a member: 1 the row, 2 the
    column, 3 if they are the same. Two members of a run are a pair of their own if their sides or to 3.
    """
    crowded = written(
        members.groupBy(*group)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > block)
        .select(*group, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    blocks = F.coalesce("blocks", F.lit(1))
    own, other = F.col("own"), F.col("other")
    return (
        members.join(crowded, group, "left")
        .select(
            *members.columns,
            F.pmod(F.xxhash64(member), blocks).cast("int").alias("own"),
            F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
        )
        .select(
            *members.columns,
            F.least(own, other).alias("row"),
            F.greatest(own, other).alias("col"),
            F.when(own == other, 3).when(own < other, 1).otherwise(2).alias("side"),
        )
        .repartition(*group, "row", "col")
        .sortWithinPartitions(*group, "row", "col", member)
    )


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        last = np.logical_and.reduce([v == v[-1] for v in values])
        start = batch.num_rows - int(last[::-1].argmin()) if not last.all() else 0
        if not start and held and any(h.column(k)[-1] != batch.column(k)[-1] for h in held[-1:] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def pairs_in_runs(table: pa.Table, keys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the runs of a table from ``paired_blocks``, as positions, distance by distance."""
    values = [table.column(k).to_numpy() for k in [*keys, "row", "col"]]
    change = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
    run = np.concatenate([[0], np.cumsum(change)])
    side = table.column("side").to_numpy()
    here, step = np.arange(len(run)), 0
    while True:
        step += 1
        here = here[: np.searchsorted(here, len(run) - step)]
        here = here[run[here] == run[here + step]]
        if not len(here):
            return
        own = here[side[here] | side[here + step] == 3]
        yield own, own + step


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node it reaches) that join what the links a-b join."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for end in (label[left], label[right], left, right):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
