"""Merkle manifest of a document table: a tree of fan-out 8 for each language, and one over their roots.

A leaf is the SHA-256 of a row's fields. The leaves of a language stand in the order of their ids, numbered without
gaps from a range partitioning: a task numbers its own sorted part, and the counts of the parts before are added.
Trees are stored by blocks, aligned subtrees over ``8 ** HEIGHT`` consecutive nodes. The roots of the blocks are the
nodes of the next tier, and so on until one is left, so a language of any size is built in bounded pieces.

Within a block, digests lie in van Emde Boas order: a tree of L levels is cut at half height into a top tree of
L // 2 levels and the trees below it, each stored whole, top first, and each cut again the same way. ``addresses``
is that order by arithmetic. Building a block and reading the siblings of a node use nothing else, and a path
touches few cache lines or pages whatever their size is.

A proof is read from the stored blocks: the siblings within the leaf's block, then those of the block's root one
tier up, then those of the language's root. Upper paths go to the blocks of the tier below as one row a block, never
to single documents.

Defined results: null fields are ``-``, empty ones are not. Rows without an id come first in their language. Rows
that share an id are ordered by digest; rows alike in every field are interchangeable leaves of their own. A null
language is a group of its own, before the empty name. A leaf that has no siblings on any level has the digest of no
input as its proof. Columns other than the five fields are ignored. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import whole_runs, written

FAN = 8
HEIGHT = 4
_RUN = ["tree", "block"]
_PATH = "array<struct<before:string,after:string>>"


def size(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


@lru_cache(None)
def addresses(levels: int, depth: int) -> np.ndarray:
    """Where the nodes of a depth (0: the root) lie in the van Emde Boas order of a full tree."""
    if levels == 1:
        return np.zeros(1, np.int64)
    top = levels // 2
    if depth < top:
        return addresses(top, depth)
    below = addresses(levels - top, depth - top)
    return size(top) + (np.arange(FAN**top)[:, None] * size(levels - top) + below).ravel()


def digest(*parts: str) -> str:
    """H: SHA-256 of the parts one after another, as hexadecimal text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height_of(nodes: int, of_all: int, most: int = HEIGHT) -> int:
    """Levels above the nodes of a block: all of them if the tree has other blocks, else as many as it takes."""
    if of_all > FAN**most:
        return most
    height = 0
    while FAN**height < nodes:
        height += 1
    return height


class Block:
    """An aligned subtree whose digests lie in van Emde Boas order, 32 bytes each; those that do not exist are zero."""

    def __init__(self, nodes: bytes | bytearray, height: int, leaves: int):
        self.nodes, self.height, self.leaves = nodes, height, leaves

    @classmethod
    def over(cls, digests: list[str], height: int) -> Block:
        block = cls(bytearray(32 * size(height + 1)), height, len(digests))
        level = digests
        for above in range(height + 1):
            for at, node in zip(addresses(height + 1, height - above).tolist(), level, strict=False):
                block.nodes[32 * at : 32 * at + 32] = bytes.fromhex(node)
            if above < height:
                level = [digest(*level[k : k + FAN]) for k in range(0, len(level), FAN)]
        return block

    @property
    def root(self) -> str:
        return bytes(self.nodes[:32]).hex()

    def level(self, above: int) -> list[str]:
        """The digests so many levels above the leaves, in order."""
        count = -(-self.leaves // FAN**above)
        places = 32 * addresses(self.height + 1, self.height - above)[:count]
        return [self.nodes[at : at + 32].hex() for at in places.tolist()]

    def siblings(self, leaf: int) -> list[tuple[str, str]]:
        """The siblings before and after a leaf's ancestors, from the leaf up to below the root."""
        path = []
        for above in range(self.height):
            own, count = leaf // FAN**above, -(-self.leaves // FAN**above)
            first = own - own % FAN
            places = addresses(self.height + 1, self.height - above)[first : min(first + FAN, count)]
            run = [self.nodes[32 * at : 32 * at + 32].hex() for at in places.tolist()]
            path.append(("".join(run[: own - first]), "".join(run[own - first + 1 :])))
        return path

    def all_siblings(self) -> list[list[tuple[str, str]]]:
        """``siblings`` of every leaf; what leaves have in common is formed once."""
        above: list[list[tuple[str, str]]] = [[]]
        for level in range(self.height - 1, -1, -1):
            nodes, found = self.level(level), []
            for first in range(0, len(nodes), FAN):
                run = "".join(nodes[first : first + FAN])
                for k in range(0, len(run), 64):
                    found.append([(run[:k], run[k + 64 :]), *above[first // FAN]])
            above = found
        return above


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings on its path give."""
    for before, after in path:
        leaf = digest(before, leaf, after)
    return leaf


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """H of a row's fields, each as byte count, colon and value, or as a dash if null."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


def tampered_text(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(tree, doc_id, leaf, changed) of every row; ``changed`` is the leaf after tampering, null elsewhere.

    ``tree`` stands for the language and has its order, null first.
    """
    fields = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")]
    return docs.select(
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("."), "lang")).alias("tree"),
        "doc_id",
        F.unhex(leaf_digest(*fields)).alias("leaf"),
        F.when(tampered, F.unhex(leaf_digest(*fields[:4], tampered_text(fields[4])))).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their position within ``tree`` by ``order`` and the number of rows of the tree.

    ``rows`` have to be read from a table, and the last column of ``order`` has to differ between rows, so that
    ranges can be cut anywhere.
    """
    names = ["tree", *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("tree").to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            place = np.zeros(len(key), np.int64)
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                if key[start] != tree:
                    tree, seen = key[start], 0
                place[start:end] = np.arange(seen, seen + end - start)
                seen += end - start
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *names).sortWithinPartitions(*names)
    dealt = dealt.withColumn("part", F.spark_partition_id())
    placed = written(dealt.mapInArrow(run, f"{kinds}, part int, place bigint"))
    before = Window.partitionBy("tree").orderBy("part")
    counts = (
        placed.groupBy("tree", "part")
        .agg(F.count("*").alias("own"))
        .select(
            "tree",
            "part",
            (F.sum("own").over(before) - F.col("own")).alias("before"),
            F.sum("own").over(Window.partitionBy("tree")).alias("of_all"),
        )
    )
    return placed.join(written(counts), ["tree", "part"]).select(
        *rows.columns, (F.col("before") + F.col("place")).alias("place"), "of_all"
    )


def _dealt(nodes: DataFrame, most: int) -> DataFrame:
    """Nodes by block, in order."""
    block = F.expr(f"place div {FAN**most}").alias("block")
    return nodes.withColumn("block", block).repartition(*_RUN).sortWithinPartitions(*_RUN, "place")


def _single_runs(table: pa.Table) -> Iterator[pa.Table]:
    """The blocks of a table of whole runs."""
    tree, block = (table.column(k).to_numpy(zero_copy_only=False) for k in _RUN)
    starts = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (block[1:] != block[:-1])]))
    for start, end in zip(starts, [*starts[1:], len(tree)], strict=True):
        yield table.slice(start, end - start)


def _hexes(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    return [None if value is None else value.hex() for value in column.to_pylist()]


def built(nodes: DataFrame, carried: list[str], most: int) -> DataFrame:
    """The blocks of ``most`` levels over numbered nodes (tree, place, of_all, leaf), one row each, written.

    Columns in ``carried`` become arrays in the order of the nodes.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = "tree string, block bigint, of_all bigint, height int, leaves int, nodes binary, root binary"
    schema += "".join(f", {name} array<{kinds[name]}>" for name in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, _RUN):
            for part in _single_runs(table):
                of_all = part.column("of_all")[0].as_py()
                block = Block.over(_hexes(part.column("leaf")), height_of(len(part), of_all, most))
                row = {
                    "tree": part.column("tree")[0].as_py(),
                    "block": part.column("block")[0].as_py(),
                    "of_all": of_all,
                    "height": block.height,
                    "leaves": block.leaves,
                    "nodes": bytes(block.nodes),
                    "root": bytes.fromhex(block.root),
                }
                columns = [
                    pa.array([row["tree"]]),
                    pa.array([row["block"]], pa.int64()),
                    pa.array([row["of_all"]], pa.int64()),
                    pa.array([row["height"]], pa.int32()),
                    pa.array([row["leaves"]], pa.int32()),
                    pa.array([row["nodes"]], pa.binary()),
                    pa.array([row["root"]], pa.binary()),
                ]
                for name in carried:
                    values = part.column(name).combine_chunks()
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), values))
                yield pa.RecordBatch.from_arrays(columns, names=[*row, *carried])

    return written(_dealt(nodes, most).mapInArrow(run, schema))


@dataclass(frozen=True)
class Manifest:
    """Stored trees: tiers[0] holds the blocks over documents, each next tier those over the block roots below.

    ``top`` is the same over the roots of the languages; ``most`` is the height of a full block.
    """

    tiers: list[DataFrame]
    top: list[DataFrame]
    most: int

    @property
    def subroots(self) -> DataFrame:
        """(tree, leaf): the root of each language's tree."""
        return _roots(self.tiers, self.most)

    @property
    def root(self) -> str | None:
        row = _roots(self.top, self.most).first()
        return None if row is None else row["leaf"].hex()


def _roots(tiers: list[DataFrame], most: int) -> DataFrame:
    """(tree, leaf): the root of each tree, from the tier at which it has a single block."""
    found = None
    for tier in tiers:
        own = tier.where(F.col("of_all") <= FAN**most).select("tree", F.col("root").alias("leaf"))
        found = own if found is None else found.union(own)
    return found


def _tiers(nodes: DataFrame, carried: list[str], most: int) -> list[DataFrame]:
    """Blocks over the nodes, over their roots, and so on until every tree has a single block."""
    tiers, several = [built(nodes, carried, most)], F.col("of_all") > FAN**most
    while not tiers[-1].where(several).isEmpty():
        count = F.expr(f"(of_all + {FAN**most - 1}) div {FAN**most}").alias("of_all")
        above = tiers[-1].where(several)
        above = above.select("tree", F.col("block").alias("place"), count, F.col("root").alias("leaf"))
        tiers.append(built(above, [], most))
    return tiers


def manifest(docs: DataFrame, tampered: Column, most: int = HEIGHT) -> Manifest:
    """The stored trees of ``docs``; ``tampered`` tells the rows whose altered leaf is kept beside them."""
    nodes = numbered(written(leaves(docs, tampered)), "doc_id", "leaf", "row")
    tiers = _tiers(nodes, ["doc_id", "leaf", "changed"], most)
    roots = _roots(tiers, most).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "leaf")
    top = _tiers(numbered(written(roots), "of"), ["of"], most)
    return Manifest(tiers, top, most)


def _below(blocks: DataFrame, emit: Callable[[pa.RecordBatch, dict, Block], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``emit`` to each stored block with the path above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                row = one.select([n for n in one.schema.names if n not in ("doc_id", "of", "leaf", "changed")])
                row = row.to_pylist()[0]
                row["path"] = [(step["before"], step["after"]) for step in row["path"]]
                yield emit(one, row, Block(row["nodes"], row["height"], row["leaves"]))

    return blocks.mapInArrow(run, schema)


def _steps(paths: list[list[tuple[str, str]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.array([[{"before": b, "after": a} for b, a in path] for path in paths], kind)


def _root_paths(blocks: DataFrame, most: int) -> DataFrame:
    """(tree, block, path, subroot) of the nodes of blocks above the lowest tier, which are blocks themselves."""

    def emit(one: pa.RecordBatch, row: dict, block: Block) -> pa.RecordBatch:
        first = row["block"] * FAN**most
        return pa.RecordBatch.from_arrays(
            [
                pa.array([row["tree"]] * block.leaves, pa.string()),
                pa.array(range(first, first + block.leaves), pa.int64()),
                _steps([path + row["path"] for path in block.all_siblings()]),
                pa.array([row["subroot"]] * block.leaves, pa.string()),
            ],
            names=["tree", "block", "path", "subroot"],
        )

    return _below(blocks, emit, f"tree string, block bigint, path {_PATH}, subroot string")


def _with_paths(tiers: list[DataFrame], roots: DataFrame | None, most: int) -> DataFrame:
    """The lowest blocks with the path above each; ``roots`` has the path above each tree, if any, and its root."""
    paths = None
    none = {"path": F.expr(f"CAST(array() AS {_PATH})"), "subroot": F.lit("")}
    for tier in reversed(tiers):
        single = tier.where(F.col("of_all") <= FAN**most)
        blocks = single.withColumns(none) if roots is None else single.join(roots, "tree")
        if paths is not None:
            blocks = blocks.unionByName(tier.where(F.col("of_all") > FAN**most).join(paths, _RUN))
        if tier is not tiers[0]:
            paths = written(_root_paths(blocks, most))
    return blocks


def _tree_paths(stored: Manifest) -> DataFrame:
    """(tree, path, subroot): the path above the root of each language's tree, and that root."""

    def emit(one: pa.RecordBatch, row: dict, block: Block) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                one.column("of").flatten(),
                _steps([path + row["path"] for path in block.all_siblings()]),
                pa.array(block.level(0), pa.string()),
            ],
            names=["tree", "path", "subroot"],
        )

    return _below(_with_paths(stored.top, None, stored.most), emit, f"tree string, path {_PATH}, subroot string")


def verified(stored: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of the manifest."""
    root = stored.root
    blocks = _with_paths(stored.tiers, written(_tree_paths(stored)), stored.most)
    doc_id = blocks.schema["doc_id"].dataType.elementType.simpleString()

    def emit(one: pa.RecordBatch, row: dict, block: Block) -> pa.RecordBatch:
        above = "".join(before + after for before, after in row["path"])
        proofs, folded, own = [], [], _hexes(one.column("leaf").flatten())
        for leaf, other, path in zip(own, _hexes(one.column("changed").flatten()), block.all_siblings(), strict=True):
            proofs.append(digest(*(part for step in path for part in step), above))
            folded.append(fold(leaf if other is None else other, path + row["path"]))
        texts = [own, [row["subroot"]] * len(own), [root] * len(own), proofs, folded]
        return pa.RecordBatch.from_arrays(
            [
                one.column("doc_id").flatten(),
                *(pa.array(column, pa.string()) for column in texts),
                pa.array([found == root for found in folded], pa.bool_()),
            ],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )

    return _below(
        blocks.select("height", "leaves", "nodes", "doc_id", "leaf", "changed", "path", "subroot"),
        emit,
        f"doc_id {doc_id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string,"
        " verified boolean",
    )


def tampering(docs: DataFrame) -> Column:
    """The rows whose id, as text, has a CRC-32 that 3 divides."""
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0


def report(docs: DataFrame, most: int = HEIGHT) -> DataFrame:
    """Leaves, proofs and the root that each proof gives, for every row, some of them tampered with."""
    return verified(manifest(docs, tampering(docs), most))
