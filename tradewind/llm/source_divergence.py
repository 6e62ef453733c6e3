"""Audit of how far the sources of a language diverge in their terms, with the text of terms joined last.

Tasks count terms by 64-bit digest and write the counts (language, source, digest, occurrences); one row of a term in a
language also holds its name (term, documents), in columns that are read apart. What is shuffled to find the kept terms,
to count them and to rank them are digests and numbers. Names are read for the digests that enough documents hold, and
their text joins the output last, for the terms whose value reaches the least one that is reported. Within a task, terms
are cut, numbered and counted as whole arrays.

Digests may collide. Where the smallest and the largest name of a digest differ, it stands for several terms. Such
digests are split: the documents are read again, counts are taken by term for those digests, and whether a term is kept
is judged after that. A collision can only add documents to a digest, so no kept term is missed.

Shares of terms that a source lacks are all the same, so only counts above zero are stored. For the pairs of sources,
terms are dealt into bundles of about ``TERMS`` terms of a language and tiles of ``TILE`` by ``TILE`` sources; a task
sums the differences of one bundle in a matrix, and terms without a count in a tile are added in the end by
their number.

Arithmetic is on whole numbers, in DECIMAL where 64 bits may not do. Defined results: null text, language and source
read as empty. Repeated rows, with the same id or not, are documents of their own; ids are not read. In a language
without kept terms each pair has the value 0. A language with one source has no pairs. Terms of equal value are
ranked by their bytes. Columns other than ``text``, ``lang`` and ``source`` are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import raw, whole_runs, written

MIN_DOCUMENTS = 30
TOP = 50
SCALE = 1_000_000_000
ADDED = 5
BITS = 64
TERMS = 1024
TILE = 512
_HELD = 6_000_000
_BLOCK = 1 << 22
_ROWS = 1 << 16

#: ASCII letters in lower case stay, other ASCII separates, non-ASCII stays.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _words(texts: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The lower-cased terms of some texts, and how many each text has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    start, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not size:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    folded = np.frombuffer(texts.buffers()[2][start : start + size].to_pybytes().translate(_FOLD), np.uint8)
    inside = folded != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    bounds = offsets - start
    first = bounds[bounds < size]
    begins[first] = inside[first]
    letters = folded[inside]
    ends = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return found, np.diff(np.searchsorted(np.flatnonzero(begins), bounds))


class _Tally(NamedTuple):
    """Counts by term and group, sorted by both; ``term`` and ``group`` are places in ``terms`` and ``groups``.

    ``groups`` are (lang, source) in ascending order.
    """

    groups: list[tuple[str, str]]
    terms: pa.BinaryArray
    group: np.ndarray
    term: np.ndarray
    n: np.ndarray
    docs: np.ndarray


def _counted(owners: list[tuple[str, str]], words: list[pa.BinaryArray], sizes: list[np.ndarray]) -> _Tally:
    """The tally of documents, given the group of each, their terms and how many each has."""
    found = pa.chunked_array(words, pa.binary()).dictionary_encode()
    term = np.concatenate([chunk.indices.to_numpy() for chunk in found.chunks]).astype(np.int64)
    groups = sorted(set(owners))
    number = {owner: k for k, owner in enumerate(groups)}
    group = np.array([number[owner] for owner in owners])
    # Documents are numbered by group, so that one sort brings together the terms, their groups and their documents.
    order = np.argsort(group, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    bits = len(owners).bit_length()
    key = term << bits | np.repeat(place, np.concatenate(sizes))
    key.sort()
    term, group = key >> bits, group[order][key & (1 << bits) - 1]
    fresh = np.append(True, key[1:] != key[:-1])
    rows = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (group[1:] != group[:-1])))
    n = np.diff(np.append(rows, len(key)))
    in_docs = np.add.reduceat(fresh, rows, dtype=np.int64)
    return _Tally(groups, found.chunk(0).dictionary, group[rows], term[rows], n, in_docs)


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[_Tally]:
    """Tallies of about ``_HELD`` words of whole documents at a time."""
    owners: list[tuple[str, str]] = []
    words: list[pa.BinaryArray] = []
    sizes: list[np.ndarray] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, source = (batch.column(k).to_pylist() for k in ("lang", "source"))
        texts = batch.column("text").fill_null(b"")
        until = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // _BLOCK
        starts = [0, *(np.flatnonzero(until[1:] != until[:-1]) + 1).tolist(), len(texts)]
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            found, counts = _words(texts.slice(start, end - start))
            owners += [(lang[k], source[k]) for k in (start + np.flatnonzero(counts)).tolist()]
            words.append(found)
            sizes.append(counts[counts > 0])
            held += len(found)
            if held > _HELD:
                yield _counted(owners, words, sizes)
                owners, words, sizes, held = [], [], [], 0
    if held:
        yield _counted(owners, words, sizes)


def _digests(found: pa.BinaryArray, bits: int) -> np.ndarray:
    return np.fromiter(
        (xxhash.xxh64_intdigest(t) >> 64 - bits for t in found.to_pylist()), np.uint64, len(found)
    ).view(np.int64)


def _batches(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    for start in range(0, len(whole), _ROWS):
        yield whole.slice(start, _ROWS)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*_read_as_empty(), raw(F.col("text")).alias("text"))


def _read_as_empty() -> list[Column]:
    return [F.coalesce(name, F.lit("")).alias(name) for name in ("lang", "source")]


def tallied(docs: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, digest, n) and names (lang, digest, term, docs) of each task, written.

    A name is the term of a digest; ``docs`` are the documents of the language that have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tally in _tallies(batches):
            langs, sources = (pa.array([group[k] for group in tally.groups], pa.string()) for k in (0, 1))
            number = np.unique([group[0] for group in tally.groups], return_inverse=True)[1][tally.group]
            # The first row of a term in a language holds its name.
            named = np.append(True, (tally.term[1:] != tally.term[:-1]) | (number[1:] != number[:-1]))
            in_docs = np.zeros(len(named), np.int64)
            in_docs[named] = np.add.reduceat(tally.docs, np.flatnonzero(named))
            order = np.argsort(tally.group.astype(np.int32), kind="stable")
            group, term, unnamed = pa.array(tally.group[order]), tally.term[order], ~named[order]
            yield from _batches(
                {
                    "lang": langs.take(group),
                    "source": sources.take(group),
                    "digest": pa.array(_digests(tally.terms, bits)[term]),
                    "n": pa.array(tally.n[order]),
                    "term": tally.terms.take(pa.array(term, mask=unnamed)).cast(pa.string()),
                    "docs": pa.array(in_docs[order], mask=unnamed),
                }
            )

    schema = "lang string, source string, digest bigint, n bigint, term string, docs bigint"
    tally = written(_texts(docs).mapInArrow(run, schema))
    return (
        tally.select("lang", "source", "digest", "n"),
        tally.where("docs IS NOT NULL").select("lang", "digest", "term", "docs"),
    )


def tallied_by_term(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, source, digest, split, n, docs): the counts of each task by term, which ``split`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tally in _tallies(batches):
            langs, sources = (pa.array([group[k] for group in tally.groups], pa.string()) for k in (0, 1))
            group = pa.array(tally.group)
            yield from _batches(
                {
                    "lang": langs.take(group),
                    "source": sources.take(group),
                    "digest": pa.array(_digests(tally.terms, bits)[tally.term]),
                    "split": tally.terms.take(pa.array(tally.term)).cast(pa.string()),
                    "n": pa.array(tally.n),
                    "docs": pa.array(tally.docs),
                }
            )

    schema = "lang string, source string, digest bigint, split string, n bigint, docs bigint"
    return _texts(docs).mapInArrow(run, schema)


def kept_terms(docs: DataFrame, min_documents: int, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, digest, split, term) and their counts (lang, source, digest, split, n), written.

    ``split`` is empty but for terms whose digest stands for several; there it is the term itself.
    """
    key = ["lang", "digest"]
    counts, names = tallied(docs, bits)
    frequent = names.groupBy(*key).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents)
    frequent = written(frequent.select(*key))
    names = names.join(frequent.hint("shuffle_hash"), key, "left_semi")
    names = written(names.groupBy(*key).agg(F.min("term").alias("least"), F.max("term").alias("greatest")))
    single, mixed = names.where("least = greatest").select(*key), names.where("least <> greatest").select(*key)
    kept = names.where("least = greatest").select(*key, F.lit("").alias("split"), F.col("least").alias("term"))
    counts = counts.join(single.hint("shuffle_hash"), key, "left_semi")
    counts = counts.groupBy(*key, "source").agg(F.sum("n").alias("n")).withColumn("split", F.lit(""))
    if not mixed.isEmpty():
        apart = tallied_by_term(docs, bits).join(mixed, key, "left_semi")
        apart = written(apart.groupBy(*key, "split", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        own = apart.groupBy(*key, "split").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents)
        own = written(own.select(*key, "split"))
        kept = kept.union(own.select(*key, "split", F.col("split").alias("term")))
        counts = counts.unionByName(apart.drop("docs").join(own, [*key, "split"], "left_semi"))
    return written(kept), written(counts)


def share(n: str, all_n: str, v: str) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (all_n + ADDED * v)), exact."""
    above = f"CAST({n} + {ADDED} AS DECIMAL(19, 0)) * CAST({SCALE} AS DECIMAL(10, 0))"
    return F.expr(f"1 + ({above}) div CAST({all_n} + {ADDED} * {v} AS DECIMAL(19, 0))")


def sized(docs: DataFrame, kept: DataFrame, counts: DataFrame) -> DataFrame:
    """Each (lang, source) with its number in the language, how many terms are kept and occur, and its least share."""
    groups = docs.select(*_read_as_empty()).distinct()
    terms_of = kept.groupBy("lang").agg(F.count("*").alias("v"))
    occur = counts.groupBy("lang", "source").agg(F.sum("n").alias("all_n"))
    return written(
        groups.join(terms_of, "lang", "left")
        .join(occur, ["lang", "source"], "left")
        .na.fill(0, ["v", "all_n"])
        .withColumn("base", F.when(F.col("v") > 0, share("0L", "all_n", "v")))
        .withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        .withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    )


def _differences(run: pa.Table, tile: int) -> pa.RecordBatch:
    """Sums over the terms of a run of the differences between its two tiles' sources, and how many terms those are."""
    i, p = run.column("i").to_numpy(), run.column("p").to_numpy()
    base = run.column("digest").is_null().to_numpy(zero_copy_only=False)
    sides, at = [], []
    for number in (run.column("low")[0].as_py(), run.column("high")[0].as_py()):
        inside = i // tile == number
        own = np.sort(i[base & inside])
        sides.append(own)
        least = np.zeros(len(own), np.int64)
        least[np.searchsorted(own, i[base & inside])] = p[base & inside]
        at.append((inside & ~base, least))
    digest, split = run.column("digest").to_numpy()[~base], run.column("split").to_numpy()[~base]
    term = np.zeros(len(i), np.int64)
    if len(digest):
        term[~base] = np.concatenate([[0], np.cumsum((digest[1:] != digest[:-1]) | (split[1:] != split[:-1]))])
    size = int(term.max()) + 1 if len(digest) else 0
    matrices = []
    for own, (here, least) in zip(sides, at, strict=True):
        shares = np.tile(least, (size, 1))
        shares[term[here], np.searchsorted(own, i[here])] = p[here]
        matrices.append(shares)
    rows = [np.abs(matrices[1] - matrices[0][:, k : k + 1]).sum(0) for k in range(len(sides[0]))]
    left, right = np.meshgrid(*sides, indexing="ij")
    pairs = left < right
    value = np.array(rows, np.int64).reshape(left.shape)[pairs]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([run.column("lang")[0].as_py()] * len(value), pa.string()),
            pa.array(left[pairs].astype(np.int32)),
            pa.array(right[pairs].astype(np.int32)),
            pa.array(value),
            pa.array(np.full(len(value), size, np.int64)),
        ],
        names=["lang", "i", "j", "value", "seen"],
    )


def pair_values(counts: DataFrame, sizes: DataFrame, terms_each: int = TERMS, tile: int = TILE) -> DataFrame:
    """(lang, i, j, value, seen): the summed differences of sources i < j over ``seen`` of the kept terms."""
    run_key = ["lang", "bundle", "low", "high"]
    bundles = F.greatest(F.lit(1), F.ceil(F.col("v") / terms_each)).cast("int")
    entries = counts.join(sizes, ["lang", "source"]).select(
        "lang",
        "i",
        "sources",
        F.pmod(F.xxhash64("digest", "split"), bundles).cast("int").alias("bundle"),
        "digest",
        "split",
        share("n", "all_n", "v").alias("p"),
    )
    least = sizes.where("v > 0").select(
        "lang",
        "i",
        "sources",
        F.explode(F.sequence(F.lit(0), bundles - 1)).alias("bundle"),
        F.lit(None).cast("bigint").alias("digest"),
        F.lit(None).cast("string").alias("split"),
        F.col("base").alias("p"),
    )
    own = F.expr(f"i div {tile}")
    dealt = (
        entries.union(least)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(sources - 1) div {tile}"))))
        .withColumns({"low": F.least(own, "other"), "high": F.greatest(own, "other")})
        .select(*run_key, "digest", "split", "i", "p")
        .repartition(*run_key)
        .sortWithinPartitions(*run_key, "digest", "split", "i")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, run_key):
            keys = [table.column(k).to_numpy(zero_copy_only=False) for k in run_key]
            change = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            starts = [0, *(np.flatnonzero(change) + 1).tolist(), len(table)]
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                yield _differences(table.slice(start, end - start), tile)

    found = dealt.mapInArrow(run, "lang string, i int, j int, value bigint, seen bigint")
    return found.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))


def pair_part(counts: DataFrame, sizes: DataFrame, terms_each: int = TERMS, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) of all pairs of sources of a language."""
    left = sizes.select("lang", "v", "i", F.col("source").alias("one"), F.col("base").alias("base_one"))
    right = sizes.select("lang", F.col("i").alias("j"), F.col("source").alias("two"), F.col("base").alias("base_two"))
    found = written(
        left.join(right, "lang")
        .where("i < j")
        .join(written(pair_values(counts, sizes, terms_each, tile)), ["lang", "i", "j"], "left")
        .select(
            "lang",
            "one",
            "two",
            F.expr(
                "coalesce(value, 0) + coalesce((v - coalesce(seen, 0)) * abs(base_one - base_two), 0)"
            ).alias("value"),
        )
    )
    both = found.select("lang", F.col("one").alias("source"), F.col("two").alias("item"), "value").union(
        found.select("lang", "two", "one", "value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def term_part(kept: DataFrame, counts: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """(lang, source, part, item, value, rank) of the terms that a group has more of than its language."""
    key, group = ["lang", "digest", "split"], ["lang", "source"]
    lang_sizes = sizes.groupBy("lang").agg(F.sum("all_n").alias("all_n"), F.max("v").alias("v"))
    totals = counts.groupBy(*key).agg(F.sum("n").alias("n")).join(lang_sizes, "lang")
    totals = written(totals.select(*key, share("n", "all_n", "v").alias("q")))
    shares = counts.join(sizes, group).select(*group, "digest", "split", share("n", "all_n", "v").alias("p"))
    values = written(
        shares.join(totals, key).where("p > q").select(*group, "digest", "split", (F.col("p") - F.col("q")).alias("value"))
    )
    falling = Window.partitionBy(*group).orderBy(F.desc("value"))
    least = (
        values.groupBy(*group, "value")
        .agg(F.count("*").alias("m"))
        .withColumn("at", F.row_number().over(falling))
        .where(F.col("at") <= top)
        .withColumn("before", F.sum("m").over(falling) - F.col("m"))
        .where(F.col("before") < top)
        .groupBy(*group)
        .agg(F.min("value").alias("least"))
    )
    reported = written(values.join(written(least), group).where("value >= least").drop("least"))
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "term")
    return (
        reported.join(kept, key)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )


def audit(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    top: int = TOP,
    bits: int = BITS,
    terms_each: int = TERMS,
    tile: int = TILE,
) -> DataFrame:
    """Both parts of the audit.

    Fewer ``bits`` make digests collide; that and the size of bundles and tiles change the work but no result.
    """
    kept, counts = kept_terms(docs, min_documents, bits)
    sizes = sized(docs, kept, counts)
    return pair_part(counts, sizes, terms_each, tile).union(term_part(kept, counts, sizes, top))
