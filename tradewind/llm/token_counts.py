"""Token counts as an exact length histogram.

Every whole text is encoded with a byte-level BPE vocabulary, and documents are aggregated by their
number of tokens. Suffix sums over the histogram give, for a context limit, how many documents are
longer and how many tokens remain if each document is cut there; prefix sums give quantiles. The
histogram holds every length once, so the answers are exact for every limit, not for a preset list.

Lengths are folded on the map side before they are shuffled. The sums run in two steps, within bands of
``BAND`` lengths and over the totals of the bands, so no task holds more than ``BAND`` lengths or one row
per band.

Defined results: null and empty texts have 0 tokens and count as documents. Repeated rows count each.
Columns other than ``text`` are ignored. An empty table gives an empty histogram, for which every total
is 0 and every quantile NULL.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BAND = 256


@lru_cache(2)
def _encoder(vocabulary: str, pattern: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """The number of tokens of a text column."""

    @F.pandas_udf(T.LongType())
    def counted(texts: pd.Series) -> pd.Series:
        encode = _encoder(vocabulary, pattern).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return counted(text)


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each length."""
    lengths = docs.select(n_tokens(F.col("text"), vocabulary, pattern).alias("n_tokens"))
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def with_sums(lengths: DataFrame) -> DataFrame:
    """Add to each length of a histogram what holds for a context limit of that many tokens.

    ``docs_within`` and ``docs_over`` count the documents that fit and those that are longer;
    ``tokens_kept`` is the total after cutting each document at the limit, ``tokens_total`` the uncut
    total; ``quantile`` is the share of documents that fit.
    """
    # Written, for both readers below: a row per length, while the texts behind it are encoded once.
    banded = written(lengths).select(
        "n_tokens",
        "n_docs",
        (F.col("n_docs") * F.col("n_tokens")).alias("tokens"),
        F.floor(F.col("n_tokens") / BAND).alias("band"),
    )
    totals = banded.groupBy("band").agg(F.sum("n_docs").alias("band_docs"), F.sum("tokens").alias("band_tokens"))
    all_bands = Window.orderBy("band")
    before = all_bands.rowsBetween(Window.unboundedPreceding, -1)
    whole = all_bands.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    offsets = totals.select(
        "band",
        F.coalesce(F.sum("band_docs").over(before), zero).alias("docs_before"),
        F.coalesce(F.sum("band_tokens").over(before), zero).alias("tokens_before"),
        F.sum("band_docs").over(whole).alias("docs_total"),
        F.sum("band_tokens").over(whole).alias("tokens_total"),
    )
    up_to = Window.partitionBy("band").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = banded.join(offsets, "band").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_before") + F.sum("n_docs").over(up_to)).alias("docs_within"),
        (F.col("tokens_before") + F.sum("tokens").over(up_to)).alias("tokens_within"),
        "docs_total",
        "tokens_total",
    )
    over = F.col("docs_total") - F.col("docs_within")
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_within",
        over.alias("docs_over"),
        (F.col("tokens_within") + over * F.col("n_tokens")).alias("tokens_kept"),
        "tokens_total",
        (F.col("docs_within") / F.col("docs_total")).alias("quantile"),
    )


def at_limits(lengths: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_within, docs_over, tokens_kept, tokens_lost) for limits of any value."""
    n, docs = F.col("n_tokens"), F.col("n_docs")
    none = F.lit(0).cast("bigint")
    answers = [
        F.struct(
            F.lit(limit).cast("bigint").alias("context"),
            F.coalesce(F.sum(F.when(n <= limit, docs)), none).alias("docs_within"),
            F.coalesce(F.sum(F.when(n > limit, docs)), none).alias("docs_over"),
            F.coalesce(F.sum(docs * F.least(n, F.lit(limit))), none).alias("tokens_kept"),
            F.coalesce(F.sum(docs * F.greatest(n - limit, F.lit(0))), none).alias("tokens_lost"),
        )
        for limit in sorted(set(limits))
    ]
    return lengths.agg(F.array(*answers).alias("answers")).select(F.inline("answers"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length within which each share of the documents lies."""
    answers = [
        F.struct(
            F.lit(float(share)).alias("share"),
            F.min(F.when(F.col("docs_within") >= share * F.col("docs_total"), F.col("n_tokens"))).alias("n_tokens"),
        )
        for share in shares
    ]
    whole = sums.withColumn("docs_total", F.col("docs_within") + F.col("docs_over"))
    return whole.agg(F.array(*answers).alias("answers")).select(F.inline("answers"))
