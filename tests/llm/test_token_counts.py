import random

from tokenizers import Tokenizer

from tests.llm.samples import documents, words
from tradewind.llm import token_counts


def _sample():
    rng = random.Random(2)
    return [None, "", " ", "é😀"] + [" ".join(words(rng, rng.choice([3, 7, 50, 900]))) for _ in range(60)]


def _lengths(texts):
    """Another library's encoder over the same vocabulary."""
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    return [len(other.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]


def test_sums_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BAND", 64)
    texts = _sample()
    lengths = _lengths(texts)
    rows = token_counts.with_sums(token_counts.histogram(documents(spark, texts))).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(lengths))
    for r in rows:
        k = r["n_tokens"]
        within = sum(n <= k for n in lengths)
        assert (r["n_docs"], r["docs_within"], r["docs_over"]) == (lengths.count(k), within, len(lengths) - within)
        assert (r["tokens_kept"], r["tokens_total"]) == (sum(min(n, k) for n in lengths), sum(lengths))
        assert r["quantile"] == within / len(lengths)


def test_any_limit_and_quantile(spark):
    texts = _sample()
    lengths = sorted(_lengths(texts))
    counted = token_counts.histogram(documents(spark, texts))
    for r in token_counts.at_limits(counted, [0, 1, 10, 77, 10**6]).collect():
        k = r["context"]
        assert r["docs_within"] == sum(n <= k for n in lengths) == len(lengths) - r["docs_over"]
        assert r["tokens_kept"] == sum(min(n, k) for n in lengths) == sum(lengths) - r["tokens_lost"]
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    for r in token_counts.quantiles(token_counts.with_sums(counted), shares).collect():
        assert r["n_tokens"] == min(n for n in lengths if sum(m <= n for m in lengths) >= r["share"] * len(lengths))


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a b", "a b", None], ids=[1, 1, None])
    assert {tuple(r) for r in token_counts.histogram(docs).collect()} == {(2, 2), (0, 1)}
    none = token_counts.histogram(docs.limit(0))
    assert token_counts.with_sums(none).collect() == []
    assert [r["docs_within"] for r in token_counts.at_limits(none, [5]).collect()] == [0]
    assert [r["n_tokens"] for r in token_counts.quantiles(token_counts.with_sums(none), [0.5]).collect()] == [None]
