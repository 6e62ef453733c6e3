import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.samples import by_id, documents, words
from tradewind.llm import substring_dedup


def _words(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in (text or "").split(" ") if w]


def _brute(texts, window=35):
    split = [_words(t) for t in texts]
    starts = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for own in split:
        gone = set()
        for k in range(len(own) - window + 1):
            if starts[tuple(own[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out.append((len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def _sample(seed, n=50):
    """Texts with shared passages around 35 words, near copies, copies, periods and few words."""
    rng = random.Random(seed)
    passages = [words(rng, k) for k in (34, 35, 36, 50, 120, 300)] + [["a"] * 50, ["a", "b"] * 40]
    texts = [None, "", " \n", "x", " ".join(passages[3]), "\n".join(passages[3])]
    for _ in range(n):
        own = words(rng, rng.randrange(120))
        for _ in range(rng.randrange(3)):
            part = list(rng.choice(passages))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(own) + 1)
            own[at:at] = part
        texts.append(rng.choice([" ", "\n", " \t"]).join(own))
        if rng.random() < 0.1:
            texts.append(texts[-1])
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_brute_force(spark, seed):
    texts = _sample(seed)
    wanted = _brute(texts)
    assert any(0 < w[1] < w[0] for w in wanted)
    got = by_id(substring_dedup.report(documents(spark, texts)))
    for i, row in enumerate(wanted):
        assert tuple(got[i])[1:4] == row, i
        assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == row[1]


def test_null_and_repeated_ids(spark):
    a, b = (" ".join(words(random.Random(k), 60)) for k in (1, 2))
    texts, ids = [a, a, b, f"x {b} y", a, None], [1, 1, 2, 2, None, None]
    got = sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in substring_dedup.report(documents(spark, texts, ids=ids)).collect())
    assert got == sorted(str((i, *w)) for i, w in zip(ids, _brute(texts), strict=True))


def test_equal_rows_alone_repeat_each_other(spark):
    text = " ".join(words(random.Random(4), 40))
    docs = documents(spark, [text, text], ids=[3, 3])
    assert [r["n_removed"] for r in substring_dedup.report(docs).collect()] == [40, 40]


def test_empty_table(spark):
    assert substring_dedup.report(documents(spark, []).limit(0)).collect() == []


def test_equal_windows_choose_equal_seeds(monkeypatch):
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 1 << 60, 90).astype(np.uint64)
    texts = [np.concatenate([rng.integers(0, 1 << 60, k).astype(np.uint64), passage]) for k in (0, 13, 200)]
    for stretch in (1 << 16, 10):
        monkeypatch.setattr(substring_dedup, "_STRETCH", stretch)
        chosen = []
        for k, text in zip((0, 13, 200), texts, strict=True):
            marks, first, windows = substring_dedup.seeds(text)
            assert windows.sum() == len(text) - 34
            chosen.append(np.repeat(marks, windows)[k:].tolist())
        assert chosen[0] == chosen[1] == chosen[2]


def test_stretch_hashes_depend_on_words_alone():
    words_ = np.arange(50, dtype=np.uint64) % 7
    start, size = np.array([0, 7, 14, 1]), np.array([20, 20, 20, 20])
    a, b, c, d = substring_dedup._stretches(words_, start, size)
    assert a == b == c != d


def test_rows_whose_first_hash_collides(spark, monkeypatch):
    """All rows share the first half of their name; the second half keeps them apart."""
    rng = random.Random(8)
    shared = words(rng, 50)
    texts = [" ".join(words(rng, rng.randrange(80)) + shared * (k % 2) + words(rng, rng.randrange(200))) for k in range(20)]
    docs = documents(spark, texts)
    wanted = by_id(substring_dedup.report(docs))
    second = substring_dedup.row_names()[1]
    monkeypatch.setattr(substring_dedup, "row_names", lambda: [F.lit(7).cast("bigint").alias("row"), second])
    assert by_id(substring_dedup.report(docs)) == wanted
    assert sum(row["n_removed"] for row in wanted.values()) >= 500
