import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.samples import by_id, documents, words
from tradewind.llm import quality

DATA = "/root/testdata/sf0.01"


def _sample(n=240):
    """Prose and shouted, symbol-ridden junk, with labels for two thirds of the rows."""
    rng = random.Random(4)
    texts, labels = [], []
    for k in range(n):
        own = words(rng, rng.randrange(20, 120), 5000)
        bad = rng.random() < 0.3
        texts.append("!! ".join(w.upper() for w in own) if bad else " ".join(own) + ".")
        if rng.random() < 0.67:
            labels.append((k, int(not bad), 0))
    return texts, labels


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found = by_id(quality.classify(docs, labels))
    assert len(found) == docs.count()
    judged = [(found[r["doc_id"]], r["quality"]) for r in labels.collect()]
    held = [(row, q) for row, q in judged if row["held_out"]]
    assert len(held) > 50
    assert sum(row["predicted"] == q for row, q in held) / len(held) >= 0.95
    good, bad = ([row["score"] for row, q in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.98


def test_columns_and_held_out_rows(spark):
    texts, labels = _sample()
    docs = documents(spark, [*texts, None, ""])
    found = by_id(quality.classify(docs, _labels(spark, labels)))
    for i, row in found.items():
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.3)
    assert found[len(texts)]["score"] == found[len(texts) + 1]["score"]
    assert all(found[i]["predicted"] == q for i, q, _ in labels)


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    texts, labels = _sample()
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 1) for i, q, _ in labels]
    one = by_id(quality.classify(documents(spark, texts), _labels(spark, labels)))
    two = by_id(quality.classify(documents(spark, texts, langs=["xx"] * len(texts)), _labels(spark, flipped)))
    assert {i: r["score"] for i, r in one.items()} == pytest.approx({i: r["score"] for i, r in two.items()})


@pytest.mark.parametrize("rows", [[], [(0, 1, 0), (1, 1, 0)], [(None, 0, None), (3, None, None)]])
def test_without_labels_of_both_kinds(spark, rows):
    docs = documents(spark, ["a b c", None, "", "X!!"])
    found = by_id(quality.classify(docs, _labels(spark, rows)))
    assert {(r["score"], r["predicted"]) for r in found.values()} == {(0.5, 1)}


def test_null_and_repeated_ids_and_empty_table(spark):
    texts, labels = _sample()
    docs = documents(spark, [*texts, texts[0], texts[0]], ids=[*range(len(texts)), None, 0])
    found = quality.classify(docs, _labels(spark, labels)).collect()
    assert len({r["score"] for r in found if r["doc_id"] in (None, 0)}) == 1
    assert quality.classify(docs.limit(0), _labels(spark, labels)).collect() == []


def test_keep_good_keeps_columns_and_good_rows(spark):
    texts, labels = _sample()
    docs = documents(spark, texts)
    kept = quality.keep_good(docs, _labels(spark, labels))
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in quality.classify(docs, _labels(spark, labels)).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.where(F.col("row") == F.concat(F.lit("row of "), "doc_id")).collect()} == good


def test_weights_minimise_the_pair_loss():
    """The gradient of the logistic loss on feature differences vanishes at the fitted weights."""
    rng = np.random.default_rng(1)
    label = np.repeat([0, 1], 15)
    x = rng.normal(size=(30, quality.WIDTH)) + label[:, None] * 0.3
    model = quality.fit_ranking(x, label)
    z = quality._spread((x - model.mean) / model.scale)
    # every pair is a preference here, since there are fewer pairs than the bound
    loss = lambda w: 1.5 * w @ w + np.logaddexp(0, -(z[label == 1] @ w)[:, None] + (z[label == 0] @ w)[None, :]).sum()
    best = loss(model.weights)
    for _ in range(40):
        assert loss(model.weights + 1e-3 * rng.normal(size=len(model.weights))) >= best


def test_very_long_text():
    assert np.isfinite(quality.features(b"word " * 400_000)).all()
