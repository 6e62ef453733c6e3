"""Nearest neighbours by rotated one-bit codes, against brute force."""

import random

import numpy as np
import pytest

from tradewind.llm import rotated_codes

FOLDER = "/root/testdata"
QUERY = "vec_id % 20 = 0"


def table(spark, rows, kind="float"):
    """Vectors with columns that the operator has names for itself."""
    clashing = "score double, rank int, code string, length string, wave int, place string, label int"
    filled = [(i, v, 1.0, 2, "code", "length", 3, "place", 4) for i, v in rows]
    return spark.createDataFrame(filled, f"vec_id bigint, embedding array<{kind}>, {clashing}").repartition(5)


def brute(rows, every=20, k=20):
    """Query id to the (score, id) of its nearest, in plain loops over double products."""
    sound = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in sound:
        if i is None or i % every:
            continue
        scored = []
        for j, v in sound:
            if len(v) == len(q) and j != i:
                score = 0.0
                for a, b in zip(q, v, strict=True):
                    score += a * b
                scored.append((-score, j is None, j or 0, j))
        out[i] = [(-s, j) for s, _, _, j in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for row in df.collect():
        out.setdefault(row["query_id"], []).append((row["rank"], row["score"], row["vec_id"]))
    for rows in out.values():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1))
    return {q: [(s, j) for _, s, j in rows] for q, rows in out.items()}


def gaussian(n, dim, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32).astype(float)
    return [(i, row) for i, row in enumerate(x.tolist())]


@pytest.mark.parametrize("options", [{}, {"first": 8}, {"first": 8, "set_values": 20}])
def test_equals_brute_force(spark, options):
    """Also over several waves and several sets of queries."""
    rows = gaussian(400, 6)
    assert found(rotated_codes.nearest(table(spark, rows), QUERY, **options)) == brute(rows)


def test_copies_and_ties(spark):
    """A third of the rows are one vector; equal scores go by id, over waves and tasks alike."""
    rows = gaussian(120, 4) + [(1000 + i, [0.5, -1.0, 2.0, 0.25]) for i in range(60)]
    assert found(rotated_codes.nearest(table(spark, rows), QUERY, first=8)) == brute(rows)


def test_off_centre(spark):
    """A large common part, which the centre takes off."""
    rows = [(i, np.float32(np.array(v) + 100).tolist()) for i, v in gaussian(300, 8)]
    assert found(rotated_codes.nearest(table(spark, rows), QUERY, first=32)) == brute(rows)


def test_extreme_lengths(spark):
    rng = random.Random(3)
    rows = [(i, [x * 10.0 ** rng.choice([-38, -3, 0, 3, 40]) for x in v]) for i, v in gaussian(200, 5)]
    got, wanted = found(rotated_codes.nearest(table(spark, rows, "double"), QUERY, first=16)), brute(rows)
    assert got == wanted


def test_awkward_vectors(spark):
    good = gaussian(60, 3)
    bad = [
        (100, None), (120, []), (140, [0.0, 0.0, 0.0]), (160, [1.0, None, 2.0]), (180, [float("nan"), 1.0, 1.0]),
        (200, [float("inf"), 1.0, 1.0]), (220, [1.0, 2.0]), (240, [3.0, -1.0]), (None, [9.0, 9.0, 9.0]),
        (None, [9.0, 9.0, 9.0]), (None, None), (260, [1.0]),
    ]
    rows = good + bad
    got, wanted = found(rotated_codes.nearest(table(spark, rows), QUERY)), brute(rows)
    assert wanted.pop(260) == [] and got == wanted
    assert got[220] == [(1.0, 240)]


def test_fewer_than_k(spark):
    rows = gaussian(7, 3)
    got = found(rotated_codes.nearest(table(spark, rows), QUERY))
    assert got == brute(rows) and len(got[0]) == 6


def test_repeated_ids(spark):
    """Rows that share an id are no candidates for each other; rows alike are one query."""
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0])]
    got = rotated_codes.nearest(table(spark, rows), QUERY).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [
        (20, 1, 3, 1.0), (20, 1, 3, 2.0), (20, 2, 3, 1.0), (20, 2, 3, 2.0),
    ]


def test_nothing_to_search(spark):
    assert rotated_codes.nearest(table(spark, []), QUERY).collect() == []
    assert rotated_codes.nearest(table(spark, [(1, [1.0])]), QUERY).collect() == []


def test_estimates_keep_their_bounds():
    """The bound of an estimate holds for all but one pair in thousands, and estimates are unbiased."""
    x = np.array([v for _, v in gaussian(2000, 64, 5)])
    code, length, total = rotated_codes.encoded(x, np.zeros(64))
    turn = rotated_codes.rotation(64)
    q = np.array([v for _, v in gaussian(20, 64, 6)])
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    signs = np.unpackbits(code, axis=1) * 2.0 - 1
    estimate = (length / total)[:, None] * (signs @ (turn @ q.T))
    shared = total / np.sqrt(len(turn))
    sigma = length * np.sqrt((1 - shared**2) / (len(turn) - 1)) / shared
    error = (estimate - x @ q.T) / sigma[:, None]
    assert abs(error.mean()) < 0.05 and 0.8 < error.std() < 1.1
    assert (error < -rotated_codes.DEVIATIONS).mean() < 2e-4


def test_recall_on_the_test_table(spark):
    """Several waves of the sf0.1 table; at least 0.9 is asked for."""
    vectors = spark.read.parquet(f"{FOLDER}/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.select("vec_id", "embedding").collect()]
    got = found(rotated_codes.nearest(vectors, QUERY, first=64))
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    hits = asked = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = x @ x[at]
        score[at] = -np.inf
        truth = set(ids[np.argsort(-score, kind="stable")[:20]].tolist())
        hits += len(truth & {j for _, j in got[ids[at]]})
        asked += len(truth)
    assert hits >= 0.99 * asked
