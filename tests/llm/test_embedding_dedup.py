import numpy as np
import pytest

from tests.llm.samples import by_id
from tradewind.llm import embedding_dedup


def _brute(rows):
    """(n_links, component) of each row of (vec_id, vector, label)."""
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is None or la != lb or a is None or b is None or len(a) != len(b):
                continue
            a, b = (np.array([np.nan if x is None else x for x in v], np.float32).astype(float) for v in (a, b))
            if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any():
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((len(links[i]), min(ids) if ids else None))
    return out


def _sample(seed, dim=16):
    """Clusters of near copies, exact copies and lone vectors, in shuffled order."""
    rng = np.random.default_rng(seed)
    vectors = []
    for size in [1] * 20 + [2, 3, 5, 8, 60]:
        centre = rng.normal(size=dim)
        for _ in range(size):
            noise = rng.normal(size=dim) * rng.choice([0, 0.03, 0.08, 0.14])
            vectors.append(((centre + noise * np.linalg.norm(centre) / np.sqrt(dim)) * rng.choice([1, 3])).tolist())
    order = rng.permutation(len(vectors))
    return [(int(i), vectors[k], int(rng.integers(0, 2))) for i, k in enumerate(order)]


ODD = [
    (900, None, 1),
    (901, [0.0] * 16, 1),
    (902, [None] + [1.0] * 15, 1),
    (903, [float("nan")] * 16, 1),
    (904, [float("inf")] + [1.0] * 15, 1),
    (905, [1.0] * 16, None),
    (906, [1.0] * 8, 1),
    (907, [2.0] * 8, 1),
    (908, [], 1),
    (909, [1.0] * 16, 1),
]


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = _sample(seed) + ODD
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<float>, label int, node string, links string")
    got = by_id(embedding_dedup.near_duplicates(df.repartition(3)), "vec_id")
    wanted = _brute(rows)
    assert sum(n for n, _ in wanted) > 500
    for (i, _, _), (n, component) in zip(rows, wanted, strict=True):
        assert got[i].asDict() == {"vec_id": i, "n_links": n, "component_id": component, "kept": i == component}


def test_recall_at_the_threshold(spark):
    """Pairs of cosine just above 0.98, among unrelated vectors: all are found."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, (0.9801 * a + np.sqrt(1 - 0.9801**2) * b).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(df).where("n_links = 1").count() == 800


def test_null_and_repeated_ids_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 0), (5, v, 0), (None, v, 0), (8, [3.0, -1.0, 0.0], 0), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted(str(tuple(r)) for r in embedding_dedup.near_duplicates(df).collect())
    wanted = [(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (8, 0, 8, True), (None, 0, None, False)]
    assert got == sorted(map(str, wanted))
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_calibrated_count():
    assert 20 <= embedding_dedup.required_collisions() < embedding_dedup.PROJECTIONS
    assert embedding_dedup.required_collisions(0.5) > embedding_dedup.required_collisions(1e-9)


def _pairs_counted(n, dim=64):
    """Pairs that share a run of some table, among strangers, and the number of tables."""
    x = np.random.default_rng(n).normal(size=(n, dim))
    cells = embedding_dedup._cells(x / np.linalg.norm(x, axis=1, keepdims=True), 0.98, *embedding_dedup.layout(n))
    sizes = [np.unique(column, return_counts=True)[1] for column in cells.T]
    return sum(int((s * (s - 1) // 2).sum()) for s in sizes), cells.shape[1]


def test_pairs_counted_follow_the_rows():
    """A hundred times the rows make a hundred times the pairs, but for the number of tables."""
    (small, few), (large, many) = _pairs_counted(500), _pairs_counted(50_000)
    assert many < 3 * few
    assert large < 1.5 * 100 * small * many / few
    assert large / 50_000 < embedding_dedup.MATES * many


def test_layout_keeps_the_recall():
    for most in (0, 1, 500, 50_000, 10**9):
        tables, each = embedding_dedup.layout(most)
        assert (1 - (1 - 0.8 / embedding_dedup.CELL) ** each) ** tables <= embedding_dedup.LOST


def test_vectors_are_told_apart_by_value(spark):
    """Classes of equal vectors are found by value and numbered, so no hash can merge strangers."""
    rows = [(k, [float(k % 7), 1.0, 2.0], k % 2) for k in range(70)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    _, classes = embedding_dedup.distinct_vectors(df)
    found = classes.collect()
    assert len(found) == len({r["node"] for r in found}) == 14 and {r["copies"] for r in found} == {5}
