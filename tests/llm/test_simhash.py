import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.samples import by_id, documents, words
from tradewind.llm import common, simhash
from tradewind.llm.components import components


def _brute_fingerprint(text):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_components(fps, ids):
    """Smallest id reachable for each position."""
    top = list(range(len(fps)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                top[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            root = find(k)
            least[root] = min(least.get(root, i), i)
    return [least.get(find(k)) for k in range(len(fps))]


def _sample():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "One", "one", "ONE two", "a b c", "A  b\nC", "x y z w", "É é É"]
    for _ in range(20):
        base = words(rng, rng.choice([60, 200, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            near = list(base)
            for _ in range(rng.randrange(3)):
                near[rng.randrange(len(near))] = "new"
            texts.append("  ".join(near))
    return texts


def test_report_equals_brute_force(spark):
    texts = _sample()
    fps = [_brute_fingerprint(t) for t in texts]
    tops = _brute_components(fps, range(len(texts)))
    got = by_id(simhash.near_duplicates(documents(spark, texts)))
    assert len(set(tops)) < len(set(fps))
    for i in range(len(texts)):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fps[i]:016x}", tops[i])


def test_shingles_beyond_one_chunk(monkeypatch):
    text = " ".join(words(random.Random(1), 500)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(text) == whole


def test_every_pair_within_three_bits_meets():
    assert len(simhash._POSITIONS) == 14
    for bytes_ in ((a, b, c) for a in range(8) for b in range(8) for c in range(8)):
        assert any(not set(group) & set(bytes_) for group in simhash._POSITIONS)


@pytest.mark.parametrize("block", [1024, 3])
def test_links_join_the_same_fingerprints_as_brute_force(spark, monkeypatch, block):
    """Chains of near fingerprints, in lists that are split into blocks or not."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(block)
    fps = []
    for _ in range(6):
        now = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            fps.append(now)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                now ^= 1 << int(b)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    labels = {r["node"]: r["label"] for r in components(simhash.near_links(df)).collect()}
    got = {}
    for k, f in enumerate(signed):
        got.setdefault(labels.get(f, f), set()).add(k)
    wanted = {}
    for k, top in enumerate(_brute_components(fps, range(len(fps)))):
        wanted.setdefault(top, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_dense_group_passes_on_a_forest_only(spark):
    """Several hundred fingerprints that are all near to each other make no more links than entries."""
    fps = [(1 << a) | (1 << b) for a in range(30) for b in range(a)]  # up to 4 bits apart
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    assert simhash.near_links(df).count() <= 14 * len(fps)
    assert components(simhash.near_links(df)).select("label").distinct().count() == 1


def test_null_and_repeated_ids(spark):
    same = " ".join(words(random.Random(2), 80))
    docs = documents(spark, [same, same, same, "alone here", None, same], ids=[7, 5, 5, 9, None, None])
    got = sorted(str((r["doc_id"], r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted(map(str, [(7, 5), (5, 5), (5, 5), (9, 9), (None, 5), (None, None)]))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "9", "None", "None"]


def test_repeated_ids_with_unlike_texts(spark):
    """A row is kept for its group, not for its id."""
    rng = random.Random(4)
    one, two, three = (" ".join(words(rng, 80)) for _ in range(3))
    docs = documents(spark, [one, two, one, three, two, three], ids=[1, 1, 2, 3, 3, 3])
    for partitions in (1, 3):
        kept = simhash.keep_one(docs.repartition(partitions)).collect()
        assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, one), (1, two), (3, three)])
    twins = spark.createDataFrame([(1, one, "b"), (1, one, "a")], "doc_id bigint, text string, tie string")
    assert [r["tie"] for r in simhash.keep_one(twins).collect()] == ["a"]
    assert simhash.keep_one(twins.select("doc_id", "text")).count() == 1


def test_empty_table(spark):
    docs = documents(spark, []).limit(0)
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one(docs).collect() == []


def test_components_of_chains_stars_and_pairs(spark):
    rng = random.Random(3)
    chain = list(range(100, 180))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:], strict=False)) + [(5, k) for k in range(10, 40)] + [(1, 2), (2, 1), (3, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 100 for k in chain} | {5: 5} | {k: 5 for k in range(10, 40)} | {1: 1, 2: 1}


def test_forest_joins_what_links_join():
    a, b = np.array([4, 9, 2, 7]), np.array([9, 2, 4, 8])
    node, top = common.forest(a, b)
    assert dict(zip(node.tolist(), top.tolist(), strict=True)) == {4: 2, 9: 2, 8: 7}


def test_whole_runs_across_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": k}) for k in ([1, 1], [1, 2], [2], [], [3, 3], [4, 5])]
    tables = [t.column("k").to_pylist() for t in common.whole_runs(iter(batches), ["k"])]
    assert [x for t in tables for x in t] == [1, 1, 1, 2, 2, 3, 3, 4, 5]
    assert all(set(s).isdisjoint(t) for k, s in enumerate(tables) for t in tables[:k])


def test_hex_of_negative_numbers(spark):
    df = spark.createDataFrame([(-1,), (0,), (255,)], "n bigint")
    assert [r[0] for r in df.select(common.lower_hex(F.col("n"))).collect()] == ["f" * 16, "0" * 16, "0" * 14 + "ff"]
