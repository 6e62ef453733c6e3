import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.samples import CLASHING, by_id, documents
from tradewind.llm import line_dedup

ENDS = " \t\n\x0b\x0c\r"


def _brute(rows, min_chars=40, min_docs=5):
    """Kept lines of each row, from (doc_id, text); a null id is below all others."""

    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(ENDS))

    rank = [(-1 if i is None else i, (text or "").split("\n")) for i, text in rows]
    holders = {}
    for i, lines in rank:
        for line in lines:
            holders.setdefault(key(line), set()).add(i)
    common = {k: max(ids) for k, ids in holders.items() if len(k) >= min_chars and len(ids) >= min_docs}
    return [[line for line in lines if common.get(key(line), i) == i] for i, lines in rank]


def _sample(seed):
    rng = random.Random(seed)
    pool = [f"Line {k} " + "x" * rng.choice([20, 31, 32, 33, 34, 60]) for k in range(12)]
    pool += ["é" * 39, "é" * 40, "", "short", "İ" * 45]
    texts = [None, "", "\n\n"]
    for _ in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randrange(0, 6))]
        lines = [rng.choice([x, x.upper(), f" \t{x}\r", f"\x0b{x}\x0c", f" {x}"]) for x in lines]
        texts.append("\n".join(lines))
    return texts


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 3), (7, 2)])
def test_report_equals_brute_force(spark, batches, fanout):
    texts = _sample(batches)
    docs = documents(spark, texts)
    got = by_id(line_dedup.dedup_report(docs, batches=batches, fanout=fanout))
    kept = _brute(list(enumerate(texts)))
    assert any(len(k) < len((t or "").split("\n")) for k, t in zip(kept, texts, strict=True))
    for i, lines in enumerate(kept):
        n = len((texts[i] or "").split("\n"))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert got[i].asDict() == {"doc_id": i, "n_lines": n, "n_dropped": n - len(lines), "kept_sha256": digest}


def test_null_and_repeated_ids_and_other_columns(spark):
    line = "a line that several documents hold, in whole"
    rows = [(1, line), (1, f"own\n{line}"), (2, line), (3, line), (4, line), (None, f"{line}\nx"), (9, None)]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    kept = ["\n".join(x) if t is not None else None for x, (_, t) in zip(_brute(rows), rows, strict=True)]
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(
        map(str, spark.createDataFrame([(i, t) for (i, _), t in zip(rows, kept)], "doc_id bigint, text string").collect())
    )
    for c in CLASHING:
        assert got.where(F.col(c) == F.concat(F.lit(f"{c} of "), "doc_id")).count() == (6 if c != "lang" else 0)


def test_four_documents_are_not_enough(spark):
    docs = documents(spark, ["one line of more than forty code points, it is"] * 4)
    assert {r["n_dropped"] for r in line_dedup.dedup_report(docs).collect()} == {0}


def test_empty_table(spark):
    docs = documents(spark, []).limit(0)
    assert line_dedup.dedup_report(docs).collect() == []
    assert line_dedup.dedup_lines(docs).collect() == []


def test_runs_stay_few_and_leave_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    keys = spark.range(40).select(F.col("id").alias("h1"), F.col("id").alias("h2"))
    runs = line_dedup._Runs(spark, fanout=2)
    for k in range(7):
        runs.add(runs.unseen(keys.where(f"h1 < {5 * (k + 2)}")))
        assert max(map(len, runs.levels)) < 2
    assert len(runs.names()) == 3  # 7 = 1 + 2 + 4
    held = [r["h1"] for name in runs.names() for r in spark.table(name).collect()]
    assert sorted(held) == list(range(40))
    runs.forget(runs.names())
    assert {t.name for t in spark.catalog.listTables()} == before


def test_batches_follow_the_size_and_fill_a_third_level(spark, monkeypatch):
    """Fourteen batches by threes: nine runs are one of the third level, and the result is the same."""
    levels = []
    add = line_dedup._Runs.add
    monkeypatch.setattr(line_dedup._Runs, "add", lambda self, keys, level=0: (levels.append(level), add(self, keys, level))[1])
    monkeypatch.setattr(line_dedup, "BATCH_DOCS", 4)
    texts = _sample(5)[:56]
    got = by_id(line_dedup.dedup_report(documents(spark, texts)))
    assert levels.count(0) == -(-len(texts) // 4) and max(levels) == 2
    wanted = by_id(line_dedup.dedup_report(documents(spark, texts), batches=1))
    assert got == wanted


def test_text_ids_and_many_null_ids(spark):
    """Ids that are text, and a third of the rows without one: they are one document below all others."""
    line = "a line that is long enough to count as common text"
    texts = [f"{line}\nown {k}" for k in range(12)]
    docs = documents(spark, texts, [None if k % 3 == 0 else k for k in range(12)])
    named = docs.withColumn("doc_id", F.expr("concat('k', lpad(doc_id, 3, '0'))"))
    for own, largest in ((docs, 11), (named, "k011")):
        rows = line_dedup.dedup_report(own).collect()
        assert len(rows) == 12
        assert {r["doc_id"] for r in rows if not r["n_dropped"]} == {largest}
    assert sorted(r["text"].count(line) for r in line_dedup.dedup_lines(named).collect()) == [0] * 11 + [1]
