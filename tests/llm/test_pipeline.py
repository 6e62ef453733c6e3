"""The stages on planted cases, against plain code, and the whole over test data."""

import random
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.samples import words
from tests.llm.test_decontam import _brute as decontaminated
from tests.llm.test_line_dedup import _brute as lines_kept
from tests.llm.test_simhash import _brute_components, _brute_fingerprint
from tradewind.llm import common, pieces

DATA = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    functions = dict(corpus_pipeline.STAGES)
    names = [name for name, _ in corpus_pipeline.STAGES]
    good = functions[names[0]](spark, docs, DATA)
    rows = sorted((r["doc_id"], r["text"]) for r in good.select("doc_id", "text").collect())
    rejected = docs.join(good, "doc_id", "left_anti").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    assert 0.8 * docs.count() < len(rows) < docs.count()
    assert rejected.where("quality = 1").count() <= 0.02 * len(rows)

    lines = functions[names[1]](spark, good, DATA)
    assert lines.columns == docs.columns
    rows = [(i, "\n".join(kept)) for (i, _), kept in zip(rows, lines_kept(rows), strict=True)]
    assert sorted((r["doc_id"], r["text"]) for r in lines.select("doc_id", "text").collect()) == rows

    unlike = functions[names[2]](spark, lines, DATA)
    tops = _brute_components([_brute_fingerprint(t) for _, t in rows], [i for i, _ in rows])
    rows = [row for row, top in zip(rows, tops, strict=True) if row[0] == top]
    assert sorted((r["doc_id"], r["text"]) for r in unlike.select("doc_id", "text").collect()) == rows

    clean = functions[names[3]](spark, unlike, DATA)
    rows = [row for row, found in zip(rows, decontaminated([t for _, t in rows], bench), strict=True) if not found[4]]
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in clean.select("doc_id", "text").collect()) == rows

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoded = functions[names[4]](spark, clean, DATA).collect()
    assert {r["doc_id"]: r["ids"] for r in encoded} == {i: library.encode(t) for i, t in rows}


def test_run_and_registration(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["pipeline"](spark, DATA)
    assert got.select("doc_id").distinct().count() == got.count() > 100
    numbers = [int(found[1]) for n in __spark_entry__.queries() if (found := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 14))


def test_stages_take_awkward_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing columns and an empty table pass through every stage."""
    folder = str(tmp_path)
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    text = " ".join(words(random.Random(1), 30))
    rows = [(None, None), (None, text), (1, ""), (1, None), (2, text), (2, text), (3, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select(
        "doc_id", "text", F.lit("x").alias("row"), F.lit(1).alias("score"), F.lit("y").alias("fp"), F.lit(None).cast("string").alias("lang")
    )
    for at in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, folder)
        assert {"doc_id", "ids"} <= set(at.columns)
        at.collect()


def test_batches_of_texts_are_bounded(spark):
    """Tasks get texts in batches of a few MB, a longer text as one batch, whatever their number; a size set by the user stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)

    def sizes(batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    text = F.repeat(F.lit("abcdefghij"), F.when(F.col("id") == 7, 600_000).otherwise(200).cast("int")).alias("text")
    docs = spark.range(0, 9000, 1, 1).select(F.col("id").alias("doc_id"), text)
    rows = common.arrow_map(docs, sizes, "n bigint, size bigint").collect()
    assert sum(r["n"] for r in rows) == 9000
    assert sorted(r["size"] for r in rows)[-2] <= 1.1 * common.BATCH_BYTES
    assert max(r["size"] for r in rows) <= 6_000_000 + 1.1 * common.BATCH_BYTES

    spark.conf.set(name, "20m")
    assert max(r["n"] for r in common.arrow_map(docs, sizes, "n bigint, size bigint").collect()) > 5000
    spark.conf.unset(name)


def test_every_stage_bounds_its_batches(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(50)
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs, DATA)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(common.BATCH_BYTES)
