"""The source audit, against its definition in exact fractions."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.samples import documents
from tradewind.llm import source_divergence as sd


def terms_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, min_documents=30, top=50):
    groups, in_docs = {}, {}
    for row in rows:
        lang, source, found = row["lang"] or "", row["source"] or "", terms_of(row["text"])
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(found)
        in_docs.setdefault(lang, Counter()).update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in in_docs[lang].items() if n >= min_documents}

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {source: shares(counts) for source, counts in sources.items()}
        q = shares(sum(sources.values(), Counter()))
        for source, counts in sources.items():
            pairs = [(sum(abs(p[source][t] - p[o][t]) for t in kept), o) for o in sources if o != source]
            own = [(p[source][t] - q[t], t) for t in kept if counts[t] and p[source][t] > q[t]]
            for part, found in (("pair", pairs), ("term", own)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(ranked, 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, source, part, item, value, rank))
    return sorted(out)


def found(df):
    return sorted(tuple(row[c] for c in ("lang", "source", "part", "item", "value", "rank")) for row in df.collect())


def corpus(spark, n=160, seed=2, sources=5):
    rng = random.Random(seed)
    vocabulary = [f"{c}{d}" for c in "AbCdé" for d in ("x", "Yz", "ñ")] + ["rare"] * 1
    texts = [" ".join(rng.choices(vocabulary, range(1, len(vocabulary) + 1), k=rng.randrange(25))) for _ in range(n)]
    docs = documents(spark, texts, langs=[rng.choice(["en", "de", None, ""]) for _ in range(n)])
    return docs.withColumn("source", F.concat(F.lit("s"), F.pmod(F.xxhash64("doc_id"), F.lit(sources))))


@pytest.mark.parametrize(
    "options", [{}, {"bits": 2}, {"bits": 1, "top": 3}, {"terms_each": 2}, {"tile": 2}, {"tile": 1, "terms_each": 1, "bits": 3}]
)
def test_equals_definition(spark, options):
    """Also where all digests collide, and over bundles of terms and tiles of sources."""
    docs = corpus(spark)
    rows = [r.asDict() for r in docs.collect()]
    assert found(sd.audit(docs, min_documents=8, **options)) == brute(rows, 8, options.get("top", 50))


def test_collisions_keep_rare_terms_out(spark):
    """Two terms of 20 documents each share a digest, but neither has 30."""
    docs = documents(spark, ["aa"] * 20 + ["bb"] * 20 + ["cc"] * 40, langs=["en"] * 80)
    docs = docs.withColumn("source", F.expr("if(doc_id % 2 = 0, 'even', 'odd')"))
    rows = [r.asDict() for r in docs.collect()]
    assert found(sd.audit(docs, bits=1)) == brute(rows)
    kept, _ = sd.kept_terms(docs, 30, 1)
    assert [r["term"] for r in kept.collect()] == ["cc"]


def test_ties_at_the_last_rank(spark):
    """Many terms of one value around rank 50."""
    texts = [" ".join(f"t{a}{b}" for a in "abcdefghij" for b in "abcdefghij")] * 40 + ["ta"] * 40
    docs = documents(spark, texts, langs=["en"] * 80).withColumn("source", F.expr("if(doc_id < 40, 'many', 'few')"))
    rows = [r.asDict() for r in docs.collect()]
    got = found(sd.audit(docs))
    assert got == brute(rows) and sum(g[1:3] == ("many", "term") for g in got) == 50


def test_awkward_rows(spark):
    """Null and empty fields, a long text, groups without terms, languages without kept terms or with one source."""
    texts = [None, "", "A " * 100_000, "É é", "a", "a", "1 2 3"] * 6
    docs = documents(spark, texts, ids=[None, 1] * 21, langs=["en", None, "en", "fr", "en", "de", ""] * 6)
    docs = docs.withColumn("source", F.expr("CASE WHEN text IS NULL THEN 'empty' WHEN length(text) < 4 THEN NULL ELSE 's' END"))
    rows = [r.asDict() for r in docs.collect()]
    assert found(sd.audit(docs, min_documents=6)) == brute(rows, 6)
    assert found(sd.audit(docs, min_documents=100)) == brute(rows, 100)


def test_empty_table(spark):
    assert sd.audit(documents(spark, ["a"]).limit(0)).collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    n, all_n, v = 3 * 10**17 + 1, 9 * 10**17 + 7, 11
    (row,) = spark.sql(f"SELECT {n}L AS n, {all_n}L AS all_n, {v}L AS v").select(sd.share("n", "all_n", "v")).collect()
    assert row[0] == 1 + 10**9 * (n + 5) // (all_n + 5 * v)


def test_strings_stay_out_of_the_shuffles_of_counts(spark):
    """Only the join of the output reads terms; digests and numbers are what is counted."""
    docs = corpus(spark)
    kept, counts = sd.kept_terms(docs, 8)
    assert dict(counts.dtypes)["digest"] == "bigint" and "term" not in counts.columns
    assert {r["split"] for r in counts.select("split").distinct().collect()} == {""}
    tally, _ = sd.tallied(docs)
    assert [c for c, kind in tally.dtypes if kind == "string"] == ["lang", "source"]


def test_names_take_no_rows_of_their_own(spark):
    counts, names = sd.tallied(corpus(spark))
    assert set(names.inputFiles()) == set(counts.inputFiles())
    assert 0 < names.count() < counts.count()


def test_a_batch_is_tallied_in_parts_of_whole_documents(monkeypatch):
    texts = ["Ab é c9AB", "", None, "ab", "-", "c ab", "x" * 50 + " c", "é", "Ab c"] * 3
    langs, sources = ["en", "de", "en"] * 9, ["t", "s", "s", "s"] * 6 + ["t"] * 3
    batch = pa.RecordBatch.from_arrays(
        [pa.array(langs), pa.array(sources), pa.array([None if t is None else t.encode() for t in texts], pa.binary())],
        names=["lang", "source", "text"],
    )
    monkeypatch.setattr(sd, "_HELD", 6)
    monkeypatch.setattr(sd, "_BLOCK", 16)
    tallies = list(sd._tallies(iter([batch.slice(0, 5), batch.slice(5, 0), batch.slice(5)])))
    assert len(tallies) > 2
    n, in_docs = Counter(), Counter()
    for tally in tallies:
        terms = tally.terms.to_pylist()
        for group, term, times, docs in zip(tally.group, tally.term, tally.n, tally.docs, strict=True):
            key = (*tally.groups[group], terms[term].decode())
            n[key] += times
            in_docs[key] += docs
    found = [[(*group, t) for t in terms_of(text)] for text, *group in zip(texts, langs, sources, strict=True)]
    assert n == Counter(key for keys in found for key in keys)
    assert in_docs == Counter(key for keys in found for key in set(keys))
