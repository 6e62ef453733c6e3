"""Small tables with the awkward rows that every text operator has to take."""

import random

#: Names that the operators use for columns of their own.
CLASHING = (
    "row score predicted held_out h1 h2 batch keeper given_up kept fp list key col side blocks label node least"
    " spans items n_words seed segment first windows runs wanted n_tokens band found id lang source n_chars"
).split()


def documents(spark, texts, ids=None, langs=None):
    """Documents with the given texts and a column for each name that might clash."""
    ids = range(len(texts)) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    schema = "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = []
    for i, text, lang in zip(ids, texts, langs, strict=True):
        rows.append((i, text, *(lang if c == "lang" else f"{c} of {i}" for c in CLASHING)))
    return spark.createDataFrame(rows, schema).repartition(4)


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def by_id(df, key="doc_id"):
    """Rows by id; repeated ids must not occur."""
    rows = df.collect()
    found = {row[key]: row for row in rows}
    assert len(found) == len(rows)
    return found
