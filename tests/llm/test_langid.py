import random
import zlib

import numpy as np

from tests.llm.samples import by_id, documents
from tradewind.llm import langid

DATA = "/root/testdata/sf0.01"
SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ber"], "cc": ["eau", "oux", "tre"]}


def _sample(n=150):
    rng = random.Random(9)
    langs = [rng.choice(sorted(SYLLABLES)) for _ in range(n)]
    texts = [" ".join("".join(rng.choices(SYLLABLES[x], k=3)) for _ in range(rng.randrange(3, 30))) for x in langs]
    return texts, langs


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = by_id(langid.identify(docs))
    assert len(found) == docs.count()
    held = [(found[r["doc_id"]], r["lang"]) for r in docs.collect() if found[r["doc_id"]]["held_out"]]
    assert len(held) > 150
    assert sum(row["lang_pred"] == lang for row, lang in held) / len(held) >= 0.97


def test_columns_and_undetermined_texts(spark):
    texts, langs = _sample()
    extra = [None, "", "1234 !?", "\n"]
    docs = documents(spark, texts + extra, langs=langs + ["aa"] * 4)
    found = by_id(langid.identify(docs))
    for i, row in found.items():
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1
        if i < len(texts):
            assert row["lang_pred"] == langs[i]
        else:
            assert (row["lang_pred"], row["score"]) == ("und", 0)


def test_held_out_languages_do_not_matter(spark):
    texts, langs = _sample()
    wrong = ["zz" if zlib.crc32(str(i).encode()) % 4 == 2 else x for i, x in enumerate(langs)]
    one, two = (by_id(langid.identify(documents(spark, texts, langs=x))) for x in (langs, wrong))
    assert {i: r[:] for i, r in one.items()} == {i: r[:] for i, r in two.items()}


def test_outputs_equal_the_kernel_classifier():
    """Folding changes nothing: kernel, whitening and ridge applied step by step give the same."""
    texts, langs = _sample(60)
    lang = np.array(langs, object)
    occupied = np.stack([langid.slots(t) for t in texts])
    model = langid.fit_languages(occupied, lang, landmarks=30, ridge=0.1)
    kernel = lambda a, b: (a.astype(float) @ b.T) / np.sqrt(np.outer(a.sum(1), b.sum(1)))
    chosen = np.concatenate([np.flatnonzero(lang == name)[:10] for name in model.names])
    values, vectors = np.linalg.eigh(kernel(occupied[chosen], occupied[chosen]))
    sound = values > 1e-6 * values.max()
    z = kernel(occupied, occupied[chosen]) @ (vectors[:, sound] / np.sqrt(values[sound]))
    weight = 1 / np.array([(lang == x).sum() for x in lang])
    for k, name in enumerate(model.names):
        target = np.where(lang == name, 1.0, -1.0)
        ridge = np.linalg.solve((z.T * weight) @ z + 0.1 * np.eye(z.shape[1]), (z.T * weight) @ target)
        assert np.allclose(model.outputs(occupied)[:, k], z @ ridge, atol=1e-3)


def test_slots_are_the_distinct_grams():
    text = "Añaña 😀"
    low = text.lower()
    grams = {low[k : k + n] for n in (1, 2, 3) for k in range(len(low) - n + 1)}
    together = np.logical_or.reduce([langid.slots(g) for g in grams])
    assert (langid.slots(text) == together).all()
    assert abs(langid.slots(text).sum() - len(grams)) <= 1
    assert not langid.slots("").any() and langid.slots("a").sum() == 1


def test_held_out_accuracy_of_long_texts(spark):
    """Two languages of one large script and two of one alphabet, in texts of 100,000 code points and more."""
    rng = np.random.default_rng(3)
    scripts = {"han": [chr(0x4E00 + k) for k in range(3000)], "latin": [chr(0x61 + k) for k in range(26)]}
    words = {}
    for script, letters in scripts.items():
        for n in (1, 2):
            size = 2 if script == "han" else 6
            words[f"{script}{n}"] = np.array(["".join(x) for x in rng.choice(letters, (8000, size))])
    zipf = 1 / np.arange(1, 8001)
    texts, langs = [], []
    for k in range(96):
        lang = sorted(words)[k % 4]
        n = int(rng.integers(50_000, 60_000)) if k % 8 < 4 else int(rng.integers(20, 60))
        texts.append(("" if lang < "l" else " ").join(rng.choice(words[lang], n, p=zipf / zipf.sum())))
        langs.append(lang)
    found = by_id(langid.identify(documents(spark, texts, langs=langs)))
    long = [i for i, row in found.items() if row["held_out"] and len(texts[i]) >= 100_000]
    assert {langs[i] for i in long} == set(words)
    assert [found[i]["lang_pred"] for i in long] == [langs[i] for i in long]
    assert langid.slots(texts[0]).mean() > 0.99  # hashed to few slots, hardly anything is left to tell them apart


def test_kernel_counts_exact_grams(monkeypatch):
    texts = ["Añaña 😀", "", "a", "bañ 😀x", "aaaa"]
    sets = [{t.lower()[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)} for t in texts]
    marks = langid.Landmarks.of([langid.grams(t) for t in texts])
    for chunk in (1 << 20, 2):
        monkeypatch.setattr(langid, "_CHUNK", chunk)
        for text, own in zip(texts, sets, strict=True):
            wanted = [len(own & other) / max(1, len(own) * len(other)) ** 0.5 for other in sets]
            assert len(langid.grams(text)) == len(own) and np.allclose(marks.kernel(langid.grams(text)), wanted)


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = documents(spark, ["abc", None], ids=[1, None])
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).collect() == []
    one = documents(spark, ["abc", "def", "1"], ids=[1, 1, 3], langs=["x", "x", "x"])
    assert sorted(r["lang_pred"] for r in langid.identify(one).collect()) == ["und", "x", "x"]


def test_three_hundred_languages_are_all_learned(spark):
    """A language for each of 300 letters; every one of them can be predicted."""
    rng = random.Random(4)
    names = [f"l{k:03d}" for k in range(300)]
    letters = [chr(0x4E00 + 40 * k) for k in range(300)]
    texts, langs = [], []
    for name, letter in zip(names, letters, strict=True):
        for _ in range(8):
            texts.append(" ".join(letter * rng.randint(1, 3) + chr(ord(letter) + rng.randrange(30)) for _ in range(20)))
            langs.append(name)
    got = langid.identify(documents(spark, texts, langs=langs)).collect()
    right = [row["lang_pred"] == langs[row["doc_id"]] for row in got]
    assert sum(right) > 0.98 * len(right) and {row["lang_pred"] for row in got} == set(names)


def test_landmarks_are_whole_texts():
    sizes = [("a", 1, 900), ("a", 2, 30), ("a", 3, 50), ("a", 4, 40), ("b", 1, 700), ("b", 2, 500)]
    assert langid.landmark_places(sizes, 2, 100) == [("a", 2), ("a", 3), ("b", 2)]


def test_a_long_landmark_counts_to_its_end(spark):
    """What tells a language stands at the end of its only, long text."""
    filler = "x y z " * 3000
    texts = [filler + "qqq www", filler + "jjj kkk", "qqq www", "jjj kkk"]
    docs = documents(spark, texts, ids=[1, 3, 8, 9], langs=["q", "j", None, None])
    learned = docs.where("lang IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2").count()
    assert learned == 2
    found = {row["doc_id"]: row["lang_pred"] for row in langid.identify(docs).collect()}
    assert (found[8], found[9]) == ("q", "j")
