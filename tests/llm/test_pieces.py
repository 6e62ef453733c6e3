import sys

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.samples import by_id, documents
from tradewind.llm import pieces

PARTS = ["a", "b", "he", "the", " ", "  ", "\n", "\t", "▁", "é", "日本", "​", "1", "22", "...", "ﬁ", "😀", "\x00", "ing", "aaaa", "!!", "ñ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=40).map("".join)))
def test_same_ids_and_text_as_the_library(library, text):
    ids = pieces.transducer().encode(text).tolist()
    assert ids == library.encode(text)
    assert pieces.transducer().decode(ids) == library.decode(ids)
    if "▁" not in text:
        assert pieces.transducer().decode(ids) == text


def test_long_text_without_blanks(library):
    text = "abtheinggghe" * 3000
    assert pieces.transducer().encode(text).tolist() == library.encode(text)


def test_remembered_chunks_are_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "_MAX_CHUNKS", 20)
    monkeypatch.setattr(pieces, "_MAX_PAIRS", 10)
    machine = pieces.Transducer()
    for k in range(200):
        text = f"word{k} other{k % 7}, the thing{k * 31}"
        assert machine.encode(text).tolist() == library.encode(text)
        assert len(machine._known) <= 20 and len(machine._follows) <= 10


def test_remembered_chunks_take_little_memory():
    """Two generations of chunks, and the pairs, at their largest."""
    machine = pieces.Transducer()
    for k in range(520_000):
        machine._ids(f"▁{k:06d}")
    assert len(machine._earlier) == pieces._MAX_CHUNKS
    names = list(machine.arcs)
    for k in range(pieces._MAX_PAIRS):
        machine._may_follow(names[k % 500][:1] + names[k % 500][1:], names[k // 500])
    tables = (machine._known, machine._earlier, machine._follows)
    parts = {id(p): p for table in tables for k, v in table.items() for p in (k, v, *(k if isinstance(k, tuple) else ()))}
    assert sum(map(sys.getsizeof, [*tables, *parts.values()])) < 80e6


def test_a_position_takes_few_lookups(library):
    """Arcs are found by few looks into the trie, and chunks of plain texts are held at one byte a code point."""

    class Counted(dict):
        looks = 0

        def get(self, *key):
            Counted.looks += 1
            return super().get(*key)

        def __contains__(self, key):
            Counted.looks += 1
            return super().__contains__(key)

    machine = pieces.Transducer()
    machine._trie = Counted(machine._trie)
    text = " ".join(a + b + c for a in ("er", "the", "Wh") for b in ("lich", "tion", "out", "nd") for c in ("ing", "heit", "ha"))
    ids = machine.encode(text).tolist()
    assert ids == library.encode(text)
    assert 0 < Counted.looks <= 4 * len(ids)
    assert all(map(str.isascii, machine._known))


def test_chunks_forgotten_within_a_text(library, monkeypatch):
    monkeypatch.setattr(pieces, "_MAX_CHUNKS", 3)
    monkeypatch.setattr(pieces, "_MAX_PAIRS", 4)
    machine = pieces.Transducer()
    text = " ".join(f"x{k % 5}a{k % 11}, thinging heatherer{k % 3}\u2581é日{k}" for k in range(60))
    assert machine.encode(text).tolist() == library.encode(text)
    assert len(machine._known) <= 3 and len(machine._earlier) <= 3
    assert sum(map(len, machine._follows.values())) <= 4


def test_the_path_is_the_only_one(library):
    """No other segmentation passes the acceptor, so the path found is the shortest."""
    machine = pieces.Transducer()

    def paths(text, last=""):
        if not text:
            yield []
        for end in range(1, len(text) + 1):
            piece = text[:end]
            if (piece in machine.arcs or end == 1) and (not last or machine._may_follow(last, piece)):
                yield from ([piece, *rest] for rest in paths(text[end:], piece))

    for chunk in ("▁thinging", "▁heatherer", "▁aaaaaaa", "▁日本語😀the", "▁▁▁▁▁x"):
        assert list(paths(chunk)) == [machine._shortest(chunk)]


def test_encode(spark, library):
    texts = [None, "", " ", "The quick  brown\nfox.", "é😀", "x" * 5000]
    got = by_id(pieces.encode(documents(spark, texts)))
    for i, text in enumerate(texts):
        ids = None if text is None else library.encode(text)
        assert got[i].asDict() == {"doc_id": i, "n_pieces": len(ids or []), "ids": ids, "decoded": text}


def test_null_and_repeated_ids_and_empty_table(spark):
    docs = documents(spark, ["a", "b", "c"], ids=[1, 1, None])
    assert sorted(r["decoded"] for r in pieces.encode(docs).collect()) == ["a", "b", "c"]
    assert pieces.encode(docs.limit(0)).collect() == []


def changed_model(folder, change) -> str:
    """The model with other settings."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    change(proto)
    path = folder / "changed.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def charsmap(rule: str) -> bytes:
    """A character map that the library has compiled in."""
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    return spec.normalizer_spec.precompiled_charsmap


FOLDED = [*PARTS, "A", "\u0301", "\u0327", "ＡＢ", "㍿", "\u00a8", "\u00a0", "\u3000", "\u200b", "Å", "が", "か\u3099", "½", "ǅ", "\u0001", "각", "ß"]


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normaliser_settings_are_compiled(tmp_path, rule, prefix, squeeze):
    def change(proto):
        proto.normalizer_spec.name = rule
        proto.normalizer_spec.precompiled_charsmap = b"" if rule == "identity" else charsmap(rule)
        proto.normalizer_spec.add_dummy_prefix = prefix
        proto.normalizer_spec.remove_extra_whitespaces = squeeze

    path = changed_model(tmp_path, change)
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(path)

    @settings(max_examples=150, deadline=None)
    @given(text=st.one_of(st.text(max_size=40), st.lists(st.sampled_from(FOLDED), max_size=30).map("".join)))
    def check(text):
        assert machine.normalise(text) == library.normalize(text)
        ids = machine.encode(text).tolist()
        assert ids == library.encode(text)
        assert machine.decode(ids) == library.decode(ids)

    check()


def test_what_is_not_compiled_is_refused(tmp_path):
    def suffix(proto):
        proto.trainer_spec.treat_whitespace_as_suffix = True

    def unigram(proto):
        proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM

    def unescaped(proto):
        proto.normalizer_spec.escape_whitespaces = False

    def defined(proto):
        proto.pieces[300].type = proto.pieces[300].USER_DEFINED

    def denormaliser(proto):
        proto.denormalizer_spec.precompiled_charsmap = charsmap("nfkc")

    for change in (suffix, unigram, unescaped, defined, denormaliser):
        with pytest.raises(ValueError):
            pieces.Transducer(changed_model(tmp_path, change))


def test_round_trip(spark):
    texts = [None, "", " a  b ", "a\u2581b"]
    got = by_id(pieces.encode(documents(spark, texts), compared=True))
    assert [got[i]["round_trip"] for i in range(4)] == [None, True, True, False]
