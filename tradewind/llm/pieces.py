"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is compiled from a BPE model file: the model's normaliser (its character map, blanks squeezed
and stripped, a dummy prefix, each as the model says, and blanks to U+2581), one arc
for each piece, weighted by its negated score, and a byte fallback for code points without a piece. What is
not compiled is refused: other kinds of model, pieces that the user defined, unused ones or ones that span
blanks, blanks as suffixes, and a denormaliser. BPE applies merges by rank, which a sum of piece weights alone does not reproduce, so the piece arcs are
composed with an acceptor whose states are the last piece: it lets piece b follow piece a only if merging
the two together gives [a, b] again. A sequence all of whose neighbours pass is the one that the merges
give for the whole text, so in the composition with an input at most one path ends in each position, and
the tropical-semiring shortest path is the BPE encoding. The composition is built lazily, from left to
right, for chunks that no piece spans: no piece holds a blank after another code point. Chunks and pairs
seen before are remembered in tables of bounded size.

Defined results: a null text gives null ids, no pieces and a null decoding; an empty text gives no
pieces and decodes to the empty text. U+2581 in a text encodes as a blank, as it does in the library, so
such a text does not round trip; nor does one that a model's normaliser changes. Repeated rows are encoded alike, and columns other than ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import add
from sys import intern

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from tradewind.llm.common import arrow_map

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
_MAX_CHUNKS = 150_000
_MAX_PAIRS = 300_000


def character_map(blob: bytes) -> dict[str, str]:
    """The replacements in a model's compiled character map: a double-array trie over UTF-8 bytes, which gives the
    place of each replacement among the texts after it, each ended by a zero byte."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    labels, byte = units & 0x800000FF, np.arange(1, 256)
    below = (units >> 10) << ((units & 0x200) >> 6)
    rules, todo = {}, [(int(below[0]), b"")]
    while todo:
        at, key = todo.pop()
        next_ = at ^ byte
        next_ = next_[next_ < len(units)]
        for k in next_[labels[next_] == at ^ next_]:
            here, longer = int(k ^ below[k]), key + bytes([at ^ int(k)])
            if units[k] & 0x100:
                start = int(units[here] & 0x7FFFFFFF)
                rules[longer.decode()] = texts[start : texts.index(0, start)].decode()
            todo.append((here, longer))
    return rules


class Normaliser:
    """What a model does to a text before it looks for pieces: the first transducer of the composition."""

    def __init__(self, spec):
        self._rules = character_map(spec.precompiled_charsmap)
        self._squeeze = spec.remove_extra_whitespaces
        self._prefix = " " if spec.add_dummy_prefix else ""
        if not spec.escape_whitespaces or any("  " in new for new in self._rules.values()):
            raise ValueError("a normaliser that keeps blanks or makes two of them is not supported")
        self._sizes: dict[str, list[int]] = {}
        for size, first in sorted({(len(old), old[0]) for old in self._rules}, reverse=True):
            self._sizes.setdefault(first, []).append(size)
        firsts = "".join(map(re.escape, self._sizes))
        self._plain = re.compile(f"[^{firsts}]+").match if firsts else None

    def _mapped(self, text: str) -> str:
        """The longest replacement at each place, from left to right; what has none stays."""
        out, at = [], 0
        while at < len(text):
            plain = self._plain(text, at)
            if plain:
                out.append(plain[0])
                at = plain.end()
                continue
            size = next((n for n in self._sizes[text[at]] if text[at : at + n] in self._rules), 0)
            out.append(self._rules[text[at : at + size]] if size else text[at])
            at += size or 1
        return "".join(out)

    def spaced(self, text: str) -> str:
        """The normal form with a blank wherever it has U+2581, so that plain texts keep one byte a code point."""
        if not text:
            return ""
        if self._rules:
            text = self._mapped(text)
        if self._squeeze:
            text = re.sub(" +", " ", text).strip(" ")
            return (self._prefix + text.replace(BLANK, " ")).rstrip(" ")
        return self._prefix + text.replace(BLANK, " ")

    def __call__(self, text: str) -> str:
        return self.spaced(text).replace(" ", BLANK)


class _Remembered(dict[str, bytes]):
    """Piece ids of chunks or pieces; ``find`` gives those of the others."""

    def __init__(self, find: Callable[[str], bytes]):
        self._find = find

    def __missing__(self, chunk: str) -> bytes:
        return self._find(chunk)


class Transducer:
    """Encoder and decoder compiled from a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str = MODEL):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("the model is not a BPE model")
        if proto.trainer_spec.treat_whitespace_as_suffix or proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("blanks as suffixes and denormalisers are not supported")
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.normalise = Normaliser(proto.normalizer_spec)
        self._strips_on = proto.normalizer_spec.remove_extra_whitespaces
        self._strip = proto.normalizer_spec.add_dummy_prefix or self._strips_on
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(k) for k in range(len(model))]
        self.byte_id = {int(p[3:5], 16): k for k, p in enumerate(names) if model.is_byte(k)}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        special = {k for k in range(len(names)) if model.is_byte(k) or model.is_control(k) or model.is_unknown(k)}
        self.arcs = {p: (k, -model.get_score(k)) for k, p in enumerate(names) if k not in special}
        if any(BLANK in p.lstrip(BLANK) for p in self.arcs):
            raise ValueError("pieces that span blanks are not supported")
        self.piece = [b"" if k in special else p.replace(BLANK, " ").encode() for k, p in enumerate(names)]
        for value, k in self.byte_id.items():
            self.piece[k] = bytes([value])
        inside = {c for p in self.arcs if len(p) > 1 for c in p}
        ends = "".join(c for c in "\n\t" if c not in inside)  # no piece spans these either
        #: Neighbouring code points inside pieces; no piece spans any others.
        self._spanned = {p[k : k + 2] for p in self.arcs for k in range(len(p) - 1)}
        behind = {b for a, b in self._spanned if re.match(r"[^\W\d_]", a)}
        marks = "".join(c for c in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~" if c not in behind)  # no piece has one behind a letter
        word = rf"[^\W\d_]++(?:(?=[{re.escape(marks)}])|[^ {ends}]*+)|" if marks else ""
        self._chunks = re.compile(f" *+(?:{word}[^ {ends}]++)| ++" + (f"|[{ends}]++" if ends else "")).findall
        self._letters = re.compile(r" *[^\W\d_]+").match
        # an arc whose own merges do not make it cannot be on the path
        self.arcs = {p: arc for p, arc in self.arcs.items() if self._merges(p) == [p]}
        self._codes = _Remembered(self._fallback)
        self._codes.update((p, np.int32(k).tobytes()) for p, (k, _) in self.arcs.items())
        #: Pieces and their beginnings, each with the arcs along it, longest first; a lone code point has one at any rate.
        self._trie: dict[str, tuple[str, ...]] = {}
        for p in sorted({intern(p[:k]) for p in self.arcs for k in range(1, len(p) + 1)}, key=len):
            before = self._trie[p[:-1]] if len(p) > 1 else ()
            self._trie[p] = (p, *before) if p in self.arcs or len(p) == 1 else before
        self._known = _Remembered(self._ids)
        self._earlier: dict[str, bytes] = {}
        #: The acceptor's arcs that were asked for, by the last piece.
        self._follows: dict[str, dict[str, bool]] = {}
        self._pairs = 0

    def _merges(self, text: str, place: int = 0) -> list[str]:
        """What merging neighbours by rank makes of a short text; nothing once a merge spans ``place``, if one is given."""
        arc_of, parts = self.arcs.get, list(text)
        while len(parts) > 1:
            ranked = [(arc[1], k) for k, pair in enumerate(map(add, parts, parts[1:])) if (arc := arc_of(pair))]
            if not ranked:
                break
            k = min(ranked)[1]
            if k + 1 == place:
                return []
            place -= k < place
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _may_follow(self, a: str, b: str) -> bool:
        """The acceptor's arc: does merging a and b together leave them apart?"""
        if self._pairs >= _MAX_PAIRS:
            self._follows.clear()
            self._pairs = 0
        self._pairs += 1
        known = self._follows.setdefault(intern(a), {})[intern(b)] = self._merges(a + b, len(a)) == [a, b]
        return known

    def _shortest(self, chunk: str) -> list[str]:
        """Pieces of the shortest path through a chunk.

        At most one path reaches a position, so its weight cannot be improved on: the search takes the
        longest arcs first, never enters a position twice, and may stop at the first whole path.
        """
        n, leaving, follows, spanned = len(chunk), self._leaving, self._follows, self._spanned
        path: list[str] = []
        left: set[int] = set()
        open_: list[Iterator[str]] = []
        at = 0
        arcs = iter(leaving(chunk, 0))
        next_: dict[str, bool] | None = None  # what may follow the last piece; none if anything may
        while at < n:
            for piece in arcs:
                if left and at + len(piece) in left:
                    continue
                if next_ is not None:
                    follow = next_.get(piece)
                    if follow is None:
                        follow = self._may_follow(path[-1], piece)
                    if not follow:
                        continue
                break
            else:
                left.add(at)
                arcs = open_.pop()
                at -= len(path.pop())
                next_ = follows.get(path[-1], {}) if path and chunk[at - 1 : at + 1] in spanned else None
                continue
            open_.append(arcs)
            path.append(piece)
            at += len(piece)
            if at < n:
                arcs = iter(leaving(chunk, at))
                next_ = follows.get(piece, {}) if chunk[at - 1 : at + 1] in spanned else None
        return path

    def _leaving(self, chunk: str, at: int) -> tuple[str, ...]:
        """The arcs that leave a position, longest first."""
        trie, end = self._trie, at + 4
        found = trie.get(chunk[at:end])
        if found is None:
            return trie.get(chunk[at : at + 3]) or trie.get(chunk[at : at + 2]) or trie.get(chunk[at]) or (chunk[at],)
        n = len(chunk)
        while end < n:
            end += 1
            longer = trie.get(chunk[at:end])
            if longer is None:
                break
            found = longer
        return found

    def _fallback(self, point: str) -> bytes:
        """The ids of a code point's bytes."""
        return np.array([self.byte_id[b] for b in point.encode()], np.int32).tobytes()

    def _ids(self, chunk: str) -> bytes:
        """Piece ids of a chunk, 4 bytes each, remembered if the chunk is short."""
        ids = self._known.get(chunk)
        if ids is not None:
            return ids
        ids = self._earlier.get(chunk)
        if ids is None:
            word = self._letters(chunk)
            cut = word.end() if word else 0
            if 0 < cut < len(chunk) and chunk[cut - 1 : cut + 1] not in self._spanned:
                ids = self._ids(chunk[:cut]) + self._ids(chunk[cut:])
            else:
                path = self._shortest(chunk.replace(" ", BLANK))
                ids = b"".join(map(self._codes.__getitem__, path))
        if len(chunk) <= 64:
            if len(self._known) >= _MAX_CHUNKS:
                self._earlier, self._known = self._known, _Remembered(self._ids)
            self._known[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Piece ids of a text."""
        chunks = self._chunks(self.normalise.spaced(text))
        if not chunks:
            return np.zeros(0, np.int32)
        return np.frombuffer(b"".join(map(self._known.__getitem__, chunks)), np.int32)

    def decode(self, ids) -> str:
        """The text of piece ids: the dummy prefix goes, invalid byte runs are replaced.

        A model that strips blanks takes one off each piece until there is text.
        """
        found = list(map(self.piece.__getitem__, ids))
        for k, piece in enumerate(found if self._strip else []):
            found[k] = piece.removeprefix(b" ")
            if found[k] or not self._strips_on:
                break
        return b"".join(found).decode(errors="replace")


@lru_cache(2)
def transducer(path: str = MODEL) -> Transducer:
    """The compiled model, once in each Python worker."""
    return Transducer(path)


def encode(docs: DataFrame, model: str = MODEL, compared: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded): piece ids of every whole text, and the text they decode to.

    With ``compared`` also ``round_trip``: whether that is the text again, null for a null text.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = transducer(model)
        texts = batch.column("text").to_pylist()
        found = [None if t is None else machine.encode(t) for t in texts]
        sizes = [0 if ids is None else len(ids) for ids in found]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        flat = np.concatenate([np.zeros(0, np.int32), *(ids for ids in found if ids is not None)])
        lists = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([ids is None for ids in found]))
        decoded = [None if ids is None else machine.decode(ids.tolist()) for ids in found]
        columns = {
            "doc_id": batch.column("doc_id"),
            "n_pieces": pa.array(sizes, pa.int64()),
            "ids": lists,
            "decoded": pa.array(decoded, pa.string()),
        }
        if compared:
            same = [None if t is None else t == d for t, d in zip(texts, decoded, strict=True)]
            columns["round_trip"] = pa.array(same, pa.bool_())
        return pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(
        docs.select("doc_id", "text"),
        rows,
        f"doc_id {kind}, n_pieces bigint, ids array<int>, decoded string" + (", round_trip boolean" if compared else ""),
    )
