"""Secret scans: keyword prefilter, anchored patterns near hits, checksum validation.

An Aho-Corasick automaton finds the keywords of all kinds in one pass over the lower-cased text; the
pattern of a kind is tried only at the hits of its keywords, anchored there. Hexadecimal runs have no
keyword: a text is searched for them only if some run is long enough, which a byte translation and a
substring search tell.

Kinds with an embedded checksum are added to the base kinds:

* ``token``: prefixed access tokens whose last six base-62 digits are the CRC-32 of the thirty before;
* ``iban``: account numbers of the length that their country has, with a remainder of 1 modulo 97;
* ``card``: payment card numbers of 13 to 19 digits that pass the Luhn check, after a known issuer prefix.

What follows a number after one blank or hyphen may look like more of it (an expiry date, a CVV, a word in
capitals), so at each anchor every admissible end is tried: the one that the country's length gives, or
each end of a group of digits, from the longest to the shortest. Candidates whose checksum fails at all of
them are dropped. Spans are in code points, end exclusive. The base kinds
are found as their patterns define, leftmost and non-overlapping for each kind, also inside added spans.

Defined results: a null text counts as empty; an empty text has no spans and the digest of the empty
string. Rows that share an id are scanned each by its own text; columns other than ``doc_id`` and
``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import arrow_map

KINDS = ("assign", "access", "hex", "token", "iban", "card")
MIN_LENGTH = {"assign": 12, "access": 18, "hex": 16}

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,18}")
_CARD_DIGITS = 13

#: Characters of an account number in each country of the IBAN registry.
_IBAN_LENGTH = {
    part[:2]: int(part[2:])
    for part in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 "
        "EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
        "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 "
        "PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 "
        "UA29 VA22 VG24 XK20 YE30"
    ).split()
}


def _of_length(length: int) -> re.Pattern:
    """Account numbers of a length, in groups of four that may have blanks between them."""
    groups, rest = divmod(length - 4, 4)
    last = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
    return re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{last}(?![A-Za-z0-9])")


_IBAN_OF = {country: _of_length(length) for country, length in _IBAN_LENGTH.items()}

#: Keywords of each kind, lower case.
_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "iban": tuple(country.lower() for country in _IBAN_LENGTH),
    "card": (
        *(str(n) for n in range(2200, 2205)),  # Mir
        *(str(n) for n in range(2221, 2230)),  # Mastercard, 2221 to 2720
        *(str(n) for n in range(223, 230)),
        *("23", "24", "25", "26", "270", "271", "2720"),
        *("300", "301", "302", "303", "304", "305", "3095", "36", "38", "39"),  # Diners Club
        *("34", "37"),  # American Express
        *("3528", "3529", *(str(n) for n in range(353, 359))),  # JCB
        "4",  # Visa
        *("51", "52", "53", "54", "55"),  # Mastercard
        *("50", "56", "57", "58", "6"),  # Maestro, Discover, UnionPay, RuPay
        *("81", "82"),  # UnionPay, RuPay
    ),
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {k: k + 32 for k in range(65, 91)}
_HEX_BYTES = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds: dict[str, list[str]] = {}
    for kind, words in _KEYWORDS.items():
        for word in words:
            # two letters or a digit alone hit everywhere: IBANs and cards are entered with their first digits
            for tail in [str(d) for d in range(10)] if kind == "iban" else [""]:
                kinds.setdefault(word + tail, []).append(kind)
    for word, own in kinds.items():
        found.add_word(word, (len(word), tuple(own)))
    found.make_automaton()
    return found


def _lowered(text: str) -> str:
    """Lower case with every code point in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def _long_enough(kind: str, group: int):
    return lambda match: match.end() if len(match[group]) >= MIN_LENGTH[kind] else None


def _crc_end(match: re.Match) -> int | None:
    rest, digits = zlib.crc32(match[1].encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = _BASE62[digit] + digits
    return match.end() if digits == match[2] else None


def _mod97_end(match: re.Match) -> int | None:
    whole = _IBAN_OF[match[0][:2]].match(match.string, match.start())
    if not whole:
        return None
    plain = whole[0].replace(" ", "")
    return whole.end() if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else None


def _luhn_holds(digits: list[int]) -> bool:
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def _luhn_end(match: re.Match) -> int | None:
    text, end = match.string, match.end()
    digits = [int(c) for c in match[0] if c not in " -"]
    while len(digits) >= _CARD_DIGITS:
        if not "0" <= text[end : end + 1] <= "9" and _luhn_holds(digits):
            return end
        digits.pop()
        end -= 2 if text[end - 2] in " -" else 1
    return None


def _anchored(text: str, kind: str, starts: list[int], pattern: re.Pattern, ends, own_word: bool) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping secrets that begin at keyword hits; ``ends`` tells where one ends, if it is one."""
    spans, free = [], 0
    for start in starts:
        if start < free or own_word and start and text[start - 1].isalnum():
            continue
        match = pattern.match(text, start)
        if not match:
            continue
        end = ends(match)
        if end is not None:
            spans.append((kind, start, end))
            free = end
        elif not own_word:
            free = match.end()  # base kinds: a match that is too short still takes its place
    return spans


_RULES = {
    "assign": (_ASSIGN, _long_enough("assign", 1), False),
    "access": (_ACCESS, _long_enough("access", 0), False),
    "token": (_TOKEN, _crc_end, True),
    "iban": (_IBAN, _mod97_end, True),
    "card": (_CARD, _luhn_end, True),
}


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start, then by kind as listed in ``KINDS``."""
    if not text:
        return []
    hits: dict[str, list[int]] = {}
    for last, (size, kinds) in _automaton().iter(_lowered(text)):
        for kind in kinds:
            hits.setdefault(kind, []).append(last - size + 1)
    spans = []
    for kind, starts in hits.items():
        pattern, ends, own_word = _RULES[kind]
        spans += _anchored(text, kind, sorted(set(starts)), pattern, ends, own_word)
    if b"h" * MIN_LENGTH["hex"] in text.encode().translate(_HEX_BYTES):
        spans += [("hex", *match.span()) for match in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every document with its secrets as structs (kind, start, end)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [
            [{"kind": k, "start": s, "end": e} for k, s, e in scan(text.as_py())] for text in batch.column("text")
        ]
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, pa.list_(span))], names=["doc_id", "spans"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>"
    return arrow_map(docs.select("doc_id", "text"), rows, schema)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, and a count for each added kind)."""

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def listed(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return spans(docs).select(
        "doc_id", *(of(kind) for kind in KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
