"""Personal data: anchors found by an Aho-Corasick automaton, grown into spans by local parsers.

One pass of the automaton over a text finds at-signs, plus signs, digits, URL schemes and the cue
words of accounts. Around each anchor the text is taken as far as the characters of its kind reach,
and a parser of that kind cuts spans from this stretch and checks them. What a parser reads is one
stretch, so the work follows the number of anchors.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roundscope.llm.blocks import slices

#: Base kinds in the order of the result, then those that this method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?:https?|ftp)://[^\x00-\x20\"'<>\\^`{|}\x7f]+", re.I)
#: Where an account number may begin: country and check digits.
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
#: Signs of account numbers by country, as registered; others are tried from the longest on.
ACCOUNT_SIGNS = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

#: Words that stand before an account number, in any case.
ACCOUNT_CUES = (
    "iban", "account", "acct", "a/c", "konto", "compte", "cuenta", "conto", "conta", "rekening",
    "rachunek", "beneficiary", "payee",
)
#: Signs between such a word and the number ("number", "no.", "of the payee is").
ACCOUNT_GAP = 40

_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    """The check of an international account number: remainder 1 modulo 97."""
    plain = text.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def account(text: str, start: int) -> int | None:
    """Where the account number that begins at ``start`` ends, in groups of four or without."""
    size = ACCOUNT_SIGNS.get(text[start : start + 2])
    longest, ends, at = size or 34, {}, start
    for n in range(1, longest + 1):
        if n % 4 == 1 and n > 1 and text[at : at + 1] == " ":
            at += 1
        if text[at : at + 1] not in _SIGNS:
            break
        at += 1
        ends[n] = at
    if size:
        return ends[size] if size in ends and iban(text[start : ends[size]]) else None
    for n in range(max(ends, default=0), 14, -1):
        if text[ends[n] : ends[n] + 1] not in _SIGNS and iban(text[start : ends[n]]):
            return ends[n]
    return None


def _valid_ip(parts: tuple[str, ...]) -> bool:
    plain = [p.lstrip("0") or "0" for p in parts]
    return all(len(p) <= 3 and int(p) <= 255 for p in plain)


def _valid_card(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _valid_phone(text: str) -> bool:
    return 8 <= len(_NOT_DIGIT.sub("", text)) <= 15


def _emails(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Around each at-sign, what reaches back to the last span or at-sign, and a dotted name."""
    free = start
    at = text.find("@", start, end)
    while at >= 0:
        name = _DOMAIN.match(text, at + 1, end) if at > free else None
        if name:
            yield free, name.end()
        free = name.end() if name else at + 1
        at = text.find("@", free, end)


def _ips(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Numbers joined by dots, four by four from the first."""
    for chain in _CHAIN.finditer(text, start, end):
        at, parts = chain.start(), chain.group().split(".")
        for four in zip(*[iter(parts)] * 4):
            size = sum(map(len, four)) + 3
            if _valid_ip(four):
                yield at, at + size
            at += size + 1


def _cards(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _CARD.finditer(text, start, end) if _valid_card(m.group()))


def _phones(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _PHONE.finditer(text, start, end) if _valid_phone(m.group()))


class Parser:
    """Takes the stretch of ``inside`` characters around an anchor and cuts spans from it."""

    def __init__(self, inside: str, cut: Callable[[str, int, int], Iterator[tuple[int, int]]]):
        self.inside = frozenset(inside)
        self.ahead = re.compile("[" + re.escape(inside) + "]*")
        self.cut = cut

    def spans(self, text: str, anchor: int, floor: int) -> tuple[list[tuple[int, int]], int]:
        """Valid spans of the stretch that holds ``anchor``, and where the stretch ends."""
        start, inside = anchor, self.inside
        while start > floor and text[start - 1] in inside:
            start -= 1
        end = self.ahead.match(text, anchor).end()
        return list(self.cut(text, start, end)), end


_DIGITS = "0123456789"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARSERS = {
    "email": Parser(_LETTERS + _LETTERS.lower() + _DIGITS + "._%+-@", _emails),
    "ip": Parser(_DIGITS + ".", _ips),
    "card": Parser(_DIGITS + " -", _cards),
    "phone": Parser(_DIGITS + " ().-+", _phones),
}
_SIGNS = frozenset(_LETTERS + _DIGITS)
_LOWER = {ord(c): c.lower() for c in _LETTERS}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    cues: dict[str, tuple[str, ...]] = {"@": ("email",), "+": ("phone",), "://": ("url",)}
    cues |= {digit: ("digit",) for digit in _DIGITS}
    cues |= {cue: ("account",) for cue in ACCOUNT_CUES}
    for cue, kinds in cues.items():
        built.add_word(cue, (kinds[0], len(cue)))
    built.make_automaton()
    return built


def _shortened(text: str, start: int, end: int) -> int:
    """Punctuation that closes a sentence is not part of an address."""
    while end > start and text[end - 1] in ".,;:!?)]*&#$%":
        end -= 1
    return end


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, in order and without overlap within a kind."""
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (cue, length) in automaton().iter(text.translate(_LOWER)):
        at = last + 1 - length
        if cue == "digit":
            for kind in ("ip", "card"):
                if at >= done[kind]:
                    spans, done[kind] = _PARSERS[kind].spans(text, at, done[kind])
                    out[kind] += spans
        elif cue in ("email", "phone"):
            if at >= done[cue]:
                spans, done[cue] = _PARSERS[cue].spans(text, at, done[cue])
                out[cue] += spans
        elif cue == "url":
            start = at
            while start > max(done["url"], at - 5) and text[start - 1].isalpha():
                start -= 1
            for begin in range(start, at):
                if m := _URL.match(text, begin):
                    end = _shortened(text, at + 3, m.end())
                    if end > at + 3:
                        out["url"].append((begin, end))
                        done["url"] = end
                    break
        elif at >= done["account"]:
            for m in _ACCOUNT.finditer(text, last + 1, last + 5 + ACCOUNT_GAP):
                if end := account(text, m.start()):
                    out["account"].append((m.start(), end))
                    done["account"] = end
                    break
    return out


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` of each span, by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def spans(docs: DataFrame) -> DataFrame:
    """Per document: its number of spans of each kind, the base spans and all spans as text.

    A null text is read as empty and has no spans. Every row gives a row, repeated ones too; other
    columns are not looked at.
    """
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_spans", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            found = [find(t or "") for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64())]
                + [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS]
                + [pa.array([joined(f, BASE_KINDS) for f in found], pa.string())]
                + [pa.array([joined(f, KINDS) for f in found], pa.string())],
                names=names,
            )

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    schema = f"doc_id bigint, {counts}, base_spans string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def mask(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans go together."""
    found = sorted((a, -b, k) for k, spans in find(text).items() for a, b in spans)
    parts, at = [], 0
    for start, negative, kind in found:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -negative)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """The rows with masked texts; ``n_chars``, if it is there, follows the new text.

    Null texts stay null. All other columns pass through as they are.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            texts = [None if t is None else mask(t) for t in piece.column("text").to_pylist()]
            columns = dict(zip(names, piece.columns))
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                sizes = [None if t is None else len(t) for t in texts]
                columns["n_chars"] = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    fields = [
        T.StructField(f.name, T.LongType()) if f.name == "n_chars" else f
        for f in docs.schema.fields
    ]
    return docs.mapInArrow(run, T.StructType(fields))
