"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over the whole text finds anchors: at
signs, plus signs, digits, URL schemes and identifier cues. Local parsers expand
each anchor to its boundaries and validate it; what lies between anchors is
never looked at again. A parser starts behind its kind's previous match, and ends
found once (of a URL, the next slash or at sign) are kept for the anchors before
them, so the work is linear in the text. Cues and schemes match whatever the case.

Base kinds: email, ip, card, phone. Further kinds: address (a URL that names a
user or an IPv4 host, or a mailto), account (a value behind an identifier cue).
Offsets count code points; the end is exclusive.

Defined cases: null and empty texts have no spans; null ids and repeated rows
are kept, one result row each; a very long text is read in one pass without a copy
of its parts; an empty table gives an empty result; extra columns, also of clashing
names, pass through ``redact`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyloom.llm.common import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")

#: Words that announce an identifier, and URL schemes.
CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "iban", "ssn", "passport", "account number",
        "account no", "acct")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
KEY_PREFIX = "AKIA"
KEY_LENGTH = 20
MIN_ACCOUNT = 6

_DIGITS = frozenset("0123456789")
_UPPER_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz") | _UPPER_ALNUM
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")
_VALUE = _ALNUM | frozenset("-_./+")
_URL_END = frozenset(" \t\n\x0b\x0c\r<>\"'|")


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in _DIGITS:
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for word in (*SCHEMES, *CUES):
        found.add_word(word, ("scheme" if word in SCHEMES else "cue", len(word)))
    found.add_word(KEY_PREFIX.lower(), ("key", len(KEY_PREFIX)))
    found.make_automaton()
    return found


_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _lower(text: str) -> str:
    """``text`` in lower case; every code point stays at its place, and none becomes an ASCII letter that was none."""
    # Only these two change their length or become ASCII letters in ``str.lower``.
    return text.translate(_LOWER) if "\u0130" in text or "\u212a" in text else text.lower()


def _run(text: str, at: int, allowed: frozenset) -> int:
    end = len(text)
    while at < end and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (after := _run(text, end + 1, _LABEL)) > end + 1:
        end, labels = after, labels + 1
    return (start, end) if labels else None


def _ips(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Matches in the chain of dotted numbers at ``at``, and the chain's end."""
    parts, end = [], at
    while True:
        after = _run(text, end, _DIGITS)
        parts.append((end, after))
        if after + 1 < len(text) and text[after] == "." and text[after + 1] in _DIGITS:
            end = after + 1
        else:
            break
    found = []
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        if all(len(v := text[a:b].lstrip("0")) < 4 and int(v or "0") <= 255 for a, b in four):
            found.append((four[0][0], four[3][1]))
    return found, after


def _digit_chain(text: str, at: int) -> tuple[int, list[int]]:
    """End of the digits at ``at`` that single blanks or hyphens may part, and the digits."""
    digits, end = [], at
    while True:
        after = _run(text, end, _DIGITS)
        digits.extend(map(int, text[end:after]))
        if after + 1 < len(text) and text[after] in " -" and text[after + 1] in _DIGITS:
            end = after + 1
        else:
            return after, digits


def luhn(digits: list[int]) -> bool:
    doubled = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _phone(text: str, at: int) -> tuple[int, int] | None:
    """The longest form at a plus sign that ends in a digit, valid or not."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return (at, end) if end > at + 3 else None


class _Next:
    """Places ahead in a text for positions that never fall: each part of the text is searched once."""

    def __init__(self, text: str):
        self.text, self.run, self.trimmed, self.found = text, -1, -1, {}

    def of(self, char: str, at: int) -> int:
        """The first ``char`` from ``at`` on, or the text's length."""
        if self.found.get(char, -1) < at:
            k = self.text.find(char, at)
            self.found[char] = len(self.text) if k < 0 else k
        return self.found[char]

    def url_end(self, at: int) -> int:
        """Where the URL around ``at`` ends, less closing punctuation."""
        if self.run < at:
            stop = at
            while stop < len(self.text) and self.text[stop] not in _URL_END:
                stop += 1
            self.run = stop
            while stop > at and self.text[stop - 1] in ".,;:!?)":
                stop -= 1
            self.trimmed = stop
        return max(at, self.trimmed)


def _address(text: str, start: int, end: int, ahead: _Next) -> tuple[int, int] | None:
    stop = ahead.url_end(end)
    host_end = min(stop, ahead.of("/", end))
    if _lower(text[start:end]) == "mailto:":
        return (start, stop) if ahead.of("@", end) < host_end else None
    host = text[end:host_end]
    numbers = host.rpartition("@")[2].split(":")[0].split(".")
    is_ip = len(numbers) == 4 and all(n.isascii() and n.isdigit() and len(n) < 4 and int(n) <= 255 for n in numbers)
    return (start, stop) if "@" in host or is_ip else None


def _account(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The value behind a cue: optional blanks, one of ``: = #``, quotes; it must hold a digit."""
    if start and text[start - 1] in _ALNUM:
        return None
    at = end
    while at < len(text) and at < end + 8 and text[at] in " :=#\"'":
        at += 1
    if at == end:
        return None
    stop = _run(text, at, _VALUE)
    while stop > at and text[stop - 1] in "-_./+":
        stop -= 1
    value = text[at:stop]
    return (at, stop) if len(value) >= MIN_ACCOUNT and any(c in _DIGITS for c in value) else None


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind, in order of their start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    ahead = _Next(text)
    email_end = ip_end = card_end = phone_end = address_end = account_end = 0
    for last, (kind, length) in automaton().iter(_lower(text)):
        start = last + 1 - length
        if kind == "digit":
            if start >= ip_end:
                spans, ip_end = _ips(text, start)
                found["ip"] += spans
            if start >= card_end:
                card_end, digits = _digit_chain(text, start)
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append((start, card_end))
        elif kind == "at":
            if start >= email_end and (span := _email(text, start, email_end)):
                found["email"].append(span)
                email_end = span[1]
        elif kind == "plus":
            if start >= phone_end and (span := _phone(text, start)):
                phone_end = span[1]
                if 8 <= sum(c in _DIGITS for c in text[start:phone_end]) <= 15:
                    found["phone"].append(span)
        elif kind == "scheme":
            if start >= address_end and (span := _address(text, start, last + 1, ahead)):
                found["address"].append(span)
                address_end = span[1]
        elif kind == "cue":
            if start >= account_end and (span := _account(text, start, last + 1)):
                found["account"].append(span)
                account_end = span[1]
        elif start >= account_end and text.startswith(KEY_PREFIX, start) and not (start and text[start - 1] in _ALNUM):
            stop = _run(text, start, _UPPER_ALNUM)
            if stop - start == KEY_LENGTH:
                found["account"].append((start, stop))
                account_end = stop
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: Iterable[str]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(found[k]))


def redacted(text: str) -> str:
    """``text`` with overlapping spans merged and each replaced by its first kind's mark."""
    spans = sorted((a, b, k) for k, v in find_spans(text).items() for a, b in v)
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
    + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in _SCHEMA]
        for text in batch.column(1):
            found = find_spans(text.as_py() or "")
            base = hashlib.sha256(joined(found, BASE_KINDS).encode()).hexdigest()
            for column, value in zip(rows[1:], (*(len(found[k]) for k in BASE_KINDS), base, joined(found, KINDS)),
                                     strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in rows[1:5]), *(pa.array(c, pa.string()) for c in rows[5:])],
            names=_SCHEMA.names,
        )


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans of every document."""
    picked = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return picked.mapInArrow(_digest, _SCHEMA)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its spans replaced by marks such as ``<EMAIL>``; null texts stay null."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(rewrite, docs.schema)


def op5_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


QUERIES = {"op5_pii_anchors": op5_pii_anchors}
