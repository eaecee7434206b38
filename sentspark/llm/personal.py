"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, a plus before a digit, a digit
before a dot, two digits that are neighbours (or one space or hyphen apart), the ``://`` of a
scheme, and cues of identifiers such as ``iban`` or ``token``. A parser for each kind expands
an anchor to the boundaries of the whole item and validates it:

* ``email``: the local part to the left of the at-sign, a domain of two labels or more.
* ``ip``: four numbers of at most 255 in a dotted chain, counted from the chain's start.
* ``card``: a chain of digits, single spaces or hyphens; 14 to 19 digits passing Luhn's check.
* ``phone``: from the plus to the last digit; 10 to 15 digits.
* ``url``: scheme, host and what follows up to white space, without final punctuation.
* ``account``: the value after a cue. For ``iban`` it passes the mod-97 check; otherwise it has
  at least six letters, digits, ``_`` or ``-``, two or more of them digits.

Items of one kind are found from left to right and do not overlap. An item that fails its
check is dropped as a whole; nothing inside it is tried again. Offsets count code points, the
end is exclusive. Every text is read whole, once, and each parser moves only forward, so the
time is linear in the text whatever it holds.

Null and empty texts hold nothing. Repeated rows have one result each; extra columns and null
ids change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentspark.llm.catalog import query, table
from sentspark.session import ship_package

#: Kinds in the order in which items of one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
#: Words before an identifier.
CUES = ("account", "acct", "iban", "passport", "ssn", "token", "secret", "password", "passwd", "api_key", "apikey")

_AT, _DOT, _LINK, _PLUS, _SCHEME, _CUE = range(6)
_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME_CHARS = _LOCAL - frozenset("_%")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ADDRESS = re.compile(r"[^\s/?#<>\"']+[^\s<>\"']*")
_FINAL = ".,;:!?)]}"
_VALUE = re.compile(r"(?:[ \t]*(?:no|nr|number|id|is)\b)?[ \t.:=#]{1,4}[\"']?([A-Za-z0-9][A-Za-z0-9_-]*)")
_IBAN = re.compile(r"(?:[ \t]*(?:no|nr|number|is)\b)?[ \t.:=#]{1,4}[\"']?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")

_workers: list[ahocorasick.Automaton] = []

Span = tuple[int, int, int]


def _automaton() -> ahocorasick.Automaton:
    """Anchors with their kind and length, built once per worker."""
    if not _workers:
        anchors = {"@": _AT, "://": _SCHEME}
        anchors |= {f"+{d}": _PLUS for d in _DIGITS} | {f"{d}.": _DOT for d in _DIGITS}
        anchors |= {f"{a}{gap}{b}": _LINK for a in _DIGITS for b in _DIGITS for gap in ("", " ", "-")}
        anchors |= {form: _CUE for cue in CUES for form in (cue, cue.upper(), cue.capitalize())}
        found = ahocorasick.Automaton()
        for word, kind in anchors.items():
            found.add_word(word, (kind, len(word)))
        found.make_automaton()
        _workers.append(found)
    return _workers[0]


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(number: str) -> bool:
    short = number.lstrip("0")
    return len(short) < 3 or (len(short) == 3 and short <= "255")


def _iban(value: str) -> bool:
    packed = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _left(text: str, at: int, least: int, allowed: frozenset[str]) -> int:
    """The start of the run of ``allowed`` characters that ends before ``at``."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


_DIGIT_SET = frozenset(_DIGITS)


def spans(text: str) -> list[Span]:
    """All items of a text as (start, kind, end), in order."""
    out: list[Span] = []
    # how far each kind has been read
    email = ip = card = phone = url = account = 0
    for last, (kind, length) in _automaton().iter(text):
        if kind == _LINK:
            start = last - length + 1
            if start < card:
                continue
            card = _CHAIN.match(text, start).end()
            if card - start >= 14:
                digits = text[start:card].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((start, 2, card))
        elif kind == _DOT:
            if last <= ip:
                continue
            start = _left(text, last, ip, _DIGIT_SET)
            if start == last:
                continue
            ip = _DOTTED.match(text, start).end()
            numbers = text[start:ip].split(".")
            for k in range(0, len(numbers) - 3, 4):
                end = start + sum(map(len, numbers[k : k + 4])) + 3
                if all(map(_small, numbers[k : k + 4])):
                    out.append((start, 1, end))
                start = end + 1
        elif kind == _AT:
            start = _left(text, last, email, _LOCAL)
            found = _DOMAIN.match(text, last + 1) if start < last else None
            if found:
                email = found.end()
                out.append((start, 0, email))
        elif kind == _PLUS:
            start = last - 1
            if start < phone:
                continue
            found = _PHONE.match(text, start)
            if found:
                phone = found.end()
                if 10 <= sum(c in _DIGIT_SET for c in text[start:phone]) <= 15:
                    out.append((start, 3, phone))
        elif kind == _SCHEME:
            if last < url:
                continue
            start = _left(text, last - 2, url, _SCHEME_CHARS)
            found = _ADDRESS.match(text, last + 1) if start < last - 2 else None
            if found:
                url = found.end()
                end = last + 1 + len(text[last + 1 : url].rstrip(_FINAL))
                if end > last + 1:
                    out.append((start, 4, end))
        else:
            start = last - length + 1
            if start < account or (start and text[start - 1].isalnum()):
                continue
            bank = text[start : last + 1].lower() == "iban"
            found = (_IBAN if bank else _VALUE).match(text, last + 1)
            if found:
                account = found.end()
                value = found.group(1)
                if _iban(value) if bank else len(value) >= 6 and sum(c in _DIGIT_SET for c in value) >= 2:
                    out.append((found.start(1), 5, found.end(1)))
    out.sort()
    return out


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def personal_spans(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``spans``, an array of (kind, start, end) for every document."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t or "")]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "spans": pa.array(rows, kind)})

    return _narrow(docs, text, id).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redacted(text: str) -> str:
    """The text with every item replaced by its kind in brackets; items that overlap, by the first one's."""
    parts, at = [], 0
    for start, kind, end in spans(text):
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the items of ``text`` replaced; null texts stay null."""

    @F.arrow_udf("string")
    def cleaned(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redacted(t) for t in column.to_pylist()], pa.string())

    return docs.withColumn(text, cleaned(F.col(text)))


def _narrow(docs: DataFrame, text: str, id: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def personal_report(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans."""

    def run(batches):
        for batch in batches:
            columns = {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": []}
            for t in batch.column("text").to_pylist():
                found = spans(t) if t else []
                base = [x for x in found if x[1] < len(BASE)]
                for k, name in enumerate(BASE):
                    columns[f"n_{name}"].append(sum(x[1] == k for x in base))
                columns["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                columns["spans"].append(joined(found))
            kinds = {c: pa.int64() if c.startswith("n_") else pa.string() for c in columns}
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id")} | {c: pa.array(v, kinds[c]) for c, v in columns.items()}
            )

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return _narrow(docs, text, id).mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string")


@query("op12_anchor_expansion")
def op12_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return personal_report(table(spark, sf_dir, "documents"))
