"""Personal data in plain and in disguised spelling, with spans in the source text.

Two passes over each whole text. The first finds e-mail addresses, IP addresses, card and phone
numbers as written. The second runs the text through transducers that rewrite disguises to the plain
spelling (look-alike and full-width characters, invisible characters, spelled digits, "at" and
"dot" in words or brackets) while noting for every character of the result which source characters
it came from; what is then detected is mapped back to source offsets. Spans count code points, end
exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.workers import bound_batches, release, trimmed

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a match never starts inside a run of digits unless it could start at the run's first digit
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ outwards in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of identifiers as written, each kind leftmost and non-overlapping.

    A match whose numbers fail (IP part over 255, card of other than 14 to 19 digits or wrong check
    digit, phone of other than 10 to 15 digits) is dropped and not retried.
    """
    out = [(i, 0, j) for i, j in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# Cyrillic and Greek letters that look like Latin ones, and punctuation look-alikes.
_ALIKE = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅοαινρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXIJSoaivptuABEZHIKMNOPTYX", strict=True))
_ALIKE |= dict(zip("‐‑‒–—−․。｡·∙•＠﹫﹒", "------......@@.", strict=True))
_INVISIBLE = frozenset("­​‌‍⁠﻿᠎")
# The digits' names in English, Spanish, French and German.
_NAMES = (
    "zero oh cero zéro null",
    "one uno une eins",
    "two dos deux zwei",
    "three tres trois drei",
    "four cuatro quatre vier",
    "five cinco cinq fünf",
    "six seis sechs",
    "seven siete sept sieben",
    "eight ocho huit acht",
    "nine nueve neuf neun",
)
_VALUE = {name: str(i) for i, names in enumerate(_NAMES) for name in names.split()}
_NAME = "(?:" + "|".join(sorted(_VALUE, key=len, reverse=True)) + ")"
_GAP = r"[ \t,./_-]{1,3}"
#: Digits' names and plain digits in a row, from which what follows the last name is cut off.
_SPELLED = re.compile(rf"(?<!\w)(?:(?:plus|más|mas) )?(?:{_NAME}(?!\w)|[0-9]{{1,4}})(?:{_GAP}(?:{_NAME}(?!\w)|dot(?!\w)|[0-9]{{1,4}}))*", re.IGNORECASE)
_BLANK = re.compile(r"\s")
_NAME_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)", re.IGNORECASE)
_PIECE = re.compile(rf"({_NAME})|(dot)|(plus|más|mas)|([0-9]+)", re.IGNORECASE)
_AT_NAME = r"(?:at|arroba|arobase)"
_DOT_NAME = r"(?:dot|punto|point|punkt)"
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_AT_BOXED = rf"[ \t]?{_OPEN}[ \t]?(?:{_AT_NAME}|@)[ \t]?{_SHUT}[ \t]?"
_AT_BARE = rf"[ \t]+{_AT_NAME}[ \t]+|[ \t]+@[ \t]*|@[ \t]+"
_DOT_BOXED = rf"[ \t]?{_OPEN}[ \t]?(?:{_DOT_NAME}|\.)[ \t]?{_SHUT}[ \t]?"
_DOT_BARE = rf"[ \t]+{_DOT_NAME}[ \t]+"
_LABEL = r"[A-Za-z0-9-]+"
_DOT_ANY = rf"{_DOT_BOXED}|{_DOT_BARE}"
#: An address with a disguise: a boxed "at" goes with any dot, a bare one only with a disguised dot.
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:(?:\.|{_DOT_ANY})[A-Za-z0-9_%+-]{{1,64}}){{0,4}}"
    rf"(?:(?:{_AT_BOXED})[A-Za-z0-9-]{{1,63}}(?:(?:\.|{_DOT_ANY})[A-Za-z0-9-]{{1,63}}){{1,6}}"
    rf"|(?:@|{_AT_BARE})[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,4}}(?:(?:{_DOT_ANY})[A-Za-z0-9-]{{1,63}}){{1,4}})",
    re.IGNORECASE,
)
_ADDRESS_HINT = re.compile(rf"{_OPEN}[ \t]?(?:{_AT_NAME}|@|{_DOT_NAME}|\.)[ \t]?{_SHUT}|[ \t]{_DOT_NAME}[ \t]", re.IGNORECASE)
_DOTTED = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{_DOT_ANY})[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
#: What makes fewer than four names a number: a digit, a plus or a dot in words or brackets beside them.
_LEFT = re.compile(rf"(?:[0-9+]|{_DOT_NAME}|{_OPEN}[ \t]?\.)\W{{0,4}}$", re.IGNORECASE)
_RIGHT = re.compile(rf"\W{{0,4}}(?:[0-9]|{_DOT_NAME}(?!\w))", re.IGNORECASE)
_AT = re.compile(rf"{_AT_BOXED}|{_AT_BARE}", re.IGNORECASE)
_DOT = re.compile(_DOT_ANY, re.IGNORECASE)
_LETTER_DIGIT = re.compile(r"(?<=[0-9])[OolI](?=[0-9OolI])|(?<=[0-9 .-])[OolI](?=[0-9])")
_LETTER_VALUE = {"O": "0", "o": "0", "l": "1", "I": "1"}


class _Alike(dict):
    """Character to its plain form, looked up once: listed look-alikes, any script's digits, compatibility forms."""

    def __missing__(self, code: int) -> int:
        ch = chr(code)
        if ch in _ALIKE:
            to = _ALIKE[ch]
        elif (value := unicodedata.decimal(ch, None)) is not None:
            to = str(value)
        else:
            to = unicodedata.normalize("NFKC", ch)
        self[code] = found = ord(to) if len(to) == 1 and to.isascii() and not to.isspace() else code
        return found


_alike = _Alike()


class Tape:
    """A rewritten text; piece i of it stands for the source characters [start[i], end[i])."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [i, j) by a string of any length, for disjoint ordered (i, j, string)."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for i, j, new in edits:
            text += (self.text[at:i], new)
            start += self.start[at:i]
            end += self.end[at:i]
            start += [self.start[i]] * len(new)
            end += [self.end[j - 1]] * len(new)
            at = j
        text.append(self.text[at:])
        start += self.start[at:]
        end += self.end[at:]
        self.text, self.start, self.end = "".join(text), start, end


def _characters(tape: Tape) -> bool:
    text = tape.text
    if text.isascii():
        return False
    seen = set(text)
    hit = False
    if seen & _INVISIBLE:
        tape.rewrite([(i, i + 1, "") for i, c in enumerate(text) if c in _INVISIBLE])
        hit = True
    if any(_alike[ord(c)] != ord(c) for c in seen if c > "\x7f"):
        tape.text = tape.text.translate(_alike)
        hit = True
    return hit


def _spelled_digits(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Edits that write spelled digits as digits without gaps, and the same with single dots kept.

    Four names in a row are a number, fewer are where digits, a plus or dots stand beside them.
    """
    joined, dotted = [], []
    for m in _SPELLED.finditer(text):
        pieces = list(_PIECE.finditer(m[0]))
        while pieces and pieces[-1][1] is None:
            pieces.pop()
        if not pieces:
            continue
        start, end = m.start(), m.start() + pieces[-1].end()
        if sum(p[1] is not None for p in pieces) < 4 and all(p[1] for p in pieces):
            if not (_LEFT.search(text[max(0, start - 12) : start]) or _RIGHT.match(text, end)):
                continue
        at = start
        for p in pieces:
            value = _VALUE[p[1].lower()] if p[1] else "." if p[2] else "+" if p[3] else p[4]
            i, j = start + p.start(), start + p.end()
            if i > at:
                joined.append((at, i, ""))
                if text[at:i] != ".":
                    dotted.append((at, i, ""))
            if value != text[i:j]:
                joined.append((i, j, value))
                dotted.append((i, j, value))
            at = j
    return joined, dotted


def _addresses(tape: Tape) -> bool:
    if not _ADDRESS_HINT.search(tape.text):
        return False
    edits = []
    for m in _ADDRESS.finditer(tape.text):
        inside = [(a.start(), a.end(), "@") for a in _AT.finditer(tape.text, m.start(), m.end())][:1]
        dots = [(d.start(), d.end(), ".") for d in _DOT.finditer(tape.text, m.start(), m.end())]
        edits += sorted(inside + dots)
    tape.rewrite(edits)
    numbers = [m for m in _DOTTED.finditer(tape.text)]
    dots = [(d.start(), d.end(), ".") for m in numbers for d in _DOT.finditer(tape.text, m.start(), m.end())]
    tape.rewrite(dots)
    return bool(edits or dots)


def _letter_digits(tape: Tape) -> bool:
    if not _LETTER_DIGIT.search(tape.text):
        return False
    tape.rewrite([(m.start(), m.end(), _LETTER_VALUE[m[0]]) for m in _LETTER_DIGIT.finditer(tape.text)])
    return True


def _beyond(starts: list[int], ends: list[int], start: int, end: int) -> list[tuple[int, int]]:
    """The parts of [start, end) outside of the given ordered, disjoint spans."""
    out = []
    for k in range(bisect.bisect_right(ends, start), bisect.bisect_left(starts, end)):
        if starts[k] > start:
            out.append((start, starts[k]))
        start = ends[k]
    return [*out, (start, end)] if start < end else out


def _merged(parts: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, ordered and disjoint."""
    starts, ends = [], []
    for i, j in sorted(parts):
        if ends and i < ends[-1]:
            ends[-1] = max(ends[-1], j)
        else:
            starts.append(i)
            ends.append(j)
    return starts, ends


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans as written, and all spans: those and the disguised ones that reach beyond those of their kind."""
    base = plain_spans(text)
    every = list(base)
    plain = Tape(text)
    changed = _characters(plain)
    ways = [[], *_spelled_digits(plain.text)]
    ways = [way for k, way in enumerate(ways) if way not in ways[:k]]
    for way in ways:
        tape = Tape(plain.text)
        tape.start, tape.end = plain.start, plain.end
        tape.rewrite(way)
        if not (any([step(tape) for step in (_addresses, _letter_digits)]) or changed or way):
            continue
        known = [_merged([(i, j) for i, k, j in every if k == kind]) for kind in range(len(KINDS))]
        for i, kind, j in plain_spans(tape.text):
            start, end = tape.start[i], tape.end[j - 1]
            rest = _beyond(*known[kind], start, end)
            # a digit's name next to a whole identifier is mostly a word, as in "10.0.0.1 one day"
            if rest and (not way or rest == [(start, end)] or (kind and any(len(_NAME_WORD.findall(text, *r)) > 1 or not _BLANK.search(text, *r) for r in rest))):
                every.append((start, kind, end))
    return base, sorted(every)


def _written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in found)


_FIELDS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_disguised bigint"


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in range(7)]
        for text in batch.column(1).to_pylist():
            base, every = spans(text or "")
            counts = [0, 0, 0, 0]
            for _, k, _ in base:
                counts[k] += 1
            digest = hashlib.sha256(_written(base).encode()).hexdigest()
            for column, value in zip(rows, (*counts, digest, _written(every), len(every) - len(base)), strict=True):
                column.append(value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], ["id", *names]
        )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id, counts of the plain spans by kind, digest, and all spans.

    Null and empty texts have no spans. Ids are passed through, null and repeated ones too; an empty
    table gives an empty table; further columns are ignored.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(_detect), f"id {kind}, {_FIELDS}")
    return out.withColumnRenamed("id", id_col)


def redact_text(text: str) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the earlier stays."""
    out, at = [], 0
    for i, k, j in spans(text)[1]:
        if i >= at:
            out += (text[at:i], f"[{KINDS[k].upper()}]")
            at = j
        else:
            at = max(at, j)
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data replaced in text_col; null texts stay null, other columns as they are."""

    bound_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        out = pa.array([None if t is None else redact_text(t) for t in texts.to_pylist()], pa.string())
        release()
        return out

    return docs.withColumn(text_col, redact(F.col(text_col)))
