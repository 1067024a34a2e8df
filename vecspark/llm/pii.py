"""Personal data in texts, disguised or not, at offsets of the original text.

Base detection finds e-mail addresses, IP addresses, card and phone numbers as
written. For disguised ones, transducers rewrite the text: look-alike letters
and invisible characters, digits written as words, "at" and "dot" written out.
Each transducer is a list of edits (start, end, replacement), so every position
of a rewritten text maps back to the source; the same detectors run over the
rewritten text and what they find is reported at its source offsets.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vecspark.llm._common import arrow_rows, row_wise

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_octet(digits: str) -> bool:
    """Whether a run of digits of any length says at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in linear time.

    The part before an @ is the longest run of its characters that starts after
    the last @ and the last match, so each stretch is looked at once.
    """
    end = 0
    for m in DOMAIN.finditer(text):
        low = max(end, text.rfind("@", end, m.start()) + 1)
        start = low + len(text[low : m.start()].rstrip(LOCAL))
        if start < m.start():
            end = m.end()
            yield start, end


def base_spans(text: str) -> list[Span]:
    """Spans (kind, start, end) in code points, by kind and start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", *x) for x in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(is_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# Look-alikes of ASCII letters (Cyrillic, then Greek), and what they look like.
CYRILLIC, AS_LATIN = "АВЕКМНОРСТУХаеорсухіјѕԁԛԝһӏ", "ABEKMHOPCTYXaeopcyxijsdqwhl"
GREEK, AS_LATIN_TOO = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABEZHIKMNOPTYXoav"
# Characters without width.
INVISIBLE = "­​‌‍⁠﻿"
# Other forms of the marks in addresses and numbers.
MARKS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "＋": "+", " ": " ", " ": " ", " ": " ", "　": " "}


def homoglyphs() -> dict[str, str]:
    table = dict(zip(CYRILLIC + GREEK, AS_LATIN + AS_LATIN_TOO, strict=True)) | MARKS
    for first, last, start in ((0xFF10, 0xFF19, "0"), (0xFF21, 0xFF3A, "A"), (0xFF41, 0xFF5A, "a"), (0x0660, 0x0669, "0"), (0x06F0, 0x06F9, "0"), (0x0966, 0x096F, "0"), (0x1D7CE, 0x1D7D7, "0"), (0x1D7D8, 0x1D7E1, "0")):
        table |= {chr(c): chr(ord(start) + c - first) for c in range(first, last + 1)}
    return table | dict.fromkeys(INVISIBLE, "")


# The words for digits, in the four languages of the corpus.
DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
ALPHABET = homoglyphs()
LOOKS = re.compile("[" + re.escape("".join(ALPHABET)) + "]+")
WORD = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
BRACKETED = r"[ \t]*[\[({<][ \t]*(?:dot|\.|punkt|punto|point)[ \t]*[\])}>][ \t]*"
#: Words for digits, digits and written dots in a row; what of it counts, digit_edits decides.
SPELLED = re.compile(rf"(?i)(?<!\w)(?:(?:plus|{WORD}|[0-9]+|dot|point|punkt|punto)(?:{BRACKETED}|[ \t]*[,-][ \t]*|[ \t]+))+(?:{WORD}|[0-9]+)(?!\w)")
PART = re.compile(rf"(?i)(?P<plus>plus)|(?P<dot>{BRACKETED}|dot|point|punkt|punto)|(?P<word>{WORD})|(?P<digits>[0-9]+)|(?P<gap>[ \t,-]+)")
HINT = re.compile(r"(?i)\b(?:dot|punkt|punto|point)\b|[\[({<][ \t]*(?:at|@|\.|arroba|arobase)[ \t]*[\])}>]|[ \t]@|@[ \t]")
ATOM = re.compile(r"[A-Za-z0-9-]+")
#: What may stand for an at sign, without the white space around it.
AT = re.compile(r"(?i)[\[({<][ \t]*+(?:at|@|arroba|arobase)[ \t]*+[\])}>]|(?<=[ \t])(?:at|arroba|arobase)(?=[ \t])|@")
#: A dot in brackets or written out, without the white space around it.
DOT = re.compile(r"(?i)[\[({<][ \t]*+(?:dot|\.|punkt|punto|point)[ \t]*+[\])}>]|(?<=[ \t])(?:dot|punkt|punto|point)(?=[ \t])")
GAP = " \t"


class Rewritten:
    """A text after edits, with the way back from its positions to the source's."""

    def __init__(self, text: str):
        self.text = text
        self.ops: list[tuple[list[int], list[tuple[int, int, int]]]] = []

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace sorted, disjoint ranges of the present text."""
        if not edits:
            return
        parts, starts, runs, at, out = [], [], [], 0, 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            out += start - at
            starts.append(out)
            runs.append((start, end, len(new)))
            out += len(new)
            at = end
        self.ops.append((starts, runs))
        self.text = "".join(parts) + self.text[at:]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source range of a range of the text, and whether an edit lies in it."""
        touched = False
        for starts, runs in reversed(self.ops):
            i = bisect_right(starts, start) - 1
            j = bisect_right(starts, end - 1) - 1
            touched |= j > i or (i >= 0 and start < starts[i] + runs[i][2])
            start = self._back(starts, runs, i, start, 0)
            end = self._back(starts, runs, j, end, 1)
        return start, end, touched

    @staticmethod
    def _back(starts: list[int], runs: list[tuple[int, int, int]], i: int, at: int, last: int) -> int:
        if i < 0:
            return at
        start, end, n = runs[i]
        inside = at - starts[i]
        if inside < n or (last and inside == n):
            return end if last else start
        return end + inside - n


class Held:
    """Spans by kind, each kind's ascending and disjoint."""

    def __init__(self, spans: list[Span]):
        self.starts: dict[str, list[int]] = {}
        self.ends: dict[str, list[int]] = {}
        for kind, start, end in spans:
            self.starts.setdefault(kind, []).append(start)
            self.ends.setdefault(kind, []).append(end)

    def meets(self, kind: str, start: int, end: int) -> bool:
        """Whether a span of the kind shares a character with the range."""
        ends = self.ends.get(kind, [])
        i = bisect_right(ends, start)
        return i < len(ends) and self.starts[kind][i] < end

    def holds(self, kind: str, start: int, end: int) -> bool:
        """Whether a span of the kind covers the range."""
        i = bisect_right(self.starts.get(kind, []), start) - 1
        return i >= 0 and end <= self.ends[kind][i]


def disjoint(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same positions as ascending, disjoint ranges."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def looks_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start() + i, m.start() + i + 1, ALPHABET[c]) for m in LOOKS.finditer(text) for i, c in enumerate(m[0])]


def digit_edits(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits as digits: the gaps inside a run go, a spelled dot or plus is one.

    Fewer than four words in a run may be prose: such a run is rewritten only if a
    number or an IP address comes of it where the text had none of that kind.
    """
    sure, maybe = [], []
    for m in SPELLED.finditer(text):
        parts = list(PART.finditer(text, m.start(), m.end()))
        words = sum(x.lastgroup == "word" for x in parts)
        edits = []
        for x in parts:
            new = {"plus": "+", "dot": ".", "gap": ""}.get(x.lastgroup or "")
            if x.lastgroup == "word":
                new = DIGITS[x[0].lower()]
            if new is not None and (words >= 4 or x.lastgroup != "gap" or "," not in x[0]):
                edits.append((*x.span(), new))
        if words >= 4:
            sure += edits
        elif any(x.lastgroup in ("word", "dot", "plus") for x in parts):
            maybe.append((*m.span(), edits))
    if not maybe:
        return sure
    trial = Rewritten(text)
    trial.apply(sorted(sure + [e for *_, edits in maybe for e in edits]))
    held = Held(base_spans(text))
    found = [(kind, *trial.source(s, e)) for kind, s, e in base_spans(trial.text) if kind != "email"]
    new = Held([("new", s, e) for s, e in disjoint([(s, e) for kind, s, e, touched in found if touched and not held.meets(kind, s, e)])])
    return sorted(sure + [x for start, end, edits in maybe if new.meets("new", start, end) for x in edits])


def widened(text: str, start: int, end: int) -> tuple[int, int]:
    """A range with the blanks on both sides."""
    while start and text[start - 1] in GAP:
        start -= 1
    while end < len(text) and text[end] in GAP:
        end += 1
    return start, end


def host_after(text: str, at: int, dots: dict[int, int]) -> tuple[int, int, list[tuple[int, int]]]:
    """End, number of parts and disguised dots of the host that begins at ``at``."""
    stop, parts, hidden, link = at, 0, [], None
    while atom := ATOM.match(text, at):
        hidden += [link] if link else []
        parts, stop, link = parts + 1, atom.end(), None
        if stop in dots:
            link = (stop, at := dots[stop])
        elif text[stop : stop + 1] == ".":
            at = stop + 1
        else:
            break
    return stop, parts, hidden


def name_before(text: str, low: int, end: int, dots: dict[int, int]) -> tuple[int, list[tuple[int, int]]]:
    """Start (``end`` for none) and disguised dots of the name that ends at ``end`` and begins after ``low``."""
    start, hidden, link = end, [], None
    while True:
        first = at = link[0] if link else end
        while first > low and text[first - 1] in LOCAL:
            first -= 1
        if first == at:
            return start, hidden
        hidden += [link] if link else []
        start = first
        if dots.get(start, low) <= low:
            return start, hidden
        link = (dots[start], start)


def address_edits(text: str) -> list[tuple[int, int, str]]:
    """Disguised addresses: a bare "at" counts only before a host whose dots are all but written out.

    From each sign that may be an at, the host is read forwards and, if there is
    one, the name backwards to the last address at most; names and hosts have any
    number of parts. So each stretch of text is read a bounded number of times.
    """
    out: list[tuple[int, int, str]] = []
    dots = [widened(text, *m.span()) for m in DOT.finditer(text)]
    forwards, backwards, low = dict(dots), {end: start for start, end in dots}, 0
    for m in AT.finditer(text):
        start, end = widened(text, *m.span())
        if start < low:
            continue
        stop, parts, hidden = host_after(text, end, forwards)
        if parts < 2 or (m[0][0] in "aA" and not hidden):
            continue
        first, inner = name_before(text, low, start, backwards)
        if first == start:
            continue
        if text[start:end] != "@":
            out.append((start, end, "@"))
        out += [(*dot, ".") for dot in hidden + inner]
        low = stop
    return sorted(out)


TRANSDUCERS: tuple[tuple[Callable[[str], bool], Callable[[str], list[tuple[int, int, str]]]], ...] = (
    (lambda t: not t.isascii() and LOOKS.search(t) is not None, looks_edits),
    (lambda t: SPELLED.search(t) is not None, digit_edits),
    (lambda t: HINT.search(t) is not None, address_edits),
)


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What the detectors find in the rewritten text only, at source offsets, by kind and start."""
    new = Rewritten(text)
    for wanted, edits in TRANSDUCERS:
        if wanted(new.text):
            new.apply(edits(new.text))
    if not new.ops:
        return []
    held, out = Held(base), []
    for kind, start, end in base_spans(new.text):
        s, e, touched = new.source(start, end)
        if touched and not held.holds(kind, s, e):
            out.append((kind, s, e))
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, spans found by the rewriting only) of one text; null is empty."""
    base = base_spans(text or "")
    return base, added_spans(text or "", base)


def joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span (overlapping ones as one) replaced by its first kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def find_in_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, counts and digest of the base spans, all spans, redacted text.

    Null texts count as empty and keep a null ``redacted``; empty and very long
    texts are ordinary (all patterns take linear time); repeated rows give
    repeated rows; other columns are not read. No shuffle.
    """
    schema = pa.schema([(id_col, pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("redacted", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(at, 1000), []
                for text in part.column(1).to_pylist():
                    base, added = find(text)
                    spans = base + added
                    rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(added), redact(text, spans) if spans and text else text))
                yield arrow_rows(schema, [part.column(0), *zip(*rows, strict=True)] if rows else [[] for _ in schema])

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    picked = docs.select(docs[id_col].cast("bigint").alias(id_col), docs[text_col].alias(text_col))
    return picked.mapInArrow(run, f"`{id_col}` bigint, {counts}, base_sha256 string, spans string, n_added bigint, redacted string")


def redacted_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind; ``length_col``, if it is there, follows the text.

    Null and empty texts stay as they are; very long texts are searched whole;
    repeated rows give repeated rows; all other columns stay. No shuffle.
    """

    def make(texts: list, batch: pa.RecordBatch) -> dict:
        new = []
        for text in texts:
            base, added = find(text)
            new.append(redact(text, base + added) if base or added else text)
        lengths = [None if t is None else len(t) for t in new]
        return {text_col: new} | ({length_col: lengths} if length_col in batch.schema.names else {})

    return row_wise(docs, text_col, make)
