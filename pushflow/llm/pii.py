"""Personal data: base patterns on the text, plus what shows after deobfuscation.

A transducer rewrites homoglyphs, spelled digits and at/dot disguises and keeps, for each
run of output, the source characters it came from; what is then found is mapped back to
the source. Spans are code points, end exclusive. Base spans always stay; a span from the
rewritten text is added unless it touches a base span of its kind.

Cases: a null or empty text has no spans. Every scan is linear in the text's length.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from pushflow.llm.common import slices

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match takes its digit runs whole, so it never begins inside one: the look-behind changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, ordered by kind and start."""
    found: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    found.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((3, m.start(), m.end()))
    return found


# Characters that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "。": ".", "․": ".", "﹒": ".", "｡": ".", "·": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-", "−": "-", "\u00a0": " ",
}
#: Full-width forms stand 0xFEE0 above their ASCII characters.
LOOKALIKES |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
#: Mathematical digits come in five runs of ten.
LOOKALIKES |= {chr(0x1D7CE + i): str(i % 10) for i in range(50)}
#: Arabic-Indic digits, both sets.
LOOKALIKES |= {chr(0x660 + i): str(i) for i in range(10)} | {chr(0x6F0 + i): str(i) for i in range(10)}
#: Characters without width, dropped.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
# Digits as words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_WORD = "|".join(DIGIT_WORDS)
_ODD = re.escape("".join(LOOKALIKES)) + INVISIBLE
_RULES = re.compile(
    rf"""(?P<odd>[{_ODD}])
    |(?P<at>\s{{0,3}}[\[({{<]\s?(?:at|@)\s?[\])}}>]\s{{0,3}}|(?<=[a-z0-9])\s{{1,3}}at\s{{1,3}}(?=[a-z0-9-]+\s{{1,3}}dot\s))
    |(?P<dot>\s{{0,3}}[\[({{<]\s?(?:dot|\.)\s?[\])}}>]\s{{0,3}}|(?<=[a-z0-9])\s{{1,3}}dot\s{{1,3}}(?=[a-z0-9]))
    |(?P<plus>(?<![^\W_])plus\s{{1,3}}(?=(?:{_WORD}|[0-9])(?![a-z])))
    |(?P<digits>(?<![^\W_])(?:{_WORD})(?:[\s-]{{1,2}}(?:{_WORD}))+(?![^\W_]))""",
    re.X | re.I,
)
#: Accepts every text that _RULES can rewrite.
_HINT = re.compile(rf"[{_ODD}]|[\[({{<]\s?(?:at|dot|@|\.)\s?[\])}}>]|\sdot\s|(?<![^\W_])plus\s{{1,3}}(?:{_WORD}|[0-9])(?![a-z])|(?<![a-z])(?:{_WORD})[\s-]{{1,2}}(?:{_WORD})(?![a-z])", re.I)
_SPLIT = re.compile(r"[\s-]+")


class Rewritten:
    """A rewritten text and the source of each of its characters, held by run."""

    def __init__(self, text: str):
        self.out: list[str] = []
        self.at: list[int] = []  # where a run begins in the output
        self.runs: list[tuple[int, int, bool]] = []  # its source, and whether it is unchanged
        size = last = 0

        def put(new: str, start: int, end: int, same: bool) -> None:
            nonlocal size
            if new:
                self.out.append(new)
                self.at.append(size)
                self.runs.append((start, end, same))
                size += len(new)

        for m in _RULES.finditer(text):
            put(text[last : m.start()], last, m.start(), True)
            last, kind = m.end(), m.lastgroup
            if kind == "digits":  # each word is a digit; what parts the words goes
                at = m.start()
                for word in re.finditer(r"[A-Za-z]+", m[0]):
                    put(DIGIT_WORDS[word[0].lower()], at + word.start(), at + word.end(), False)
            else:
                put({"at": "@", "dot": ".", "plus": "+"}.get(kind) or LOOKALIKES.get(m[0], ""), m.start(), m.end(), False)
        put(text[last:], last, len(text), True)
        self.text = "".join(self.out)

    def source(self, i: int) -> tuple[int, int]:
        """Start and end in the source of output character i."""
        k = bisect.bisect_right(self.at, i) - 1
        start, end, same = self.runs[k]
        return (start + i - self.at[k], start + i - self.at[k] + 1) if same else (start, end)


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans found only after rewriting."""
    if not _HINT.search(text):
        return []
    first = Rewritten(text)
    second = Rewritten(first.text) if _HINT.search(first.text) else None
    found = []
    for kind, s, e in base_spans((second or first).text):
        if second:
            s, e = second.source(s)[0], second.source(e - 1)[1]
        found.append((kind, first.source(s)[0], first.source(e - 1)[1]))
    taken = [sorted((s, e) for k, s, e in base if k == kind) for kind in range(len(KINDS))]

    def free(kind: int, s: int, e: int) -> bool:
        i = bisect.bisect_left(taken[kind], (e,))
        return i == 0 or taken[kind][i - 1][1] <= s

    return [x for x in found if free(*x)]


def spans_text(spans, kinds=KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for k, s, e in spans)


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of one text."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, added_spans(text, base)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): counts of base spans by kind, number of added spans, digest and spans."""

    def work(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, more = find(text)
                counts = [sum(k == i for k, _, _ in base) for i in range(4)]
                rows.append((doc_id, *counts, len(more), hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(sorted(base + more))))
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    base, more = find(text)
    out, last = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in base + more):
        if s >= last:
            out += [text[last:s], f"[{KINDS[k].upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]]) if out else text
