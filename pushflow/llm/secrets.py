"""Secret scan: all rules in one pass of a combined automaton, confirmed line by line.

The automaton says for each byte which rules match up to it. No rule crosses a line break,
so only lines with a hit are read again, by the rules' own expressions, which give exact
spans: leftmost and non-overlapping for each rule, with matches that fail a length dropped
and not retried. The automaton has no such memory; what it finds in a line besides (a
secret inside a dropped match) is added. Spans are code points, end exclusive.

Cases: a null or empty text has no spans; one very long line is one long line.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pushflow.llm.automaton import Automaton, compile_rules, scan
from pushflow.llm.common import slices, trim, utf8


@dataclass(frozen=True)
class Rule:
    """base finds candidates, of which `group` must have `least` characters; strict matches only what passes."""

    name: str
    base: str
    strict: str
    group: int = 0
    least: int = 0


_KEYS = r"password|passwd|secret|token|api_?key"
# The base rules, in order, and one that only adds spans.
RULES = (
    Rule("assign", rf"((?i:{_KEYS}))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", rf"(?i:{_KEYS})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{{6,}}", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = 3

Spans = list[tuple[int, int, int]]  # start, rule, end


@lru_cache(4)
def automaton(rules: tuple[Rule, ...] = RULES) -> Automaton:
    return compile_rules([r.strict for r in rules])


@lru_cache(4)
def _expressions(rules: tuple[Rule, ...]) -> list[tuple[re.Pattern, re.Pattern]]:
    return [(re.compile(r.base), re.compile(r.strict)) for r in rules]


def confirm(line: str, at: int, mask: int, rules: tuple[Rule, ...]) -> tuple[Spans, Spans]:
    """Exact spans of the rules in mask and added ones, in a line that begins at code point `at`."""
    base, added = [], []
    for i, (rule, (find, strict)) in enumerate(zip(rules, _expressions(rules), strict=True)):
        if not mask >> i & 1:
            continue
        own = [(m.start(), m.end()) for m in find.finditer(line) if len(m[rule.group]) >= rule.least]
        more = [(m.start(), m.end()) for m in strict.finditer(line)]
        (base if i < BASE else added).extend((at + s, i, at + e) for s, e in own)
        added += [(at + s, i, at + e) for s, e in more if all(e <= a or b <= s for a, b in own)]
    return base, added


def find_batch(column: pa.Array, rules: tuple[Rule, ...] = RULES) -> dict[int, tuple[Spans, Spans]]:
    """Base and added spans of the rows that have any."""
    data, offsets = utf8(column)
    # a line break after each row keeps matches inside rows
    n = len(column)
    buffer = np.full(len(data) + n, 10, np.uint8)
    starts = offsets[:-1] + np.arange(n)
    buffer[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    masks = scan(automaton(rules), buffer)
    hits = np.flatnonzero(masks)
    found: dict[int, tuple[Spans, Spans]] = {}
    if not len(hits):
        return found
    breaks = np.flatnonzero(buffer == 10)
    line = np.searchsorted(breaks, hits)  # breaks[line] is the first break behind the hit
    row = np.searchsorted(starts, hits, "right") - 1
    lines, first = np.unique(line, return_index=True)
    for k, i, j in zip(lines, first, [*first[1:], len(hits)], strict=True):
        r = int(row[i])
        begin = max(int(starts[r]), int(breaks[k - 1]) + 1 if k else 0)
        at = int(np.count_nonzero((buffer[starts[r] : begin] & 0xC0) != 0x80))
        base, added = confirm(buffer[begin : breaks[k]].tobytes().decode(), at, int(np.bitwise_or.reduce(masks[hits[i:j]])), rules)
        own = found.setdefault(r, ([], []))
        own[0].extend(base)
        own[1].extend(added)
    return found


def spans_text(spans: Spans, rules: tuple[Rule, ...] = RULES) -> str:
    return ",".join(f"{rules[k].name}:{s}:{e}" for s, k, e in sorted(spans))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_added long, base_sha256 string, spans string"


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs(doc_id, text): base counts, number of added spans, digest and spans."""

    def work(batches):
        for batch in slices(batches, most=1 << 20):
            found = find_batch(batch.column(1), rules)
            rows = []
            for i in range(batch.num_rows):
                base, added = found.get(i, ([], []))
                rows.append((*(sum(k == x for _, k, _ in base) for x in range(BASE)), len(added), hashlib.sha256(spans_text(base, rules).encode()).hexdigest(), spans_text(base + added, rules)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(text, ...) with every span replaced by [SECRET]; overlapping spans become one."""
    place = docs.columns.index("text")

    def work(batches):
        for batch in slices(batches, most=1 << 20):
            found = find_batch(batch.column(place), rules)
            if found:
                texts = batch.column(place).to_pylist()
                for i, (base, added) in found.items():
                    out, last = [], 0
                    for s, _, e in sorted(base + added):
                        if s >= last:
                            out += [texts[i][last:s], "[SECRET]"]
                        last = max(last, e)
                    texts[i] = "".join([*out, texts[i][last:]])
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
            yield batch
        trim()

    return docs.mapInArrow(work, docs.schema)
