"""Secret scanning with a trigram inverted index over segments of the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import texts
from .trigrams import Query, trigram_query, trigrams_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Spans of these are added to the base ones.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES


class _Index:
    """Postings (rows of one segment) of the trigrams that some rule asks for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(_long_runs(r)), trigram_query(r.pattern)) for r in rules]
        self.codes = {t: i + 1 for i, t in enumerate(sorted(set().union(*[trigrams_of(q) for _, _, q in self.rules])))}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.codes.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        if len(data) < 3:
            return {}
        low = texts._LOWER[data].astype(np.int32)
        found = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(found)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) * len(offsets) + row[inside])
        code, row = np.divmod(pairs, len(offsets))
        cuts = np.flatnonzero(np.diff(code)) + 1
        return dict(zip(code[np.concatenate([[0], cuts])].tolist(), np.split(row, cuts), strict=True)) if len(code) else {}

    def candidates(self, query: Query, postings: dict[int, np.ndarray], rows: int) -> np.ndarray:
        if query is None:
            return np.arange(rows)
        kind, value = query
        if kind == "has":
            return postings.get(self.codes[value], np.zeros(0, np.int64))
        parts = [self.candidates(q, postings, rows) for q in value]
        if kind == "any":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, p, assume_unique=True)
        return out


def _long_runs(rule: Rule) -> str:
    """A run of one class that must have a least length is found as such a run: the same matches, fewer tries."""
    m = re.fullmatch(r"(\[[^]]+\])\+", rule.pattern)
    return f"{m[1]}{{{rule.least},}}" if m and not rule.group else rule.pattern


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with ``out``: array of (kind, start, end) in code points, by start, then by the rules' order.

    A rule's matches are leftmost and do not overlap; those whose group is
    shorter than its least length are dropped.  The corpus is read in segments of
    about two megabytes that stay where they are.  Each segment gets an inverted
    index of the trigrams that rules ask for; a rule's Boolean trigram query
    (derived from its pattern) intersects and unites postings, and only the rows
    left are matched against the pattern.  Rules without mandatory trigrams, such
    as runs of hex digits, scan every row.

    Null and empty texts have no secrets.  Other columns stay; a column already
    named ``out`` is replaced.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(rules)
        for part in texts.chunks(batches, text_col):
            column = part.column(text_col).fill_null("")
            postings = index.postings(*texts.raw(column))
            spans: dict[int, list] = {}
            for order, (rule, pattern, query) in enumerate(index.rules):
                for row in index.candidates(query, postings, part.num_rows).tolist():
                    for m in pattern.finditer(column[row].as_py()):
                        if len(m[rule.group]) >= rule.least:
                            spans.setdefault(row, []).append((m.start(), order, m.end()))
            values = [[{"kind": rules[o].kind, "start": a, "end": b} for a, o, b in sorted(spans.get(row, []))] for row in range(part.num_rows)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, kind)], [*part.schema.names, out])

    docs = docs.drop(out)
    return docs.mapInArrow(run, docs.withColumn(out, F.lit(None).cast("array<struct<kind:string,start:int,end:int>>")).schema)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
