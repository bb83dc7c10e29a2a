"""Secret scans: fixed patterns, and windows of high entropy that they miss.

The method: a candidate is a long run of key characters that holds letters and
digits. A window of fixed width slides over the part of each character class in it;
the Shannon entropy of the window follows from counts that change by the character
that leaves and the one that enters. Windows over the threshold of the class, joined
where they overlap, are spans of kind `entropy`. Runs that the allow-list names, and
spans inside one of a fixed pattern, are not reported.

Null and empty texts have no spans. Rows are scanned one by one, so repeated rows,
null IDs and an empty table need nothing special; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.shared import prepare, str_texts, table

KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                     r"""([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Runs are maximal, so a least length here is the same as dropping short matches.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")


@dataclass(frozen=True)
class CharClass:
    """Maximal runs of `chars` with windows of `width` and entropy of `bits` or more."""

    chars: str
    width: int
    bits: float


@dataclass(frozen=True)
class Rules:
    classes: tuple = (CharClass("0-9A-Fa-f", 20, 3.0), CharClass("A-Za-z0-9", 20, 3.6),
                      CharClass("A-Za-z0-9+/_-", 24, 3.9))
    # Whole candidates that are known not to be secrets.
    allow_patterns: tuple = (
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
        r"[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{1,4}", r"[0-9/_+-]+")
    allow_literals: frozenset = field(default_factory=frozenset)


def window_spans(run: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Joined windows of `run` whose entropy is `bits` or more."""
    if len(run) < width:
        return []
    weigh = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    # H = log2(width) - sum(c * log2 c) / width, so only that sum is kept up to date.
    most = (math.log2(width) - bits) * width + 1e-9
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, char in enumerate(run):
        if i >= width:
            gone = run[i - width]
            c = counts[gone]
            total += weigh[c - 1] - weigh[c]
            counts[gone] = c - 1
        c = counts.get(char, 0)
        total += weigh[c + 1] - weigh[c]
        counts[char] = c + 1
        start = i - width + 1
        if start >= 0 and total <= most:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


class Scanner:
    def __init__(self, rules: Rules = Rules()):
        self.classes = [(re.compile(f"[{c.chars}]{{{c.width},}}"), c) for c in rules.classes]
        self.allow = [re.compile(p) for p in rules.allow_patterns]
        self.literals = rules.allow_literals

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(found)

    def entropy(self, text: str, base: list) -> list[tuple[int, int, int]]:
        spans: list[tuple[int, int]] = []
        for run in _RUN.finditer(text):
            word = run[0]
            if (word in self.literals or word.isalpha() or not any(map(str.isalpha, word))
                    or any(p.fullmatch(word) for p in self.allow)):
                continue
            for pattern, kind in self.classes:
                for part in pattern.finditer(word):
                    if any(map(str.isdigit, part[0])) and any(map(str.isalpha, part[0])):
                        at = run.start() + part.start()
                        spans += [(at + a, at + b) for a, b in
                                  window_spans(part[0], kind.width, kind.bits)]
        joined: list[list[int]] = []
        for a, b in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        return [(a, 3, b) for a, b in joined
                if not any(s <= a and b <= e for s, _, e in base)]

    def __call__(self, text: str) -> tuple[list, list]:
        base = self.base(text)
        return base, sorted(base + self.entropy(text, base))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Spans of every text: (doc_id, counts by kind, base_sha256, spans)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            rows = [scanner(text) for text in str_texts(batch)]
            counts = [[sum(s[1] == k for s in spans) for _, spans in rows] for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in rows],
                          pa.string()),
                 pa.array([listed(s) for _, s in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256",
                       "spans"])
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        work, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, "
              "base_sha256 string, spans string")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
