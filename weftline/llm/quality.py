"""Quality rules as a short-circuit cascade.

Each rule is a predicate that rejects a text.  On a sample the cost (seconds a text) and the
selectivity (share rejected) of every rule are measured; the rules then run in descending order of
rejections per second and a text stops at the first that rejects it.  The order changes what the
scan costs, never its verdicts: a text is kept if and only if no rule rejects it.

Words are ``[^\\x20\\x09-\\x0D]+``.  A null text counts as empty; an empty text has no word and
fails ``few_words``.  Repeated rows are judged one by one.  All columns of the input pass through
untouched, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh

#: Fixed values of the published web-text rules used here.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"


class Doc:
    """Measures of one text, each computed once when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.encode("utf-8", "surrogatepass").split(b"\n") if x.split(None, 1)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that occurs at least twice."""
        n = self.n_words
        if n < 4:
            return 0
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in self.words), np.int64, n)
        if len(ids) == n:
            return 0
        _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        _, inv, count = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        again = count[inv] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= again
        return int(hit.sum())

@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def default_rules(
    min_words: int = 50,
    max_repeat_pct: int = 50,
    max_symbol_pct: int = 10,
    max_dup_line_pct: int = 50,
    word_length: tuple[int, int] = (3, 10),
) -> list[Rule]:
    """Thresholds are whole percentages, compared in integers."""
    low, high = word_length
    return [
        Rule("few_words", lambda d: d.n_words < min_words),
        Rule("repeated_words", lambda d: 100 * d.n_repeat_words > max_repeat_pct * d.n_words),
        Rule("symbols", lambda d: 100 * d.n_symbols > max_symbol_pct * d.n_words),
        Rule("repeated_lines", lambda d: 100 * d.n_dup_lines > max_dup_line_pct * len(d.lines)),
        Rule("word_length", lambda d: not low * d.n_words <= d.word_chars <= high * d.n_words),
    ]


def _measured(texts: list[str], rules: list[Rule]) -> list[list[float]]:
    out = []
    for r in rules:
        start, hits = time.perf_counter(), 0
        for t in texts:
            hits += bool(r.rejects(Doc(t)))
        out.append([time.perf_counter() - start, hits])
    return out


def plan_cascade(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 2000, seed: int = 7) -> list[Rule]:
    """The rules in descending order of rejections per second, as measured on about ``sample_rows``
    rows.  The sample orders the rules and does nothing else; ties and an empty sample keep the
    given order."""
    rules = list(rules or default_rules())
    total = df.count()
    if not total:
        return rules
    sample = df.select(df[text].alias("t")).sample(fraction=min(1.0, sample_rows / total), seed=seed)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _measured(b.column(0).to_pylist(), rules)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(rules)), pa.int32()), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.int64())],
                ["rule", "seconds", "hits"],
            )

    rows = sample.mapInArrow(measure, "rule int, seconds double, hits bigint").groupBy("rule").sum("seconds", "hits").collect()
    gain = {r[0]: (r[2] or 0) / max(r[1] or 0.0, 1e-9) for r in rows}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gain.get(i, 0.0), i))]


def cascade(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, drop: bool = False, verdict: str = "kept", **plan) -> DataFrame:
    """``df`` with a boolean ``verdict`` column (named anew if taken), or, with ``drop``, only the
    rows that no rule rejects and only the columns they came with."""
    ordered = plan_cascade(df, text, rules, **plan)
    at = df.columns.index(text)
    verdict = fresh(df.columns, verdict)
    # columns go by position: an input may hold names that differ in case only
    schema = df.schema if drop else T.StructType([*df.schema.fields, T.StructField(verdict, T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [not any(r.rejects(d) for r in ordered) for d in map(Doc, b.column(at).to_pylist())]
            if drop:
                yield b.filter(pa.array(kept, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept, pa.bool_())], [*b.schema.names, verdict])

    return df.mapInArrow(judge, schema)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def report(df: DataFrame, id: str = "doc_id", text: str = "text", rules: list[Rule] | None = None, base: tuple[str, ...] = ("few_words", "repeated_words"), **plan) -> DataFrame:
    """One row a document: the id, the five measures, ``base_failed`` (a rule of ``base`` rejects
    it) and ``kept`` (the cascade's verdict)."""
    rules = list(rules or default_rules())
    ordered = plan_cascade(df, text, rules, **plan)
    base_rules = [r for r in rules if r.name in base]
    slim = df.select(df[id].alias("doc_id"), df[text].alias("text"))
    schema = T.StructType(
        [slim.schema["doc_id"], *(T.StructField(m, T.LongType()) for m in MEASURES), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = [Doc(t) for t in b.column(1).to_pylist()]
            kept = [not any(r.rejects(d) for r in ordered) for d in docs]
            failed = [any(r.rejects(d) for r in base_rules) for d in docs]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([getattr(d, m) for d in docs], pa.int64()) for m in MEASURES), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                schema.names,
            )

    return slim.mapInArrow(judge, schema)
