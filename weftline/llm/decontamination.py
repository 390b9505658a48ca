"""Benchmark decontamination: windows of test texts, found in training texts and removed.

A window is ``n`` consecutive words of a test text; a test text of fewer words, but not none, is one window.
The windows of all test texts are a set of hashes with their words, broadcast to the tasks that scan the
training texts; a hash that is found is compared word for word, so nothing is removed by chance.  A word
inside any occurrence of a window is hit.

The set is built from blocks of at most about ``block_bytes`` of test text (as arrays it is some ten times that), in
one block as a rule, and then one pass without a shuffle does everything.  More test text takes a pass for
each block; what the passes find is united by row.

Words are as in ``terms``.  A null text counts as empty and has no word.  A test text may be null, empty, repeated,
and share windows with any number of others: a document's items are the distinct ids of those with an
occurring window, a null id as null.  All columns of the documents pass through; added ones are named anew if taken.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, text_or_empty, written
from .terms import term_spans, terms
from .units import in_slices

SPANS = "array<struct<start:bigint,end:bigint>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


class Windows:
    """The windows of some test texts: by length, ascending hashes, their words' numbers, and which tests
    have them.  Words that no test has are number 0."""

    def __init__(self, ids: list, texts: list[bytes], n: int):
        self.ids, self.vocabulary = ids, {}
        made: dict[int, dict[tuple, list[int]]] = defaultdict(dict)
        for i, text in enumerate(texts):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in terms(text)]
            size = min(n, len(words))
            for at in range(len(words) - size + 1) if size else ():
                tests = made[size].setdefault(tuple(words[at : at + size]), [])
                if not tests or tests[-1] != i:
                    tests.append(i)
        self.sets = {size: self._set(windows) for size, windows in made.items()}

    @staticmethod
    def _set(windows: dict[tuple, list[int]]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The seed of the hashes, the hashes, the words, and the tests of each window with where they begin."""
        words, seed = np.array(list(windows), np.int64), 1
        while True:
            h = _hashed(words, seed)
            by = np.argsort(h)
            if len(by) < 2 or (np.diff(h[by]) > 0).all():
                break
            seed += 1  # no two windows share a hash
        tests = list(windows.values())
        ends = np.cumsum([0, *(len(tests[i]) for i in by)])
        return seed, h[by], words[by].astype(np.int32), np.array([t for i in by for t in tests[i]], np.int32), ends

    def find(self, texts: list[bytes]) -> tuple[list[int], list[list[dict]], list[set]]:
        """Of each text the number of words, the hit spans of words, and the ids' numbers."""
        split, number = [terms(t) for t in texts], self.vocabulary.get
        n = [len(w) for w in split]
        # the words of all texts, with an unknown one after each
        flat = np.fromiter((number(w, 0) for words in split for w in (*words, b"")), np.int32, sum(n) + len(n))
        ends = np.cumsum(np.array(n, np.int64) + 1)
        known = np.r_[0, np.cumsum(flat > 0)]
        edge, items = np.zeros(len(flat) + 1, np.int32), [set() for _ in texts]
        for size, (seed, hashes, words, tests, begin) in self.sets.items():
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            window = flat[at[:, None] + np.arange(size)]
            i = np.minimum(np.searchsorted(hashes, _hashed(window.astype(np.int64), seed)), len(hashes) - 1)
            same = (words[i] == window).all(axis=1)
            at, i = at[same], i[same]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            for doc, k in set(zip(np.searchsorted(ends, at, "right").tolist(), i.tolist(), strict=True)):
                items[doc].update(tests[begin[k] : begin[k + 1]].tolist())
        hit = np.diff(np.r_[0, (np.cumsum(edge[:-1]) > 0).astype(np.int8), 0])
        spans: list[list[dict]] = [[] for _ in texts]
        starts = ends - np.array(n, np.int64) - 1
        for lo, hi in zip(np.flatnonzero(hit > 0).tolist(), np.flatnonzero(hit < 0).tolist(), strict=True):
            doc = int(np.searchsorted(ends, lo, "right"))
            spans[doc].append({"start": lo - int(starts[doc]), "end": hi - int(starts[doc])})
        return n, spans, items


def _hashed(words: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(len(words), seed, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            h = (h + words[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _test_blocks(tests: DataFrame, id: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    rows = written(tests.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), text_or_empty(text).cast("binary").alias("text")))
    size, count = rows.agg(F.sum(F.length("text") + 16), F.count(F.lit(1))).first()
    blocks = max(1, min(count, -(-(size or 0) // block_bytes)))
    return rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))), blocks


def _scanned(docs: DataFrame, at: int, held, added: list[T.StructField]) -> DataFrame:
    """docs with n_words, the spans and the items that one block's windows give them."""
    item = to_arrow_type(added[2].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = held.value
        for b in batches:
            texts = [t.encode() if t else b"" for t in b.column(at).to_pylist()]
            for lo, hi in in_slices(texts):
                n, spans, items = windows.find(texts[lo:hi])
                ids = [list(dict.fromkeys(windows.ids[i] for i in sorted(x))) for x in items]
                made = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(ids, item)]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, *made], [*b.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *added]))


def _united(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def hits(docs: DataFrame, tests: DataFrame, text: str = "text", test_id: str = "item_id", test_text: str = "text", n: int = 10, block_bytes: int = 16 << 20) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, whose names are returned: the number of words, the spans of hit words
    (numbers from 0, ends excluded, ascending, apart), and the distinct ids of the tests found."""
    spark = docs.sparkSession
    names = [fresh(docs.columns, x) for x in ("n_words", "spans", "items")]
    kinds = T._parse_datatype_string(f"a bigint, b {SPANS}, c array<{tests.schema[test_id].dataType.simpleString()}>")
    added = [T.StructField(k, f.dataType) for k, f in zip(names, kinds.fields, strict=True)]
    rows, blocks = _test_blocks(tests, test_id, test_text, block_bytes)

    def broadcast(i: int):
        got = rows.where(F.col("block") == i).select("id", "text").toArrow()  # about block_bytes
        return spark.sparkContext.broadcast(Windows(got["id"].to_pylist(), got["text"].to_pylist(), n))

    at = docs.columns.index(text)
    if blocks == 1:
        return _scanned(docs, at, broadcast(0), added), names
    rid = fresh([*docs.columns, *names], "rid")
    numbered = written(docs.withColumn(rid, F.monotonically_increasing_id()))  # so that all passes see one numbering
    slim = numbered.select(rid, text)
    found = None
    for i in range(blocks):
        held = broadcast(i)
        some = written(_scanned(slim, 1, held, added).where(F.size(names[1]) > 0).select(rid, *names[1:]))
        found = some if found is None else found.union(some)
        held.destroy()
    lists = found.groupBy(rid).agg(F.flatten(F.collect_list(names[1])).alias(names[1]), F.array_distinct(F.flatten(F.collect_list(names[2]))).alias(names[2]))
    joined = numbered.join(lists, rid, "left").drop(rid)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [len(terms(t.encode())) if t else 0 for t in b.column(at).to_pylist()]
            spans = [_united(s or []) for s in b.column(-2 + b.num_columns).to_pylist()]
            items = [x or [] for x in b.column(-1 + b.num_columns).to_pylist()]
            made = [pa.array(words, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(items, to_arrow_type(added[2].dataType))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *made], [*b.schema.names[:-2], *names])

    return joined.mapInArrow(unite, T.StructType([*docs.schema.fields, *added])), names


def report(docs: DataFrame, tests: DataFrame, id: str = "doc_id", **kw) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.  A test without id
    counts as the empty string there."""
    found, (words, spans, items) = hits(docs.select(F.col(id).alias("doc_id"), F.col(kw.get("text", "text")).alias("text")), tests, **(kw | {"text": "text"}))
    n_hit = F.aggregate(F.transform(spans, lambda s: s["end"] - s["start"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    named = F.array_sort(F.array_distinct(F.transform(items, lambda x: F.coalesce(x.cast("string"), F.lit("")))))
    return found.select(
        "doc_id", F.col(words).alias("n_words"), n_hit.alias("n_hit"), F.size(named).cast("bigint").alias("n_items"), F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def _cut(text: str, spans: list[dict]) -> str:
    raw = text.encode()
    words, at, kept = term_spans(raw), 0, []
    for s in spans:
        kept.append(raw[at : words[s["start"]][0]])
        at = words[s["end"] - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(docs: DataFrame, tests: DataFrame, whole: bool = False, text: str = "text", **kw) -> DataFrame:
    """docs without the hit spans in their texts (from a span's first character to its last; what stands around it
    stays), or, with ``whole``, without the documents that have any."""
    found, (words, spans, items) = hits(docs, tests, text, **kw)
    if whole:
        return found.where(F.size(spans) == 0).drop(words, spans, items)
    at, where = docs.columns.index(text), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns[:where])
            texts, hit = columns[at].to_pylist(), b.column(where).to_pylist()
            columns[at] = pa.array([_cut(t, s) if s else t for t, s in zip(texts, hit, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:where])

    return found.drop(words, items).mapInArrow(cut, docs.schema)
