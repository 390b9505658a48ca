"""Ranked lexical search over a two-level quantised index.

Of N texts with a term and L terms in all of them, a text of n terms has m = 100 - b + (b * n * N) div L, and
a term that occurs tf times in it the impact I = (10^9 * tf) div (1000 * tf + 20 * m).  A text's score for a
query is the sum of w * I over the query's distinct terms, w = floor(1000 * ln((2N + 2) / (2df + 1))) for a
term that df texts hold.  All but w is computed in integers.

The index is a table of segments, each of about ``segment_bytes`` of whole texts, made without a shuffle:

level one  for each term its texts and one byte a text, the impact rounded upwards to a multiple of STEP
level two  how often each text has the term, and the texts' sizes

How queries are answered, in blocks of bounded size, each broadcast to every segment:

1. df of the block's terms, from the segments' term lists alone.
2. Level one bounds every text's score from above and (as rounding adds less than STEP) from below.  The k-th
   largest lower bound of a query, over all texts, is a score that k texts reach.
3. A text whose upper bound is less than that cannot be among the best k.  Every other one is rescored
   exactly from level two; each task hands on its k best of a query, and the best k of those are the result.

A task keeps at most k numbers or texts a query, so copies of one text, however many, cost no more than
others.  Ties go by ascending id, null ids last; rows with the same id are texts of their own.  A null text
has no term and is never found, nor does it count; a query without terms finds nothing.  Repeated queries are
answered each.  Empty tables give empty results.  Other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, shared_folder, text_or_empty, written
from .terms import terms
from .units import in_slices

#: The largest impact is under a million, and 255 steps reach it.
STEP = -(-1_000_000 // 255)
#: Texts of a segment are numbered in 16 bits.
MOST_TEXTS = 1 << 16
SEGMENT = "ids array<{}>, n binary, terms binary, starts binary, docs binary, impacts binary, tf binary"


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def sizes(n: np.ndarray, texts: int, all_terms: int, b: int) -> np.ndarray:
    """m of texts of n terms; in Python's integers, as the product may be long."""
    return np.array([100 - b + b * int(x) * texts // max(all_terms, 1) for x in n], np.int64)


def weight(df: int, texts: int) -> int:
    return math.floor(1000 * math.log((2 * texts + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Index:
    segments: DataFrame
    texts: int
    terms: int
    b: int
    folder: str


def _totals(slim: DataFrame) -> tuple[int, int]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(terms(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))], pa.int64()), pa.array([sum(n)], pa.int64())], ["texts", "terms"])

    got = slim.mapInArrow(add, "texts bigint, terms bigint").agg(F.sum("texts"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


def _segment(texts: list[bytes], total: tuple[int, int], b: int) -> list[bytes]:
    """n, terms, starts, docs, impacts, tf of some texts."""
    split = [terms(t) for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    number: dict[bytes, int] = defaultdict(count().__next__)
    flat = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
    posting, tf = np.unique(flat * len(texts) + np.repeat(np.arange(len(texts)), n), return_counts=True)
    term, doc = np.divmod(posting, len(texts))
    starts = np.searchsorted(term, np.arange(len(number) + 1))
    rounded = -(-impacts(tf, sizes(n, *total, b)[doc]) // STEP)
    return [n.tobytes(), b" ".join(number), starts.astype("<u4").tobytes(), doc.astype("<u2").tobytes(), rounded.astype("u1").tobytes(), tf.astype("<u4").tobytes()]


def build_index(df: DataFrame, id: str = "doc_id", text: str = "text", b: int = 50, segment_bytes: int = 4 << 20) -> Index:
    """Index every text of df below the shared folder.  b: how much a text's size counts, of 100."""
    slim = df.select(F.col(id).alias("id"), text_or_empty(text).cast("binary").alias("text"))
    total = _totals(slim)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            texts = texts.to_pylist()
            for start, end in in_slices(texts, segment_bytes):
                for lo in range(start, end, MOST_TEXTS):
                    hi = min(end, lo + MOST_TEXTS)
                    made = _segment(texts[lo:hi], total, b)
                    held = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids.slice(lo, hi - lo))
                    yield pa.RecordBatch.from_arrays([held, *(pa.array([x], pa.binary()) for x in made)], ["ids", "n", "terms", "starts", "docs", "impacts", "tf"])

    folder = shared_folder(df.sparkSession)
    made = slim.mapInArrow(segments, SEGMENT.format(df.schema[id].dataType.simpleString()))
    return Index(written(made, folder), *total, b, folder)


class Block:
    """Some queries: their distinct terms by number, and each query's terms.  ``of`` gives a segment's
    postings of the terms it holds."""

    def __init__(self, queries: list[tuple[object, list[bytes]]]):
        self.number: dict[bytes, int] = {}
        self.ids = [q for q, _ in queries]
        self.terms = [[self.number.setdefault(t, len(self.number)) for t in dict.fromkeys(words)] for _, words in queries]

    def of(self, held: bytes, starts: bytes) -> list[tuple[int, int, int]]:
        """(number, first posting, end) of the block's terms that a segment holds."""
        get, edges = self.number.get, np.frombuffer(starts, "<u4").tolist()
        return [(k, edges[i], edges[i + 1]) for i, t in enumerate(held.split(b" ")) if (k := get(t)) is not None]


def _bytes(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        yield tuple(batch[k][i].as_py() for k in names)


def _document_frequencies(index: Index, held) -> dict[int, int]:
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        df = np.zeros(len(block.number), np.int64)
        for b in batches:
            for names, starts in _bytes(b, "terms", "starts"):
                for k, lo, hi in block.of(names, starts):
                    df[k] += hi - lo
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    got = index.segments.select("terms", "starts").mapInArrow(counts, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in got.collect()}  # at most the block's terms


def _uppers(block: Block, weights: list[int], texts: int, names: bytes, starts: bytes, docs: bytes, levels: bytes):
    """For each query that finds something: its number, the terms found, and by text the sum of w * byte and of w."""
    doc, level = np.frombuffer(docs, "<u2"), np.frombuffer(levels, "u1")
    lists = {k: (doc[lo:hi], level[lo:hi] * np.int64(weights[k]), lo, hi) for k, lo, hi in block.of(names, starts) if weights[k]}
    for q, wanted in enumerate(block.terms):
        found = [k for k in wanted if k in lists]
        if found:
            upper, whole = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
            for k in found:
                at, add, _, _ = lists[k]
                upper[at] += add
                whole[at] += weights[k]
            yield q, [(k, *lists[k][2:]) for k in found], upper, whole


def _largest(x: np.ndarray, k: int) -> np.ndarray:
    return x if len(x) <= k else np.partition(x, len(x) - k)[len(x) - k :]


def _lower_bounds(index: Index, held, weights: list[int], k: int) -> DataFrame:
    """(query, low): the k largest positive lower bounds of each query in each task."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        best = [np.zeros(0, np.int64)] * len(block.terms)
        for b in batches:
            for n, *level_one in _bytes(b, "n", "terms", "starts", "docs", "impacts"):
                for q, _, upper, whole in _uppers(block, weights, len(n) // 8, *level_one):
                    lower = STEP * (upper - whole) + whole
                    best[q] = _largest(np.r_[best[q], _largest(lower[lower > 0], k)], k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best), dtype=np.int32), [len(x) for x in best])), pa.array(np.concatenate([*best, np.zeros(0, np.int64)]))], ["query", "low"])

    return index.segments.select("n", "terms", "starts", "docs", "impacts").mapInArrow(bound, "query int, low bigint")


def best(rows: DataFrame, by: str, order: list[Column], k: int, salts: int = 64) -> DataFrame:
    """The k first rows of each ``by`` with their rank.  In two steps, so that what many tasks hand on for one
    key meets in parts first; before either shuffle Spark keeps k rows of a key and task."""
    salt, rank = "__salt", "rank"
    parts = rows.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(salts)))
    for keys in ([by, salt], [by]):
        parts = parts.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
        parts = parts.drop(rank) if salt in keys else parts
    return parts.drop(salt)


def _rescored(index: Index, held, weights: list[int], least: list[int], k: int, id_type, query_type) -> DataFrame:
    """(query, item_id, doc_id, score): the k best of each query in each task, by exact scores."""
    total, b = (index.texts, index.terms), index.b
    kinds = [pa.int32(), to_arrow_type(query_type), to_arrow_type(id_type), pa.int64()]

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        top: list[list[tuple]] = [[] for _ in block.terms]
        for batch in batches:
            for i in range(batch.num_rows):
                ids, (n, names, starts, docs, levels, tfs) = batch["ids"][i].values, (batch[c][i].as_py() for c in ("n", "terms", "starts", "docs", "impacts", "tf"))
                m, doc, tf = sizes(np.frombuffer(n, np.int64), *total, b), np.frombuffer(docs, "<u2"), np.frombuffer(tfs, "<u4")
                for q, found, upper, _ in _uppers(block, weights, len(m), names, starts, docs, levels):
                    may = np.flatnonzero(STEP * upper >= max(least[q], 1))
                    score = np.zeros(len(may), np.int64)
                    for t, lo, hi in found if len(may) else ():
                        at = np.minimum(np.searchsorted(doc[lo:hi], may), hi - lo - 1) + lo
                        has = np.flatnonzero(doc[at] == may)
                        score[has] += weights[t] * impacts(tf[at[has]].astype(np.int64), m[may[has]])
                    keep = score >= max(1, _largest(score, k).min(initial=1 << 62) if len(score) > k else 1)
                    some = ids.take(pa.array(may[keep])).to_pylist()
                    top[q] = heapq.nsmallest(k, chain(top[q], ((-s, d is None, d) for s, d in zip(score[keep].tolist(), some, strict=True))), key=_by_id)
        rows = [(q, block.ids[q], d, -s) for q, got in enumerate(top) for s, _, d in got]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["query", "item_id", "doc_id", "score"])

    schema = f"query int, item_id {query_type.simpleString()}, doc_id {id_type.simpleString()}, score bigint"
    return index.segments.mapInArrow(rescore, schema)


def _by_id(row: tuple) -> tuple:
    score, missing, id = row
    return (score, missing) if missing else (score, missing, id)


def search(index: Index, queries: DataFrame, id: str = "item_id", text: str = "text", k: int = 50, block_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each query's k best texts with a score above 0."""
    spark, query_type = queries.sparkSession, queries.schema[id].dataType
    id_type = index.segments.schema["ids"].dataType.elementType
    asked = written(queries.select(F.monotonically_increasing_id().alias("query"), F.col(id).alias("id"), text_or_empty(text).cast("binary").alias("text")))
    size, rows = asked.agg(F.sum(F.length("text") + 16), F.count(F.lit(1))).first()
    blocks, folder = max(1, min(rows, -(-(size or 0) // block_bytes))), shared_folder(spark)
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).select("id", "text").toArrow()  # about block_bytes
        if i and not rows.num_rows:
            continue
        block = Block([(q, terms(t)) for q, t in zip(rows["id"].to_pylist(), rows["text"].to_pylist(), strict=True)])
        held = spark.sparkContext.broadcast(block)
        df = _document_frequencies(index, held)
        weights = [weight(df[k], index.texts) if k in df else 0 for k in range(len(block.number))]
        lows = best(_lower_bounds(index, held, weights, k), "query", [F.desc("low")], k)
        kth = {r["query"]: r["low"] for r in lows.where(F.col("rank") == k).collect()}  # a number a query
        least = [kth.get(q, 0) for q in range(len(block.terms))]
        found = _rescored(index, held, weights, least, k, id_type, query_type)
        best(found, "query", [F.desc("score"), F.asc_nulls_last("doc_id")], k).select("item_id", "rank", "doc_id", "score").write.parquet(f"{folder}/block={i}")
        held.destroy()
    schema = f"item_id {query_type.simpleString()}, rank int, doc_id {id_type.simpleString()}, score bigint"
    return spark.read.schema(schema).parquet(f"{folder}/block=*")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 50, **kw) -> DataFrame:
    """Index docs, answer the queries, and delete the index."""
    index = build_index(docs, **kw)
    found = search(index, queries, k=k)
    discard(docs.sparkSession, index.folder)
    return found
