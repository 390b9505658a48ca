"""LM scoring from a log-frequency Bloom filter.

Training texts give counts of words and of word pairs, over all of them.  A count is quantised to a
level - exact while small, then in steps of ``step`` - and an n-gram of level q is entered q times,
as (n-gram, 1) to (n-gram, q).  Probing levels upwards until one is missing gives the level back; a
false positive can only raise it.

Probabilities of word w after v, from probed counts c:

    p(w|v) = (c(v w) + mu * p1(w)) / (c(v) + mu)        p1(w) = (1 - u) c(w) / N,  p1(unknown) = u

where all unknown words are one type whose share u is that of words seen once (Good-Turing).

How it runs, at any size:

1. Texts are tokenised once, in slices of bounded text; the slices' token numbers and word hashes are
   written (frames).
2. Each slice sends its distinct n-grams, with their counts if it is a training slice, to the part of
   the filter that their hash names: a row for each slice and part, so a hot n-gram is one entry a slice.
3. One task a part adds the counts up, builds the part's bits, and writes them with the n-grams that
   slices ask for and the words' exact counts.  A part has about ``part_tokens`` training tokens, and
   an n-gram's levels are no more than its count, so its bits are bounded by that.
4. A filter that takes at most ``all_bytes`` (by the number of training tokens) is broadcast: shards of
   ``shard_parts`` parts one after the other, in pieces of at most ``max_bytes``.  A shard's pass reads only the
   n-grams that are its own, so all passes together read each once.  A larger filter is not sent to all workers:
   the task that builds a part probes it for the slices that ask, in the same job.  So the number of jobs is
   bounded, at any size, and the scores are the same.
5. Levels and exact counts go back to their slices and are put together to scores.

Tokens: A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``, then one end, which also stands before the first
word.  A null text counts as empty and has the end alone; a null id hashes as ''.  Rows are scored
one by one, copies included.  An empty training set gives the base log10(1/1) and scores every
token as unknown.  Exact counts go by 64-bit hashes, a part's probes by 32 bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_folder, text_or_empty, written

END = xxhash.xxh3_64_intdigest(b" ")  # no word holds a space
HASHES = 5
BITS = 12  # a filter entry
STEP = 1.2
MU = 300.0  # pseudo-counts of a pair's smoothing
PAIR = np.uint64(0xA0761D6478BD642F)  # sets pairs' entries apart from words'


def quantiser(step: float = STEP, most: float = 1e15) -> np.ndarray:
    """The least count of each level, from level 1."""
    t = [1.0]
    while t[-1] < most:
        t.append(max(t[-1] + 1, np.ceil(t[-1] * step)))
    return np.array(t)


LEVELS = quantiser()
#: The count that a level stands for: the middle of its range.
VALUES = np.r_[0.0, (LEVELS[:-1] + LEVELS[1:] - 1) / 2, LEVELS[-1]]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(v * np.uint64(0x9E3779B97F4A7C15) + w)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _entry(keys: np.ndarray, level: int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """An entry's word of 64 bits among ``size``, and its bits there."""
    with np.errstate(over="ignore"):
        h = mixed(keys + np.uint64(level) * np.uint64(0xD1B54A32D192ED03))
    at = ((h >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32)).astype(np.int64)
    mask = np.uint64(1) << (h & np.uint64(63))
    for i in range(1, HASHES):
        mask |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
    return at, mask


def build(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits, as 64-bit words, of distinct keys with their counts."""
    q = np.searchsorted(LEVELS, counts, "right")
    words = np.zeros(max(1, -(-int(q.sum()) * BITS // 64)), np.uint64)
    for level in range(1, int(q.max(initial=0)) + 1):
        keys, q = keys[q >= level], q[q >= level]
        at, mask = _entry(keys, level, len(words))
        np.bitwise_or.at(words, at, mask)
    return words


class Filter:
    """Parts of a filter: part number -> bits."""

    def __init__(self, parts: dict[int, bytes]):
        numbers = sorted(parts)
        self.numbers = np.array(numbers, np.int64)
        self.sizes = np.array([len(parts[p]) // 8 for p in numbers], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bits = b"".join(parts[p] for p in numbers)

    def levels(self, keys: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The level of each key, as a byte; part: the number of the part that each belongs to."""
        words = np.frombuffer(self.bits, "<u8")
        row = np.searchsorted(self.numbers, part)
        size, start = self.sizes[row].astype(np.uint64), self.starts[row]
        out, live, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(live):
            level += 1
            at, mask = _entry(keys, level, size)
            hit = np.flatnonzero(words[at + start] & mask == mask)
            live, keys, size, start = live[hit], keys[hit], size[hit], start[hit]
            out[live] = level
        return out


class Tokens:
    """The tokens of some texts.  Distinct words have small numbers, 0 is the end; ``word`` and
    ``before`` are the numbers of each token and of the one before it, ``n`` the tokens of each text."""

    def __init__(self, n: np.ndarray, word: np.ndarray, keys: np.ndarray):
        self.n, self.word, self.keys = n, word, keys
        self.ends = np.cumsum(n)
        # each text is preceded by an end: that of the text before, or the first
        self.before = np.r_[np.zeros(1, word.dtype), word[:-1]]

    @classmethod
    def of(cls, texts: list[bytes]) -> Tokens:
        ids: dict[bytes, int] = defaultdict(count().__next__)
        number = ids.__getitem__
        number(b" ")
        split = [t.lower().split() for t in texts]
        n = np.array([len(w) + 1 for w in split], np.int64)
        word = np.zeros(int(n.sum()), np.uint32)
        at = 0
        for words in split:
            word[at : at + len(words)] = list(map(number, words))
            at += len(words) + 1
        return cls(n, word, np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids)))

    def pairs(self) -> np.ndarray:
        """The key of each token's pair."""
        return pair_keys(self.keys[self.before], self.keys[self.word])


def _slices(batch: pa.RecordBatch, column: int, weight: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about so many bytes of text."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)), np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = min(batch.num_rows, int(np.searchsorted(ends, before + weight)) + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _squeezed(word: np.ndarray) -> bytes:
    """Numbers with all their first bytes first, and so on, compressed."""
    return pa.compress(word.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


FRAME = "slice bigint, trained boolean, ids array<{}>, n array<bigint>, words binary, word binary"


def _framer(weight: int):
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for flag in (True, False):
                for s in _slices(b.filter(pc.equal(b.column(0), flag)), 2, weight):
                    t = Tokens.of(s.column(2).to_pylist())
                    cols = [pa.array([number], pa.int64()), pa.array([flag]), pa.array([s.column(1).to_pylist()], pa.list_(s.column(1).type)), pa.array([t.n], pa.list_(pa.int64())), pa.array([t.keys.tobytes()]), pa.array([_squeezed(t.word)])]
                    yield pa.RecordBatch.from_arrays(cols, ["slice", "trained", "ids", "n", "words", "word"])
                    number += 1

    return frames


def _tokens(n: np.ndarray, words: bytes, word: bytes) -> Tokens:
    raw = pa.decompress(word, decompressed_size=4 * int(n.sum()), codec="zstd", asbytes=True)
    numbers = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return Tokens(n, numbers, np.frombuffer(words, "<u8"))


def _cut(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes of values, cut at the given positions."""
    ends = (np.asarray(at) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


ROUTED = "slice bigint, part int, trained boolean, words binary, word_n binary, pairs binary, pair_n binary"


def _router(parts: int):
    """A slice's distinct n-grams, ascending, by the part that each belongs to."""
    edges = np.arange(parts + 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                trained = b.column(1)[i].as_py()
                t = _tokens(np.asarray(b.column(2)[i].values), b.column(3)[i].as_py(), b.column(4)[i].as_py())
                by = np.argsort(t.keys)
                words, word_n = t.keys[by], np.bincount(t.word, minlength=len(by))[by].astype("<u4")
                pairs, pair_n = np.unique(t.pairs(), return_counts=True)
                at, pair_at = (np.searchsorted(part_of(k, parts), edges) for k in (words, pairs))
                some = np.flatnonzero((at[1:] > at[:-1]) | (pair_at[1:] > pair_at[:-1]))
                nothing = pa.array([b""] * len(some), pa.binary())
                cols = [pa.array(np.full(len(some), b.column(0)[i].as_py())), pa.array(some.astype(np.int32)), pa.array(np.full(len(some), trained))]
                cols += [_cut(words, at).take(some), _cut(word_n, at).take(some) if trained else nothing]
                cols += [_cut(pairs.astype("<u4"), pair_at).take(some), _cut(pair_n.astype("<u4"), pair_at).take(some) if trained else nothing]
                yield pa.RecordBatch.from_arrays(cols, ["slice", "part", "trained", "words", "word_n", "pairs", "pair_n"])

    return route


def _joined(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each one's n."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[by].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _summed_pairs(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_summed of 32-bit keys with 32-bit counts, sorted together as one array."""
    both = np.sort(keys.astype(np.uint64) << np.uint64(32) | n)
    keys = (both >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat((both & np.uint64(0xFFFFFFFF)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


BUILT = "shard int, part int, slice bigint, words binary, exact binary, pairs binary, bits binary, tokens bigint, distinct bigint, once bigint"


class _Part:
    """One part of the filter: its bits, the exact counts of its words, and what slices ask of it."""

    def __init__(self, t: pa.Table):
        learnt = t.filter(t["trained"])
        words, self.n = _summed(_joined(learnt["words"], "<u8"), _joined(learnt["word_n"], "<u4"))
        pairs, pair_n = _summed_pairs(_joined(learnt["pairs"], "<u4"), _joined(learnt["pair_n"], "<u4"))
        few, few_n = _summed(words & np.uint64(0xFFFFFFFF), self.n)
        self.number, self.rows = t["part"][0].as_py(), t.num_rows
        self.bits = build(np.r_[few, pairs.astype(np.uint64) ^ PAIR], np.r_[few_n, pair_n]).tobytes()
        asked = _joined(t["words"], "<u8")
        i = np.minimum(np.searchsorted(words, asked), max(len(words) - 1, 0))
        self.exact = np.where(words[i] == asked, self.n[i], 0) if len(words) else np.zeros(len(asked), np.int64)
        # where each slice's words begin; from here on a part's words go by 32 bits, as its pairs do
        self.at = np.r_[0, np.cumsum(np.asarray(pc.binary_length(t["words"]), np.int64))] // 8
        self.words = (asked & np.uint64(0xFFFFFFFF)).astype("<u4")

    def totals(self) -> dict[str, pa.ChunkedArray]:
        """The part's tokens, distinct words and words seen once, in a last row."""
        null = pa.nulls(self.rows, pa.int64())
        return {k: pa.chunked_array([null, pa.array([int(v)])]) for k, v in (("tokens", self.n.sum()), ("distinct", len(self.n)), ("once", (self.n == 1).sum()))}


def _and_null(column, kind: pa.DataType) -> pa.ChunkedArray:
    return pa.chunked_array([*(column.chunks if isinstance(column, pa.ChunkedArray) else [column]), pa.array([None], kind)])


def _builder(shard_parts: int):
    def one_part(t: pa.Table) -> pa.Table:
        """A row for each slice's n-grams with the words' exact counts, and one with the part's bits."""
        p = _Part(t)
        return pa.table(
            {
                "shard": pa.array(np.full(p.rows + 1, p.number // shard_parts, np.int32)),
                "part": pa.array(np.full(p.rows + 1, p.number, np.int32)),
                "slice": _and_null(t["slice"], pa.int64()),
                "words": _and_null(_cut(p.words, p.at), pa.binary()),
                "exact": _and_null(_cut(p.exact, p.at), pa.binary()),
                "pairs": _and_null(t["pairs"], pa.binary()),
                "bits": pa.chunked_array([pa.nulls(p.rows, pa.binary()), pa.array([p.bits])]),
                **p.totals(),
            }
        )

    return one_part


ANSWERED = "part int, slice bigint, exact binary, word_level binary, pair_level binary, tokens bigint, distinct bigint, once bigint"


def _answered(t: pa.Table) -> pa.Table:
    """A row for each slice with what its n-grams' probes of the part's bits give."""
    p = _Part(t)
    pairs = _joined(t["pairs"], "<u4").astype(np.uint64) ^ PAIR
    asked = np.r_[p.words.astype(np.uint64), pairs]
    level = Filter({p.number: p.bits}).levels(asked, np.full(len(asked), p.number))
    pair_at = np.r_[0, np.cumsum(np.asarray(pc.binary_length(t["pairs"]), np.int64))] // 4
    return pa.table(
        {
            "part": pa.array(np.full(p.rows + 1, p.number, np.int32)),
            "slice": _and_null(t["slice"], pa.int64()),
            "exact": _and_null(_cut(p.exact, p.at), pa.binary()),
            "word_level": _and_null(_cut(level[: len(p.words)], p.at), pa.binary()),
            "pair_level": _and_null(_cut(level[len(p.words) :], pair_at), pa.binary()),
            **p.totals(),
        }
    )


REPLY = "part int, slice bigint, exact binary, word_level binary, pair_level binary"


def _prober(held):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in _slices(whole, 4, 2 << 20)):
            part = np.asarray(b.column(0))
            n_words, n_pairs = (np.asarray(pc.binary_length(b.column(i)), np.int64) // 4 for i in (2, 4))
            words, pairs = _joined(b.column(2), "<u4").astype(np.uint64), _joined(b.column(4), "<u4").astype(np.uint64) ^ PAIR
            level = held.value.levels(np.r_[words, pairs], np.r_[np.repeat(part, n_words), np.repeat(part, n_pairs)])
            made = [_cut(x, np.r_[0, np.cumsum(n)]) for x, n in ((level[: len(words)], n_words), (level[len(words) :], n_pairs))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *made], ["part", "slice", "exact", "word_level", "pair_level"])

    return probe


def _replies(built: DataFrame, sizes: dict[int, list[tuple[int, int]]], max_bytes: int) -> DataFrame:
    """What the filter says to every slice.  sizes: shard -> (part, bytes) of its parts."""
    spark = built.sparkSession
    folder = shared_folder(spark)
    for shard in sorted(sizes):
        pieces: list[list[int]] = [[]]
        room = max_bytes
        for part, size in sorted(sizes[shard]):
            if pieces[-1] and size > room:
                pieces.append([])
                room = max_bytes
            pieces[-1].append(part)
            room -= size
        for k, parts in enumerate(pieces):
            mine = built.where((F.col("shard") == shard) & F.col("part").between(parts[0], parts[-1]))
            bits = mine.where("bits IS NOT NULL").select("part", "bits").toArrow()
            held = spark.sparkContext.broadcast(Filter(dict(zip(bits["part"].to_pylist(), bits["bits"].to_pylist(), strict=True))))
            asked = mine.where("slice IS NOT NULL").select("part", "slice", "words", "exact", "pairs")
            asked.mapInArrow(_prober(held), REPLY).write.parquet(f"{folder}/shard={shard}-{k}")
            held.destroy()
    return spark.read.schema(REPLY).parquet(f"{folder}/shard=*") if sizes else spark.createDataFrame([], REPLY)


def _finisher(total: int, distinct: int, unknown: float, mu: float):
    log_all = np.log10(total + distinct + 1)

    def finish(frame: pa.Table, replies: pa.Table) -> pa.Table:
        t = _tokens(np.asarray(frame["n"].combine_chunks()[0].values), frame["words"][0].as_py(), frame["word"][0].as_py())
        replies = replies.sort_by("part")
        by = np.argsort(t.keys)
        exact, known = np.zeros(len(by), np.int64), np.zeros(len(by))
        exact[by] = _joined(replies["exact"], "<i8")
        known[by] = VALUES[_joined(replies["word_level"], "u1")]
        _, at = np.unique(t.pairs(), return_inverse=True)
        both = VALUES[_joined(replies["pair_level"], "u1")][at]
        p1 = np.where(known > 0, (1 - unknown) * known / max(total, 1), unknown)
        cv, pw = known[t.before], p1[t.word]
        # a pair is seen no oftener than its first word
        p = np.minimum((np.minimum(both, cv) + mu * pw) / (cv + mu), 1.0)
        starts = t.ends - t.n
        base = np.log10(exact + 1.0) - log_all
        sums = (np.add.reduceat(x, starts) for x in ((exact > 0).astype(np.int64)[t.word], base[t.word], np.log10(p)))
        return pa.table({"doc_id": frame["ids"].combine_chunks()[0].values, "trained": pa.array(np.full(len(t.n), frame["trained"][0].as_py())), "n_tokens": pa.array(t.n), **dict(zip(("n_known", "base_score", "score"), map(pa.array, sums), strict=True))})

    return finish


def score(df: DataFrame, trained: Column, id: str = "doc_id", text: str = "text", mu: float = MU, slice_bytes: int = 8 << 20, part_tokens: int = 1 << 20, shard_parts: int = 16, max_bytes: int = 32 << 20, all_bytes: int = 512 << 20) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score of each row of df, by a model of
    the rows where ``trained`` is true."""
    spark, id_type = df.sparkSession, df.schema[id].dataType.simpleString()
    slim = df.select(F.coalesce(trained, F.lit(False)).alias("trained"), F.col(id).alias("id"), text_or_empty(text).cast("binary").alias("text"))
    frames = written(slim.mapInArrow(_framer(slice_bytes), FRAME.format(id_type)))
    tokens = frames.where("trained").agg(F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    parts = max(1, -(-tokens // part_tokens))
    routed = frames.select("slice", "trained", "n", "words", "word").mapInArrow(_router(parts), ROUTED)
    routed = routed.repartition(max(1, parts // 2), "part").groupBy("part")
    folder = shared_folder(spark)
    # an entry for each word and pair of the training texts at most
    if 2 * tokens * BITS // 8 <= all_bytes:
        routed.applyInArrow(_builder(shard_parts), BUILT).write.partitionBy("shard").parquet(folder)
        built = spark.read.schema(BUILT).parquet(folder)
        totals = built.where("bits IS NOT NULL")
        sizes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for shard, part, size in totals.select("shard", "part", F.length("bits")).collect():  # at most all_bytes / part_tokens rows
            sizes[shard].append((part, size))
        replies = _replies(built, sizes, max_bytes)
    else:
        routed.applyInArrow(_answered, ANSWERED).write.parquet(folder)
        built = spark.read.schema(ANSWERED).parquet(folder)
        totals = built.where("slice IS NULL")
        replies = built.where("slice IS NOT NULL").select("part", "slice", "exact", "word_level", "pair_level")
    total, distinct, once = (x or 0 for x in totals.agg(F.sum("tokens"), F.sum("distinct"), F.sum("once")).first())
    if "bits" in built.columns:
        discard(spark, folder)  # all of it has been read
    unknown = min(0.5, max(once / total if total else 0.5, 1e-9))
    schema = f"doc_id {id_type}, trained boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    out = frames.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(_finisher(total, distinct, unknown, mu), schema)
    return out.select("doc_id", "trained", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def held_out(id: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % folds == fold


def score_documents(df: DataFrame, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Train on the rows outside the held-out fold and score all rows."""
    out = score(df, ~held_out(id), id, text, **kw)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
