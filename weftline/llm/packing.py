"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents (pieces) and attention cost (the sum of squared
lengths).  Pieces are placed longest first; among the open sequences that fit a piece under every
constraint, the one with the best score gets it:

``dot``   the largest weighted dot product of what the piece needs and what is left
``norm``  the smallest weighted norm of what would be left

A piece that fits nowhere opens a sequence.  Only documents longer than a sequence are cut, into
pieces of exactly a sequence's length and one shorter rest.

Pieces are dealt into groups of about ``group_pieces`` by a hash and each group is packed by one
task, which sees lengths and ids of pieces but no text; a group wastes a part of a few sequences.
Numbers of pieces, not of documents, make the groups, so one very long document spreads too.

Null texts count as empty and hold the end id alone.  Rows with the same id are told apart by a row
number and packed one by one.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .units import encoder, in_slices, spaced


class Bins:
    """Open sequences by what is left of their capacities, searched from the tightest in tokens."""

    def __init__(self, tokens: int, docs: int, attention: int, weights: tuple[float, float, float], score: str):
        self.cap = (float(tokens), float(docs), float(attention))
        self.tokens, self.docs, self.attention, self.score = tokens, docs, attention, score
        self.weights = weights
        self.open: dict[tuple[int, int, int], list[int]] = {}  # residual vector -> sequences
        self.by_tokens: list[set[tuple[int, int, int]]] = [set() for _ in range(tokens + 1)]
        self.mask = 0  # bit r: some open sequence has r tokens left
        self.n = 0

    def _add(self, left: tuple[int, int, int], bin: int) -> None:
        if left[0] > 0 and left[1] > 0 and left[2] > 0:
            self.open.setdefault(left, []).append(bin)
            self.by_tokens[left[0]].add(left)
            self.mask |= 1 << left[0]

    def _pick(self, need: tuple[int, int, int]) -> tuple[int, int, int] | None:
        size = need[0]
        best, found = None, None
        m, r = self.mask >> size, size
        while m:
            step = (m & -m).bit_length() - 1
            r += step
            # once the tokens alone would leave a larger norm than the best has, no later level wins
            if best is not None and self.score == "norm" and -self.weights[0] * ((r - size) / self.tokens) ** 2 < best:
                break
            for v in self.by_tokens[r]:
                if v[1] >= need[1] and v[2] >= need[2]:
                    s = (self._value(v, need), v)
                    if found is None or s > (best, found):
                        best, found = s
            m >>= step + 1
            r += 1
        return found

    def _value(self, v: tuple[int, int, int], need: tuple[int, int, int]) -> float:
        (wa, wb, wc), (ca, cb, cc) = self.weights, self.cap
        if self.score == "dot":
            return float(wa * v[0] * need[0] / ca**2 + wb * v[1] * need[1] / cb**2 + wc * v[2] * need[2] / cc**2)
        return -float(wa * ((v[0] - need[0]) / ca) ** 2 + wb * ((v[1] - need[1]) / cb) ** 2 + wc * ((v[2] - need[2]) / cc) ** 2)

    def place(self, size: int) -> int:
        need = (size, 1, size * size)
        v = self._pick(need)
        if v is None:
            v, bin = (self.tokens, self.docs, self.attention), self.n
            self.n += 1
        else:
            bins = self.open[v]
            bin = bins.pop()
            if not bins:
                del self.open[v]
                self.by_tokens[v[0]].discard(v)
                if not self.by_tokens[v[0]]:
                    self.mask &= ~(1 << v[0])
        self._add((v[0] - need[0], v[1] - need[1], v[2] - need[2]), bin)
        return bin


def pack_lengths(lengths: np.ndarray, tokens: int = 2048, docs: int | None = None, attention: int | None = None, weights=(1.0, 1e-4, 1e-4), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its offset there.  Ties in length go by position."""
    docs, attention = docs or tokens, attention or tokens * tokens
    if len(lengths) and (lengths.max() > tokens or int(lengths.max()) ** 2 > attention):
        raise ValueError("a piece does not fit an empty sequence")
    bins = Bins(tokens, docs, attention, weights, score)
    where = np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        where[i] = bins.place(int(lengths[i]))
    order = np.argsort(where, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.r_[True, where[order][1:] != where[order][:-1]] if len(order) else np.zeros(0, bool)
    begin = ends - lengths[order]
    offset = np.zeros(len(lengths), np.int64)
    offset[order] = begin - np.maximum.accumulate(np.where(first, begin, 0)) if len(order) else begin
    return where, offset


def pieces(df: DataFrame, tokenizer: str, end: int, tokens: int = 2048, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]) of every document."""
    keeps_space, id_type = spaced(tokenizer), df.schema[id].dataType.simpleString()
    slim = df.select(F.col(id).alias("id"), text_or_empty(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(tokenizer, keeps_space), TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in in_slices(texts):
                at, cols = [], ([], [], [], [], [], [])
                for k, raw in enumerate(enc.encode(texts[lo:hi], end)):
                    ids = np.frombuffer(raw, enc.dtype).astype("<u4")
                    for p, s in enumerate(range(0, len(ids), tokens)):
                        x = ids[s : s + tokens]
                        at.append(lo + k)
                        for c, v in zip(cols, (row + k, p, s, len(x), zlib.crc32(x.tobytes()), x.tobytes() if with_ids else None), strict=True):
                            c.append(v)
                row += hi - lo
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                out = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))]
                names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(out[: 6 + with_ids], names[: 6 + with_ids])

    return slim.mapInArrow(cut, f"doc_id {id_type}, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def pack(df: DataFrame, tokenizer: str, end: int, tokens: int = 2048, docs: int | None = None, attention: int | None = None, score: str = "norm", group_pieces: int = 100_000, with_ids: bool = False, **kw) -> DataFrame:
    """Every piece with sequence_id and offset."""
    cut = written(pieces(df, tokenizer, end, tokens, with_ids=with_ids, **kw))
    groups = max(1, -(-cut.count() // group_pieces))
    key = F.pmod(F.xxhash64("row", "piece", "start"), F.lit(groups)).cast("int")
    # a full piece is a sequence by itself, whatever its neighbours
    dealt = cut.withColumn("group", key).repartition(groups, "group").sortWithinPartitions("group", F.desc("length"), "doc_id", "row", "piece")

    def place(t: pa.Table) -> pa.Table:
        where, offset = pack_lengths(np.asarray(t["length"]), tokens, docs, attention, score=score)
        group = t["group"][0].as_py() if t.num_rows else 0
        t = t.drop_columns(["row", "group"])
        return t.append_column("sequence_id", pa.array((np.int64(group) << 40) + where)).append_column("offset", pa.array(offset))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != "row")
    return dealt.groupBy("group").applyInArrow(place, f"{fields}, sequence_id bigint, offset bigint")
