"""Token ids in files: canonical length-limited Huffman codes.

A file set is a folder with

``code``    one row an id that occurs: id, n (times in the corpus), length (bits of its code)
``blocks``  one row a block: part, seq (ascending together = ascending ids), first_start (ids of all
            documents before the block), doc_ids, lengths, n_ids, checkpoint_ids (k), checkpoints (the
            bit offset of every k-th id), payload (the bits)

The code is built from the counts of all ids, with no code longer than ``max_bits``
(package-merge), and is canonical: lengths alone fix it, shorter codes first, then by id.  Blocks
hold whole documents and about ``block_ids`` ids, and each can be read by itself.  Within a block
the checkpoints let decoding start anywhere, so a reader decodes all stretches between them side by
side with one table lookup an id.

Documents come in ascending id order, nulls first; documents with the same id follow the crc32 of
their texts.  A null text counts as empty and holds the end id alone.  An empty table gives empty
files.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shared_folder, text_or_empty
from .units import encoder, sized_slices, spaced

CHECKPOINT_IDS = 256
#: Of text that is encoded together; the more, the fewer distinct units a unit.
SLICE_BYTES = 8 << 20


def code_lengths(counts: np.ndarray, max_bits: int = 16) -> np.ndarray:
    """Bits for each symbol with a count over 0 (package-merge: the best code within max_bits)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits or max_bits > 31:
        raise ValueError("a code needs from log2(symbols) to 31 bits")
    order = used[np.lexsort((used, counts[used]))]
    w = counts[order].astype(np.int64)
    merged, leaf = w, [np.ones(len(w), bool)]
    for _ in range(max_bits - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([w, pairs])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        leaf.append(by < len(w))
    take, bits = 2 * len(w) - 2, np.zeros(len(w), np.int64)
    for is_leaf in reversed(leaf):
        n = int(is_leaf[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    out[order] = bits
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    ls = lengths[order].astype(np.int64)
    step = np.zeros(len(order), np.uint64)
    for length in np.unique(ls):
        code <<= int(length) - last
        here = ls == length
        n = int(here.sum())
        step[here] = np.arange(code, code + n, dtype=np.uint64)
        code, last = code + n, int(length)
    codes[order] = step
    return codes


@lru_cache(maxsize=2)
def _tables(lengths: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """lengths, codes at the left of 64 bits, and for every window of as many bits as the longest code: symbol << 5 | length."""
    ls = np.frombuffer(lengths, np.uint8)
    codes, most = canonical_codes(ls), int(ls.max(initial=1))
    order = np.lexsort((np.arange(len(ls)), ls))
    order = order[ls[order] > 0]
    span = np.int64(1) << (most - ls[order].astype(np.int64))
    table = np.full(1 << most, 1, np.uint32)
    table[: int(span.sum())] = np.repeat(order.astype(np.uint32) << np.uint32(5) | ls[order], span)
    left = codes << (-ls.astype(np.int64) & 63).astype(np.uint64)  # ids without a code have 0
    return ls.astype(np.int64), left, table, most


def encode_block(ids: np.ndarray, lengths: bytes) -> tuple[bytes, np.ndarray]:
    """The payload and the bit offset of every CHECKPOINT_IDS-th id."""
    ls, left, *_ = _tables(lengths)
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    n = ls[ids]
    ends = np.cumsum(n)
    at = ends - n
    word, bit = at >> 5, at & 31
    shifted = left[ids] >> bit.view(np.uint64)
    # codes are shorter than a word: one begins in every word, and one at most reaches into the next
    out = np.zeros(int(ends[-1]) // 32 + 2, np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[first]] = np.bitwise_or.reduceat(shifted >> np.uint64(32), first)
    over = np.flatnonzero(bit + n > 32)
    out[word[over] + 1] |= shifted[over] & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes(), at[::CHECKPOINT_IDS]


def decode_blocks(payloads: list[bytes], checkpoints: list[np.ndarray], n_ids: list[int], lengths: bytes, every: int = CHECKPOINT_IDS) -> list[np.ndarray]:
    """The ids of each block; all stretches between checkpoints advance together.  Stretches that
    are shorter than the others read on into bits that follow, and what they find there is cut off."""
    *_, table, most = _tables(lengths)
    raw = np.frombuffer(b"".join(payloads) + bytes(every * most // 8 + 16), ">u4").astype(np.uint64)
    window = raw[:-1] << np.uint64(32) | raw[1:]
    start = np.cumsum([0, *(len(p) * 8 for p in payloads)])[:-1]
    at = np.concatenate([np.asarray(c, np.int64) + s for c, s in zip(checkpoints, start, strict=True)] or [np.zeros(0, np.int64)]).astype(np.uint64)
    lanes = np.cumsum([0, *(len(c) for c in checkpoints)])
    out = np.empty((every, len(at)), np.uint32)
    room, mask = np.uint64(64 - most), np.uint64((1 << most) - 1)
    for k in range(every):
        bits = window[at >> np.uint64(5)] >> (room - (at & np.uint64(31)))
        found = table[bits & mask]
        out[k] = found >> np.uint32(5)
        at += found & np.uint32(31)
    return [out[:, lanes[i] : lanes[i + 1]].T.reshape(-1)[:n] for i, n in enumerate(n_ids)]


def _chunks(path: str, keeps_space: bool, end: int, block_ids: int, vocab: int):
    """Documents in order become chunks of whole documents, after which comes a row without ``seq`` that
    has the partition's number of ids and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keeps_space)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs, ids, held = [], [], 0
        width, counts = enc.dtype.itemsize, np.zeros(vocab, np.int64)

        def row(seq, docs, lens, ids, used, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([docs], pa.list_(doc_type)), pa.array([lens], pa.list_(pa.int64())), pa.array([ids], pa.binary()), pa.array([used], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int64()))],
                ["part", "seq", "before", "doc_ids", "lengths", "ids", "used", "n"],
            )

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, docs, ids, held, counts
            lens, raw = [len(x) // width for x in ids], b"".join(ids)
            counts += np.bincount(np.frombuffer(raw, enc.dtype), minlength=vocab)
            out = row(seq, docs, lens, raw, None, None)
            seq, before, docs, ids, held = seq + 1, before + sum(lens), [], [], 0
            return out

        for b in batches:
            doc_type = b.column(0).type
            for lo, hi in sized_slices(b.column(1), SLICE_BYTES):
                names, texts = (b.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 1))
                for name, x in zip(names, enc.encode(texts, end), strict=True):
                    docs.append(name)
                    ids.append(x)
                    held += len(x) // width
                    if held >= block_ids:
                        yield flush()
            pa.default_memory_pool().release_unused()
        if docs:
            yield flush()
        if seq:
            used = np.flatnonzero(counts)
            yield row(None, None, None, None, used.tolist(), counts[used].tolist())

    return run


def write_ids(df: DataFrame, out: str, tokenizer: str, end: int, id: str = "doc_id", text: str = "text", block_ids: int = 1 << 16, max_bits: int = 16) -> str:
    """Encode every whole text, append ``end``, and write the file set ``out``."""
    spark = df.sparkSession
    keeps_space, vocab, id_type = spaced(tokenizer), _vocab(tokenizer, end), df.schema[id].dataType.simpleString()
    slim = df.select(F.col(id).alias("id"), text_or_empty(text).alias("text"))
    # ranges of ids; the texts' checksum orders rows that share an id, and a row number spreads rows that share both
    ties = slim.withColumns({"tie": F.crc32("text"), "row": F.monotonically_increasing_id()})
    ranged = ties.repartitionByRange("id", "tie", "row").sortWithinPartitions("id", "tie", "row").select("id", "text")
    schema = f"part int, seq bigint, before bigint, doc_ids array<{id_type}>, lengths array<bigint>, ids binary, used array<int>, n array<bigint>"
    scratch = Scratch(spark)
    staged = scratch.written(ranged.mapInArrow(_chunks(tokenizer, keeps_space, end, block_ids, vocab), schema))
    dtype = "<u2" if vocab <= 1 << 16 else "<u4"

    # both tables that the driver sees are bounded: by the vocabulary, and by the number of partitions
    counts = np.zeros(vocab, np.int64)
    totals = staged.where("seq IS NULL")
    for i, n in totals.select(F.inline(F.arrays_zip("used", "n"))).groupBy("used").agg(F.sum("n")).collect():
        counts[i] = n
    parts = sorted(totals.select("part", "before").collect())
    starts = dict(zip([p for p, _ in parts], np.cumsum([0, *(n for _, n in parts)]).tolist(), strict=False))
    used = np.flatnonzero(counts)
    lengths = code_lengths(counts, max(max_bits, len(used).bit_length())).tobytes()
    spark.createDataFrame([(int(i), int(counts[i]), lengths[i]) for i in used], "id int, n bigint, length int").coalesce(1).write.mode("overwrite").parquet(f"{out}/code")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                part, before, raw = row["part"][0].as_py(), row["before"][0].as_py(), row["ids"][0].as_py()
                ids = np.frombuffer(raw, dtype)
                payload, marks = encode_block(ids, lengths)
                yield pa.RecordBatch.from_arrays(
                    [row["part"], row["seq"], pa.array([starts[part] + before], pa.int64()), row["doc_ids"], row["lengths"], pa.array([len(ids)], pa.int64()), pa.array([CHECKPOINT_IDS], pa.int32()), pa.array([marks.tolist()], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                    ["part", "seq", "first_start", "doc_ids", "lengths", "n_ids", "checkpoint_ids", "checkpoints", "payload"],
                )

    schema = f"part int, seq bigint, first_start bigint, doc_ids array<{id_type}>, lengths array<bigint>, n_ids bigint, checkpoint_ids int, checkpoints array<bigint>, payload binary"
    chunks = staged.where("seq IS NOT NULL").select("part", "seq", "before", "doc_ids", "lengths", "ids")
    chunks.mapInArrow(pack, schema).write.mode("overwrite").parquet(f"{out}/blocks")
    scratch.clear()
    return out


def _vocab(path: str, end: int) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size(), end + 1)


def read_ids(spark: SparkSession, path: str, blocks_at_once: int = 16) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in a file set; ids: unsigned 32-bit,
    little-endian."""
    code = spark.read.parquet(f"{path}/code").select("id", "length").collect()  # as many rows as the vocabulary at most
    ls = np.zeros(max((r[0] for r in code), default=0) + 1, np.uint8)
    for i, n in code:
        ls[i] = n
    lengths = ls.tobytes()
    blocks = spark.read.parquet(f"{path}/blocks").select("first_start", "doc_ids", "lengths", "n_ids", "checkpoint_ids", "checkpoints", "payload")
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, blocks_at_once):
                b = whole.slice(lo, blocks_at_once)
                every = b["checkpoint_ids"][0].as_py()
                marks = [np.asarray(x.values) for x in b["checkpoints"]]
                got = decode_blocks(b["payload"].to_pylist(), marks, b["n_ids"].to_pylist(), lengths, every)
                for i, ids in enumerate(got):
                    n = np.asarray(b["lengths"][i].values)
                    ends = np.cumsum(n)
                    start = ends - n
                    raw = ids.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [b["doc_ids"][i].values, pa.array(start + b["first_start"][i].as_py(), pa.int64()), pa.array(n, pa.int64()), pa.array([raw[4 * s : 4 * e] for s, e in zip(start, ends, strict=True)], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return blocks.mapInArrow(unpack, f"doc_id {id_type}, start bigint, n_tokens bigint, ids binary")


def round_trip(df: DataFrame, tokenizer: str, end: int, **kw) -> DataFrame:
    """Write df's ids into the shared folder and read them back."""
    return read_ids(df.sparkSession, write_ids(df, shared_folder(df.sparkSession), tokenizer, end, **kw))
