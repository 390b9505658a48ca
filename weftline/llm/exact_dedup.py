"""Exact dedup against a minimal perfect hash of the digests already known.

History: the distinct SHA-256 digests of earlier rows.  They are dealt by a prefix of the digest
into shards of bounded size; each shard gets a minimal perfect hash (a cascade of collision-free
bit levels) whose slots hold the full digest, the locator of the winning row and the number of
copies.  Incoming rows are first grouped by digest (partial sums before the shuffle, so a group of
copies of any size is one row a task), then every distinct digest is looked up in its shard and
compared with the slot's 32 bytes.  Members merge with their slot; nonmembers form groups of their
own.  A perfect hash maps strangers somewhere too, so the comparison decides.

The row with the largest id wins; among rows with that same id one wins.  A null id is the
smallest.  A null text counts as empty; all empty texts are equal.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_or_empty, written

GAMMA = 2.0
LEVELS = 48


def _keys(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each 32-byte digest; the first four bytes chose the shard."""
    words = digests.view("<u8").reshape(-1, 4)
    return words[:, 1], words[:, 2] | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a + b * np.uint64(2 * level + 1)) ^ ((a ^ b) >> np.uint64(29))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def mph_build(digests: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """digests: (n, 32) distinct rows of uint8.  The levels' bitmaps, and the slot of each row."""
    n = len(digests)
    slot, left, base, levels = np.full(n, -1, np.int64), np.arange(n), 0, []
    for level in range(LEVELS):
        if not len(left):
            break
        a, b = _keys(digests[left])
        size = max(64, int(GAMMA * len(left)))
        at = _place(a, b, level, size)
        alone = np.bincount(at, minlength=size) == 1
        ok = alone[at]
        slot[left[ok]] = base + np.cumsum(alone)[at[ok]] - 1
        levels.append(size.to_bytes(8, "little") + np.packbits(alone).tobytes())
        base, left = base + int(ok.sum()), left[~ok]
    slot[left] = base + np.arange(len(left))  # after the last level: found by comparing, see mph_slots
    return levels, slot


def mph_slots(levels: list[bytes], digests: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """For each digest the slot that holds the same 32 bytes, or -1."""
    n, base = len(digests), 0
    slot, left = np.full(n, -1, np.int64), np.arange(n)
    for level, raw in enumerate(levels):
        size = int.from_bytes(raw[:8], "little")
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=size).astype(bool)
        at = _place(*_keys(digests[left]), level, size)
        hit = bits[at]
        slot[left[hit]] = base + np.cumsum(bits)[at[hit]] - 1
        base, left = base + int(bits.sum()), left[~hit]
    rest = {bytes(x): base + i for i, x in enumerate(stored[base:])}
    for i in left:
        slot[i] = rest.get(bytes(digests[i]), -1)
    there = slot >= 0
    there[there] = (stored[slot[there]] == digests[there]).all(axis=1)
    return np.where(there, slot, -1)


def _as_digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rid, digest): rid numbers the rows, so that rows equal in everything stay apart.
    Written once, because the numbers must not change between reads."""
    digest = F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))
    return written(df.select(F.col(id).alias("id"), F.monotonically_increasing_id().alias("rid"), digest.alias("digest")))


def _grouped(prints: DataFrame, shards: int) -> DataFrame:
    g = prints.groupBy("digest").agg(F.max(F.struct("id", "rid")).alias("win"), F.count(F.lit(1)).alias("n"))
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint"), F.lit(shards)).cast("int")
    return g.select(shard.alias("shard"), "digest", F.col("win.id").alias("id"), F.col("win.rid").alias("rid"), "n")


def build_index(prints: DataFrame, shards: int, path: str | None = None) -> DataFrame:
    """One row a shard: levels array<binary>, and by slot the digests (32 bytes each) and the
    locators.  At about 100,000 digests a shard a row takes about 6 MB."""
    id_type = prints.schema["id"].dataType.simpleString()

    def build(t: pa.Table) -> pa.Table:
        digests = _as_digests(t["digest"])
        levels, slot = mph_build(digests)
        order = pa.array(np.argsort(slot))
        return pa.table(
            {
                "shard": t["shard"].slice(0, 1).cast(pa.int32()),
                "levels": pa.array([levels], pa.list_(pa.binary())),
                "digests": pa.array([digests[order.to_numpy()].tobytes()], pa.binary()),
                **{k: pa.array([t[k].take(order).to_pylist()], pa.list_(t[k].type)) for k in ("id", "rid", "n")},
            }
        )

    schema = f"shard int, levels array<binary>, digests binary, id array<{id_type}>, rid array<bigint>, n array<bigint>"
    return written(_grouped(prints, shards).groupBy("shard").applyInArrow(build, schema), path)


def merge(index: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, keep_rid, group_size) of every digest in the index or among the incoming
    rows.  shards must be the number that the index was built with."""
    id_type = incoming.schema["id"].dataType.simpleString()
    kinds = {"digest": pa.binary()}

    def look_up(known: pa.Table, new: pa.Table) -> pa.Table:
        t = known.num_rows > 0
        stored = np.frombuffer(known["digests"][0].as_py(), np.uint8).reshape(-1, 32) if t else np.zeros((0, 32), np.uint8)
        digests = _as_digests(new["digest"])
        slot = mph_slots(known["levels"][0].as_py() if t else [], digests, stored)
        # a row for each slot, with the incoming group that equals it, then the nonmembers
        back = np.full(len(stored), -1, np.int64)
        back[slot[slot >= 0]] = np.flatnonzero(slot >= 0)
        strangers = np.flatnonzero(slot < 0)
        source = np.concatenate([back, strangers])
        take = pa.array(source, pa.int64(), mask=source < 0)
        olds = pa.array(np.arange(len(source)), pa.int64(), mask=np.arange(len(source)) >= len(stored))
        old = {k: (known[k].combine_chunks()[0].values if t else new[k].slice(0, 0).combine_chunks()) for k in ("id", "rid", "n")}
        every = [bytes(x) for x in stored] + [bytes(digests[i]) for i in strangers]
        cols = {"digest": pa.array(every, pa.binary())}
        for k in ("id", "rid", "n"):
            cols[f"old_{k}"] = old[k].take(olds)
            cols[f"new_{k}"] = new[k].combine_chunks().take(take) if new.num_rows else pa.nulls(len(every), new[k].type)
        return pa.table(cols)

    schema = f"digest binary, old_id {id_type}, new_id {id_type}, old_rid bigint, new_rid bigint, old_n bigint, new_n bigint"
    both = index.groupBy("shard").cogroup(_grouped(incoming, shards).groupBy("shard")).applyInArrow(look_up, schema)
    old = F.when(F.col("old_rid").isNotNull(), F.struct(F.col("old_id").alias("id"), F.col("old_rid").alias("rid")))
    new = F.when(F.col("new_rid").isNotNull(), F.struct(F.col("new_id").alias("id"), F.col("new_rid").alias("rid")))
    win = F.when(old.isNull(), new).when(new.isNull(), old).when(new > old, new).otherwise(old)
    size = F.coalesce("old_n", F.lit(0)) + F.coalesce("new_n", F.lit(0))
    return both.select("digest", win.alias("win"), size.alias("group_size")).select("digest", F.col("win.id").alias("keep_id"), F.col("win.rid").alias("keep_rid"), "group_size")


def shard_count(rows: int, shard_rows: int = 100_000) -> int:
    """So many that a shard holds about shard_rows digests at most; digests are uniform."""
    return max(1, -(-rows // shard_rows))


def group_copies(df: DataFrame, id: str = "doc_id", text: str = "text", shard_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of df and the winner of each digest.  Half of the ids, by a hash that works for ids
    of any type, are the history that the index is built from; the rest and rows without id come in
    against it."""
    prints = fingerprints(df, id, text)
    shards = shard_count(prints.count(), shard_rows)
    early = F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    index = build_index(prints.where(early), shards)
    return prints, written(merge(index, prints.where(~early), shards))


def dedup_report(df: DataFrame, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256."""
    prints, winners = group_copies(df, id, text, **kw)
    return prints.join(winners, "digest", "left").select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(df: DataFrame, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The rows of df that win, with df's columns.  Of rows equal in id and text any one stays."""
    prints, winners = group_copies(df, id, text, **kw)
    winners = winners.select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__id"))
    tied = prints.groupBy("digest", "id").count().where("count > 1").select(F.col("digest").alias("__digest"), F.col("id").alias("__id"))
    digest = fresh(df.columns, "digest")
    keyed = df.withColumn(digest, F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256)))

    def rows(of: DataFrame) -> DataFrame:
        return keyed.join(of, (keyed[digest] == of["__digest"]) & keyed[id].eqNullSafe(of["__id"]), "left_semi")

    if tied.isEmpty():
        return rows(winners).drop(digest)
    # rows that share both the text and the id: one of them stays
    both = (winners["__digest"] == tied["__digest"]) & winners["__id"].eqNullSafe(tied["__id"])
    once = rows(winners.join(tied, both, "left_semi")).dropDuplicates([digest, id])
    return rows(winners.join(tied, both, "left_anti")).union(once).drop(digest)
