"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. Each text becomes its set of ``words``-word shingles (64-bit hashes); texts with the same set are
   one class.  Band and row counts are chosen so that a pair at the threshold shares a band with
   the target recall.
2. Classes that share a band's hash are candidates.  Instead of all pairs of a bucket, each member
   is tied to the bucket's least, and connected candidates form a cluster.
3. Only clusters ship shingle sets.  A cluster is dealt into blocks of bounded rows and shingles, of sets of about the
   same size; each pair of blocks whose sizes allow links is one task's work.  A class goes to the pairs of its block with those blocks that hold
   a class of one of its own buckets, so its copies are bounded by the blocks of its candidates: a long chain
   of sparse buckets costs each class a few copies, however long.  There, pairs that share a band are
   verified on their full sets; what leaves the task is a number of links for each class and a forest
   over what is linked, and no link is lost.
4. Linked classes are joined into groups.

Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are.  A text of fewer words than a shingle is one
shingle; a text without words (null or empty) has none, links to nothing and is a group by itself.
Rows are told apart by row numbers; equal rows are copies of each other.  A null id is carried, and
is not chosen to name a group that has other ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, text_or_empty, written
from .components import components
from .language_model import mixed
from .units import in_slices

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float, recall: float = 0.9999, most_hashes: int = 128) -> tuple[int, int]:
    """Bands, rows: the most rows (fewest chance candidates) that reach the recall at the threshold
    with so many hashes."""
    best = None
    for rows in range(1, most_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches the recall with so many hashes")
    return best


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    split = [t.split() for t in texts]
    ids: dict[bytes, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for ws in split for w in ws], np.int64)
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))[flat] if len(flat) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(max(len(keys) - words + 1, 0), np.uint64)
        for k in range(words):
            h = h * MULTIPLIER + keys[k : k + len(h)]
        h = mixed(h)
        out, at = [], 0
        for ws in split:
            n = len(ws)
            if n >= words:
                out.append(np.unique(h[at : at + n - words + 1]))
            elif n:
                short = np.uint64(n)
                for x in keys[at : at + n]:
                    short = short * MULTIPLIER + x
                out.append(mixed(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(texts, bands); every set must have members."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(bands * rows):
            x = ((flat * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
            out[:, k // rows] = out[:, k // rows] * MULTIPLIER + np.minimum.reduceat(x, starts)
        return mixed(out + np.arange(bands, dtype=np.uint64))


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def signatures(df: DataFrame, id: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """(rid, id, cid, n, bands) of every row; cid names the shingle set."""
    id_type = df.schema[id].dataType.simpleString()
    slim = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id).alias("id"), F.xxhash64(text_or_empty(text)).alias("text_hash"), text_or_empty(text).cast("binary").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            for lo, hi in in_slices(texts):
                sets = shingle_sets(texts[lo:hi], words)
                some = [i for i, s in enumerate(sets) if len(s)]
                marks: list = [[]] * len(sets)
                if some:
                    for i, m in zip(some, band_hashes([sets[i] for i in some], bands, rows).view(np.int64).tolist(), strict=True):
                        marks[i] = m
                cid = np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)
                head = [c.slice(lo, hi - lo) for c in b.columns[:3]]
                yield pa.RecordBatch.from_arrays([*head, pa.array(cid), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.list_(pa.int64()))], ["rid", "id", "text_hash", "cid", "n", "bands"])

    return slim.mapInArrow(sign, f"rid bigint, id {id_type}, text_hash bigint, cid bigint, n bigint, bands array<bigint>")


def intersections(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common members of a[i] and b[j] for each pair."""
    ra, ia = np.unique(i, return_inverse=True)
    rb, jb = np.unique(j, return_inverse=True)
    held = sum(len(a[x]) for x in ra) + sum(len(b[x]) for x in rb)
    if len(i) * 64 <= len(ra) * len(rb) or len(i) * max(held // (len(ra) + len(rb)), 1) <= 8 * held:
        out = np.zeros(len(i), np.int64)
        for k, (x, y) in enumerate(zip(i, j, strict=True)):
            s, t = (a[x], b[y]) if len(a[x]) <= len(b[y]) else (b[y], a[x])
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            out[k] = np.count_nonzero(t[at] == s)
        return out
    # many pairs of few sets: bits by shingle, counted some columns at a time
    sets = [*(a[x] for x in ra), *(b[x] for x in rb)]
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column, row = (np.cumsum(shared) - 1)[column[shared[column]]], row[shared[column]]
    total, width = int(shared.sum()), 1 << 14
    inter = np.zeros((len(ra), len(rb)), np.int32)
    by = np.argsort(column, kind="stable")
    column, row = column[by], row[by]
    for c in range(0, total, width):
        lo, hi = np.searchsorted(column, (c, c + width))
        bits = np.zeros((len(sets), width), bool)
        bits[row[lo:hi], column[lo:hi] - c] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        right = packed[len(ra) :]
        for k in range(len(ra)):
            inter[k] += np.bitwise_count(packed[k] & right).sum(1, dtype=np.int32)
    return inter[ia, jb].astype(np.int64)


def _linked(t: pa.Table, threshold: float) -> pa.Table:
    """The links between two blocks of a cluster (or within one): (a, b, links)."""
    cid = np.asarray(t["cid"])
    _, first = np.unique(cid, return_index=True)
    t = t.take(pa.array(np.sort(first)))
    cid, block, size, n = (np.asarray(t[k]) for k in ("cid", "block", "size", "n"))
    lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
    marks = np.array(t["bands"].to_pylist(), np.int64).reshape(len(cid), -1)
    sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
    left = np.flatnonzero(block == lo)
    right = left if lo == hi else np.flatnonzero(block == hi)
    near = np.zeros((len(left), len(right)), bool)
    for k in range(marks.shape[1]):
        near |= marks[left, k][:, None] == marks[right, k][None, :]
    small, large = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
    near &= small >= threshold * large - 1e-9
    if lo == hi:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    common = intersections([sets[x] for x in left], [sets[x] for x in right], i, j) if len(i) else np.zeros(0, np.int64)
    union = n[left[i]] + n[right[j]] - common
    ok = common >= threshold * union - 1e-9
    i, j = left[i[ok]], right[j[ok]]
    links = np.bincount(i, weights=size[j], minlength=len(cid)) + np.bincount(j, weights=size[i], minlength=len(cid))
    root = np.arange(len(cid))
    while len(i):
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(links)
    return pa.table({"a": pa.array(cid[some]), "b": pa.array(cid[root[some]]), "links": pa.array(links[some].astype(np.int64))})


#: A block's number holds its size class above so many bits.
CLASS_BITS = 24


def _meetings(members: DataFrame, reach: int, scratch: Scratch) -> DataFrame:
    """(cid, others): of each class of a cluster with several blocks, the blocks that hold its candidates.  Size
    classes more than ``reach`` apart hold none."""
    marks = scratch.written(members.where("split").select("cid", "block", F.posexplode("bands").alias("band", "hash")))
    present = scratch.written(marks.select("band", "hash", F.col("block").alias("other")).distinct())
    size_class = lambda c: F.shiftright(c, CLASS_BITS)
    met = marks.join(present, ["band", "hash"]).where(F.abs(size_class(F.col("block")) - size_class(F.col("other"))) <= reach)
    return met.groupBy("cid").agg(F.collect_set("other").alias("others"))


def _blocked(members: DataFrame, threshold: float, block_rows: int, block_shingles: int, scratch: Scratch) -> DataFrame:
    """members with ``split``, whether their cluster has several blocks, and ``block``.  A large cluster is cut by the
    size of shingle sets first, in classes a quarter of the threshold's ratio wide, so that sets too unlike in size to be
    linked do not meet; then by a hash."""
    members = scratch.written(members.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / (-math.log(threshold) / 4)) if threshold < 1 else F.col("n")))
    most = lambda rows, shingles: F.expr(f"greatest(({rows} - 1) div {block_rows}, ({shingles} - 1) div {block_shingles}) + 1")
    parts = scratch.written(members.groupBy("component", "size_class").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")))
    whole = parts.groupBy("component").agg(F.sum("rows").alias("all_rows"), F.sum("shingles").alias("all_shingles"))
    cut = scratch.written(parts.join(whole, "component").select("component", "size_class", (most("all_rows", "all_shingles") > 1).alias("split"), most("rows", "shingles").alias("parts")))
    block = F.shiftleft(F.col("size_class").cast("bigint"), CLASS_BITS) + F.pmod(F.xxhash64("cid"), F.col("parts"))
    return members.join(cut, ["component", "size_class"]).withColumn("block", F.when(F.col("split"), block).otherwise(F.lit(0).cast("bigint"))).drop("size_class", "parts")


def near_groups(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.9999, block_rows: int = 500, block_shingles: int = 3_000_000) -> tuple[DataFrame, DataFrame]:
    """The signatures of df's rows, and of every class with members: cid, size, first (id,
    text_hash and rid of the row that names it), links and group (the first of its group)."""
    bands, rows = banding(threshold, recall)
    signed, scratch = written(signatures(df, id, text, words, bands, rows)), Scratch(df.sparkSession)
    id_type = df.schema[id].dataType.simpleString()
    named = F.struct(F.col("id").isNull().alias("null"), "id", "text_hash", "rid")
    classes = scratch.written(signed.where("n > 0").groupBy("cid").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("n"), F.min(named).alias("first"), F.first("bands").alias("bands")))

    marks = classes.select("cid", F.posexplode("bands").alias("band", "hash"))
    buckets = marks.groupBy("band", "hash").agg(F.min("cid").alias("root"), F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1").drop("in_bucket")
    buckets = scratch.written(buckets)  # as a table, so that Spark can split a bucket with very many rows in the join
    tied = marks.join(buckets, ["band", "hash"]).where("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v")).distinct()
    clusters = components(tied)

    members = classes.join(clusters.withColumnRenamed("vertex", "cid"), "cid")
    members = scratch.written(_blocked(members, threshold, block_rows, block_shingles, scratch).select("component", "split", "block", "cid", "size", "bands", "first"))
    # sizes in one ratio of the threshold lie in at most five classes; one more, as logarithms are rounded
    members = members.join(_meetings(members, 5, scratch), "cid", "left").withColumn("others", F.coalesce("others", F.array(F.lit(0).cast("bigint")))).drop("split")
    wanted = scratch.written(members.select("*", F.col("first.id").alias("want_id"), F.col("first.text_hash").alias("want_hash")).drop("first"))
    texts = df.select(F.col(id).alias("id"), F.xxhash64(text_or_empty(text)).alias("text_hash"), text_or_empty(text).cast("binary").alias("text"))
    found = texts.join(wanted, texts["id"].eqNullSafe(wanted["want_id"]) & (texts["text_hash"] == wanted["want_hash"]))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b["text"].to_pylist()
            for lo, hi in in_slices(raw):
                sets = shingle_sets(raw[lo:hi], words)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(part[k] for k in ("component", "block", "others", "cid", "size", "bands")), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["component", "block", "others", "cid", "size", "bands", "n", "shingles"],
                )

    full = found.select("component", "block", "others", "cid", "size", "bands", "text").mapInArrow(resolve, "component bigint, block bigint, others array<bigint>, cid bigint, size bigint, bands array<bigint>, n bigint, shingles binary")
    met = F.transform("others", lambda p: F.struct(F.least(F.col("block"), p).alias("lo"), F.greatest(F.col("block"), p).alias("hi")))
    dealt = full.withColumn("meet", F.explode(met)).select("component", "meet.lo", "meet.hi", "block", "cid", "size", "n", "bands", "shingles")
    linked = scratch.written(dealt.groupBy("component", "lo", "hi").applyInArrow(lambda t: _linked(t, threshold), "a bigint, b bigint, links bigint"))

    links = linked.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cid")
    groups = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("vertex", "cid")
    known = classes.select("cid", "size", "first").join(links, "cid", "left").join(groups, "cid", "left")
    known = known.select("cid", "size", "first", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "cid").alias("component"))
    known = scratch.written(known)
    names = scratch.written(known.groupBy("component").agg(F.min("first").alias("group")))
    grouped = written(known.join(names, "component").drop("component"))
    scratch.clear()
    return signed, grouped


def near_report(df: DataFrame, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row for each row of df: doc_id, class_id (the least id of its group of linked texts),
    copy_id (the least id with the same shingle set), n_links (other rows at the threshold or
    over it, copies included) and n_shingles."""
    signed, classes = near_groups(df, id, text, **kw)
    out = signed.select("id", "cid", "n").join(classes.withColumnRenamed("size", "copies"), "cid", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n") > 0, F.col("group.id")).otherwise(F.col("id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id")).alias("copy_id"),
        F.when(F.col("n") > 0, F.col("links")).otherwise(0).cast("bigint").alias("n_links"),
        F.col("n").alias("n_shingles"),
    )


def near_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """df's rows without those that have a near copy with a lesser id in their group.  Of rows equal in id
    and text any one stays."""
    signed, classes = near_groups(df, id, text, **kw)
    keepers = classes.where(F.col("group") == F.col("first")).select(F.col("group.id").alias("__id"), F.col("group.text_hash").alias("__hash"))
    keepers = keepers.union(signed.where("n = 0").select("id", "text_hash").distinct())
    hashed = fresh(df.columns, "text_hash")
    keyed = df.withColumn(hashed, F.xxhash64(text_or_empty(text)))
    kept = keyed.join(keepers, keyed[id].eqNullSafe(keepers["__id"]) & (keyed[hashed] == keepers["__hash"]), "left_semi")
    repeated = written(signed.where("n > 0").groupBy("id", "text_hash").count().where("count > 1").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")))
    if repeated.isEmpty():
        return kept.drop(hashed)
    # rows equal in id and text are one
    again = kept[id].eqNullSafe(repeated["__id"]) & (kept[hashed] == repeated["__hash"])
    return kept.join(repeated, again, "left_anti").union(kept.join(repeated, again, "left_semi").dropDuplicates([id, hashed])).drop(hashed)
