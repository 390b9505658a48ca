"""Maximal periodic runs of words in each text, by suffix array, LCP and longest previous factors.

A run is a stretch [s, t) of words with smallest period q and t - s >= max(least, 2q) that no neighbouring
word extends with that period.  Texts are taken together in slices of bounded size:

1. Words get numbers.  A run holds a factor of h = ceil(least / 2) words twice (q apart they agree on
   t - s - q >= h words), so texts whose factors of h words all differ have no run and leave here.
2. Prefix doubling ranks the other texts' suffixes, the texts in order: after round k a rank stands for the
   next 2^k words.  The last ranks are the suffix array; the ranks of all rounds, compared from the longest
   down, tell how far two places agree, to the right and to the left, which gives the LCP of neighbours.
3. A linked list over the suffix array, from which places are taken away from the last to the first, leaves
   of each place's neighbours those before it: the longest previous factor (LPF) and where it stands.
4. LPF gives the LZ factors of each text: each is the longest that begins before it too, or one new word.
5. A run that touches a border between factors has a period of at most the length of the factors beside
   one such border b, and one whole period on one side of b.  For each such period p the words p apart are
   extended from b to both sides (Main); there are at most two such pairs a word.
6. Any other run lies inside a factor and is a copy of one that begins earlier in the text.  Runs are kept
   in buckets by their start; those inside a factor's earlier place are copied, from left to right.

The same stretch is also found by multiples of its period; the least is kept.  Steps 2 and 5 are vectors, 3, 4 and
6 linear scans.  Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are.  A null or empty text has no word
and no run.  Rows are taken one by one, repeated ones too; a text of any length stays whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .units import in_slices

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def repeating(flat: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The texts (ascending) that hold a factor of ``size`` words twice, and few others.  n: words of each."""
    if len(flat) < size:
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    at = np.arange(len(flat) - size + 1)
    doc = np.repeat(np.arange(len(n)), n)
    at = at[ends[doc[at]] - at >= size]
    h = np.zeros(len(flat) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h + flat[k : k + len(h)].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    key = np.sort(doc[at].astype(np.uint64) << np.uint64(40) | h[at] >> np.uint64(24))
    return np.unique(key[1:][key[1:] == key[:-1]] >> np.uint64(40)).astype(np.int64)


class Suffixes:
    """The ranks of the suffixes of some texts laid one after the other; none goes on into the next text."""

    def __init__(self, flat: np.ndarray, n: np.ndarray):
        size = len(flat)
        self.begin, self.end = np.repeat(np.cumsum(n) - n, n), np.repeat(np.cumsum(n), n)
        doc = np.repeat(np.arange(len(n)), n)
        # a rank is the number of suffixes that are less; texts come in order
        key = doc * (int(flat.max(initial=0)) + 1) + flat
        by = np.argsort(key, kind="stable")
        rank, alone = np.zeros(size, np.int64), np.zeros(size, bool)
        self.ranks, order, old, second, width = [], by, np.zeros(size, np.int64), key[by], 1
        while True:
            # order: places whose rank others share, by rank and what follows; each group is ranked anew
            group = np.r_[True, old[1:] != old[:-1]][: len(order)]
            new = group | np.r_[True, second[1:] != second[:-1]][: len(order)]
            here = np.arange(len(order))
            first = np.maximum.accumulate(np.where(group, here, 0))
            rank = rank.copy()
            rank[order] = old + np.maximum.accumulate(np.where(new, here, 0)) - first
            alone[order] = new & np.r_[new[1:], True]
            self.ranks.append(rank)
            order = order[~alone[order]]
            if not len(order):
                break
            after = order + width
            second = np.where(after < self.end[order], rank[np.minimum(after, size - 1)] + 1, 0)
            old, width = rank[order], 2 * width
            by = np.lexsort((second, old))
            order, old, second = order[by], old[by], second[by]

    def array(self) -> np.ndarray:
        out = np.zeros(len(self.ranks[-1]), np.int64)
        out[self.ranks[-1]] = np.arange(len(out))
        return out

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on are those from j on; i and j differ and are of one text, or its end."""
        end, done = self.end[np.minimum(np.minimum(i, j), len(self.end) - 1)], np.zeros(len(i), np.int64)
        last = len(self.end) - 1
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, a, b = self.ranks[k], i + done, j + done
            ok = np.maximum(a, b) + (1 << k) <= end
            done += (ok & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])).astype(np.int64) << k
        return done

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i are those before j."""
        last = len(self.end) - 1
        begin, done = self.begin[np.minimum(np.minimum(i, j), last)], np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, a, b = self.ranks[k], i - done - (1 << k), j - done - (1 << k)
            ok = np.minimum(a, b) >= begin
            done += (ok & (rank[np.clip(a, 0, last)] == rank[np.clip(b, 0, last)])).astype(np.int64) << k
        return done


def previous_factors(suffixes: Suffixes) -> tuple[list[int], list[int]]:
    """For each place the length of the longest factor that begins there and at an earlier one, and that one."""
    array, rank = suffixes.array(), suffixes.ranks[-1].tolist()
    size = len(rank)
    same = suffixes.begin[array[1:]] == suffixes.begin[array[:-1]]
    common = np.zeros(size + 1, np.int64)
    common[1:size][same] = suffixes.right(array[:-1][same], array[1:][same])
    lcp, place = common.tolist(), array.tolist()  # lcp[r]: with the suffix before it
    back, on = list(range(-1, size - 1)), list(range(1, size + 1))
    length, source = [0] * size, [0] * size
    for i in range(size - 1, -1, -1):
        r = rank[i]
        before, after, a, b = back[r], on[r], lcp[r], lcp[on[r]]
        if a >= b:
            length[i], source[i] = a, place[before] if a else 0
        else:
            length[i], source[i], lcp[after] = b, place[after], a
        if before >= 0:
            on[before] = after
        if after < size:
            back[after] = before
    return length, source


def factors(length: list[int], n: list[int]) -> list[int]:
    """Where the LZ factors of each text begin; a text's end is the next one's beginning."""
    out, at, end = [], 0, 0
    for k in n:
        end += k
        while at < end:
            out.append(at)
            at += length[at] or 1
    return out


def border_runs(suffixes: Suffixes, starts: list[int], least: int) -> dict[tuple[int, int], int]:
    """(start, end) -> period of the runs that touch a border of factors."""
    size = len(suffixes.end)
    begin = np.array(starts, np.int64)
    end = np.r_[begin[1:], size]
    first = suffixes.begin[begin] == begin  # of its text
    own, before = end - begin, np.where(first, 0, begin - np.r_[0, begin[:-1]])
    last = end == suffixes.end[begin]
    # borders: the beginning of each factor, and the end of each text's last one
    b = np.r_[begin, end[last]]
    most = np.r_[own + before, own[last]]
    low = np.r_[suffixes.begin[begin], suffixes.begin[begin[last]]]
    high = np.r_[suffixes.end[begin], suffixes.end[begin[last]]]
    word, found = suffixes.ranks[0], {}
    at = np.repeat(np.arange(len(b)), most)
    p = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1
    b, low, high = b[at], low[at], high[at]
    for x, y in ((b - p, b), (b, b + p)):  # the two words p apart that come next at the border
        inside = (x >= low) & (y <= high)
        i, j, lo, hi, q = (v[inside] for v in (x, y, low, high, p))
        # most pairs agree on neither side
        near = (j < hi) & (word[i] == word[np.minimum(j, size - 1)]) | (i > lo) & (word[np.maximum(i - 1, 0)] == word[np.maximum(j - 1, 0)])
        i, j, q, hi = i[near], j[near], q[near], hi[near]
        on = np.zeros(len(i), np.int64)
        some = j < hi
        on[some] = suffixes.right(i[some], j[some])
        back = suffixes.left(i, j)
        ok = (on + back >= q) & (on + back + q >= least)
        for s, t, period in zip((i - back)[ok].tolist(), (j + on)[ok].tolist(), q[ok].tolist(), strict=True):
            found[s, t] = min(period, found.get((s, t), period))
    return found


def all_runs(flat: np.ndarray, n: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """(start, end) -> period of every run of at least ``least`` words of texts laid one after the other."""
    suffixes = Suffixes(flat, n)
    length, source = previous_factors(suffixes)
    starts = factors(length, n.tolist())
    found = border_runs(suffixes, starts, least)
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (s, t), q in found.items():
        buckets[s].append((t, q))
    for begin in starts:
        if length[begin] > least + 1:  # a run inside it has a word on either side
            end, shift = begin + length[begin], begin - source[begin]
            for s in range(begin + 1, end - least):
                for t, q in buckets.get(s - shift, ()):
                    if t + shift < end and (s, t + shift) not in found:
                        found[s, t + shift] = q
                        buckets[s].append((t + shift, q))
    return found


def runs_of(texts: list[list[bytes]], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, by start and period."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    n = np.array([len(w) for w in texts], np.int64)
    flat = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(n.sum()))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    some = repeating(flat, n, -(-least // 2))
    if len(some):
        chosen = np.zeros(len(n), bool)
        chosen[some] = True
        own = n[some]
        starts = np.cumsum(own) - own
        found = all_runs(flat[np.repeat(chosen, n)], own, least)
        for (s, t), q in found.items():
            k = int(np.searchsorted(starts, s, "right")) - 1
            out[some[k]].append((s - int(starts[k]), t - s, q))
        for k in some:
            out[k].sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, but for those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        drop[s + q] += 1
        drop[s + length] -= 1
    return b" ".join(w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d)


def periodic_runs(df: DataFrame, text: str = "text", least: int = 12, slice_bytes: int = 2_000_000) -> tuple[DataFrame, list[str]]:
    """df with three more columns, whose names are returned: the number of words, the runs by start and period,
    and the text without what its runs repeat, words joined by one space."""
    at = df.columns.index(text)
    names = [fresh(df.columns, x) for x in ("n_words", "runs", "collapsed")]
    added = T._parse_datatype_string(f"{names[0]} bigint, {names[1]} {RUNS}, {names[2]} string").fields

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() if t else b"" for t in b.column(at).to_pylist()]
            for lo, hi in in_slices(texts, slice_bytes):
                words = [t.split() for t in texts[lo:hi]]
                runs = runs_of(words, least)
                kept = [collapsed(w, r).decode() for w, r in zip(words, runs, strict=True)]
                shown = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs]
                made = [pa.array([len(w) for w in words], pa.int64()), pa.array(shown, pa.list_(_RUN)), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, *made], [*b.schema.names, *names])

    return df.mapInArrow(find, T.StructType([*df.schema.fields, *added])), names


def report(df: DataFrame, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row a document: its number of runs, the longest (ties: smallest start, then period; nulls without a
    run), and digests of the list of runs and of the collapsed text."""
    found, (_, runs, kept) = periodic_runs(df.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "text", **kw)
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n")))
    out = found.select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), longest.alias("top"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col(kept).cast("binary"), 256).alias("collapsed_sha256"))
    start, period, length = -F.col("top.start"), -F.col("top.period"), F.col("top.length")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_runs(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with a periodic tail in the texts of a tenth of the ids.  Of h = crc32 of the id as text and g = h div 10,
    those with h % 10 = 0 repeat from word a = g % n on, of n words, with the period p = 1 + (n - a) div (3 + g % 8).
    Their words are joined by one space; other texts, those without a word or an id too, stay as they are."""
    h, w = F.crc32(F.col(id).cast("string").cast("binary")), F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")

    def tail(p):
        k, g = p["w"], F.expr("0") + p["g"]
        n = F.size(k).cast("bigint")
        a = g % n
        period = F.lit(1).cast("bigint") + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(k, F.when(i < a, i).otherwise(a + (i - a) % period).cast("int"))), " ")

    from ..functions.ports import let

    planted = let(F.struct(w.alias("w"), F.floor(h / 10).alias("g")), lambda p: F.when(F.size(p["w"]) > 0, tail(p)))
    return df.withColumn(text, F.when((h % 10 == 0) & F.col(text).isNotNull(), F.coalesce(planted, F.col(text))).otherwise(F.col(text)))
