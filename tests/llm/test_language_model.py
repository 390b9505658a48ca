import math
import re
import zlib
from collections import Counter

import numpy as np

from weftline.llm import language_model as lm, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall((text or "").encode().lower()), b" "]


def out_of_fold(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def brute(rows):
    c = Counter(w for d, t in rows if not out_of_fold(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(d, out_of_fold(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows]


def check(got, rows):
    n, want = brute(rows)
    key = lambda r: (str(r[0]), r[2], round(r[4], 6))
    have = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got]
    assert {r["train_tokens"] for r in got} <= {n}
    for a, b in zip(sorted(have, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * max(1, abs(b[4]))


def test_query(spark, sf_dir, small):
    got = queries.op2_lm_scoring(spark, sf_dir).collect()
    check(got, [(r["doc_id"], r["text"]) for r in small.collect()])
    held = [r for r in got if r["held_out"]]
    # held-out accuracy: the model beats the base
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)


def test_odd_and_empty(odd, none):
    got = lm.score_documents(odd).collect()
    check(got, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert lm.score_documents(none).count() == 0


def exact_scores(rows, mu=lm.MU):
    """The same model with exact counts, by hand."""
    words, pairs = Counter(), Counter()
    for d, t in rows:
        if not out_of_fold(d):
            ws = tokens(t)
            words.update(ws)
            pairs.update(zip([b" ", *ws], ws))
    total = sum(words.values())
    u = min(0.5, max(sum(c == 1 for c in words.values()) / total, 1e-9))
    p1 = lambda w: (1 - u) * words[w] / total if words[w] else u
    score = lambda ws: sum(math.log10(min(1.0, (pairs[v, w] + mu * p1(w)) / (words[v] + mu))) for v, w in zip([b" ", *ws], ws))
    return [score(tokens(t)) for _, t in rows]


def test_scores_against_exact_counts(spark, sf_dir, small):
    """A level stands for counts within a tenth of it, so a token's log is off by no more than
    2 * log10(1.1) = 0.08, but for the false positives: about one probe in a hundred."""
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    want = dict(zip((d for d, _ in rows), exact_scores(rows)))
    got = {r["doc_id"]: r["score"] for r in queries.op2_lm_scoring(spark, sf_dir).collect()}
    a_token = sorted(abs(got[d] - want[d]) / len(tokens(t)) for d, t in rows)
    relative = sorted(abs(got[d] / want[d] - 1) for d, _ in rows)
    assert a_token[len(rows) // 2] < 0.02 and a_token[-1] < 0.1
    assert relative[len(rows) // 2] < 0.005 and relative[int(len(rows) * 0.95)] < 0.02


def test_pieces_and_slices_change_nothing(small):
    """How the filter is cut for broadcasts changes no row, nor does how texts are cut into slices;
    a vocabulary of any size is scored."""
    rows = lambda **kw: sorted(map(tuple, lm.score_documents(small, part_tokens=4_000, **kw).collect()))
    one = rows()
    for kw in ({"max_bytes": 1}, {"shard_parts": 3, "max_bytes": 9_000}, {"slice_bytes": 50_000}, {"all_bytes": 0}, {"all_bytes": 0, "slice_bytes": 50_000}):
        for a, b in zip(one, rows(**kw), strict=True):
            assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-6


def test_parts_change_false_positives_only(small):
    one, many = ({r["doc_id"]: r for r in lm.score_documents(small, part_tokens=n).collect()} for n in (1 << 20, 2_000))
    for k, r in one.items():
        assert many[k]["n_known"] == r["n_known"] and abs(many[k]["base_score"] - r["base_score"]) < 1e-6
    a, b = (sum(r["score"] for r in x.values()) for x in (one, many))
    assert abs(a - b) < 0.02 * abs(a)


def test_filter_holds_levels():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    counts = rng.geometric(0.3, 20_000).astype(np.int64) ** 3
    want = np.searchsorted(lm.LEVELS, counts, "right")
    part = lm.part_of(keys, 4)
    f = lm.Filter({p: lm.build(keys[part == p], counts[part == p]).tobytes() for p in range(4)})
    got = f.levels(keys, part)
    assert (got >= want).all() and (got == want).mean() > 0.98
    other = keys + np.uint64(1)
    assert (f.levels(other, lm.part_of(other, 4)) > 0).mean() < 0.02


def test_nothing_learnt(spark):
    """No training row: all tokens unknown, the base log10(1/1)."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = sorted(map(tuple, lm.score(df, F.lit(False)).collect()))
    assert [r[:6] for r in got] == [(1, False, 3, 0, 0, 0.0), (2, False, 1, 0, 0, 0.0)]


def test_jobs_do_not_grow_with_the_filter(spark, small):
    """Beyond what is broadcast, no job is added by more parts."""
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for k, part_tokens in enumerate((20_000, 1_000)):
        spark.sparkContext.setJobGroup(f"scores{k}", "")
        lm.score_documents(small, part_tokens=part_tokens, all_bytes=0).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"scores{k}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1] <= 12


def test_exact_columns_against_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = {r[0]: r[1:] for r in c.sql(queries.base_score_sql()).fetchall()}
    got = queries.op2_lm_scoring(spark, sf_dir).collect()
    assert len(want) == len(got)
    for r in got:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:4]
        assert abs(r["base_score"] - want[r["doc_id"]][4]) < 1e-9 * abs(r["base_score"]) + 1e-9
