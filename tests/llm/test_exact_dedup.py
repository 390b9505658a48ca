import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import exact_dedup as ed, queries


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 30_000):
        d = np.unique(rng.integers(0, 256, (n, 32), dtype=np.uint8), axis=0)
        levels, slot = ed.mph_build(d)
        assert sorted(slot) == list(range(len(d)))
        stored = np.empty_like(d)
        stored[slot] = d
        assert (ed.mph_slots(levels, d, stored) == slot).all()
        strangers = rng.integers(0, 256, (500, 32), dtype=np.uint8)
        assert (ed.mph_slots(levels, strangers, stored) == -1).all()
        # some bytes of a member are not enough
        near = d.copy()
        near[:, 31] ^= 1
        assert (ed.mph_slots(levels, near, stored) == -1).all()


def brute(rows):
    ids = defaultdict(list)
    for i, t in rows:
        ids[t or ""].append(i)
    key = lambda i: (i is not None, i)
    return {t: (max(v, key=key), len(v)) for t, v in ids.items()}


def test_query(spark, sf_dir, small):
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    want = brute(texts.items())
    got = queries.op6_exact_dedup(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert (r["keep_id"], r["group_size"]) == want[t] and r["kept"] == (r["doc_id"] == r["keep_id"])
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_odd(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = brute(rows)
    for shard_rows in (100_000, 2):
        got = ed.dedup_report(odd, shard_rows=shard_rows).collect()
        assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(want)
        sizes = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
        assert all((r["keep_id"], r["group_size"]) == sizes[r["text_sha256"]] for r in got)
    kept = ed.dedup(odd)
    assert kept.schema == odd.schema and kept.count() == len(want)
    assert sorted(str((r["doc_id"], r["text"] or "")) for r in kept.collect()) == sorted(str((i, t)) for t, (i, _) in want.items())


def test_ids_of_any_type(spark, odd):
    """String and date ids go through the index as well."""
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for make in (lambda c: c.cast("string"), lambda c: F.date_add(F.lit("2020-01-01"), c.cast("int"))):
        df = odd.withColumn("doc_id", make(F.col("doc_id")))
        ids = {r["doc_id"]: None for r in df.select("doc_id").collect()}
        kept = ed.dedup(df)
        assert kept.count() == len(brute(rows)) and set(r["doc_id"] for r in kept.collect()) <= set(ids)
        got = ed.dedup_report(df).collect()
        want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
        sizes = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
        assert all((r["keep_id"], r["group_size"]) == sizes[r["text_sha256"]] for r in got)
        prints = ed.fingerprints(df)
        index = ed.build_index(prints.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0), 1)
        assert index.count() == 1 and len(index.first()["digests"]) >= 32


def test_empty_and_one_sided(spark, none):
    assert ed.dedup_report(none).count() == 0 and ed.dedup(none).count() == 0
    same = spark.createDataFrame([(7, "x", 1)] * 3, "doc_id bigint, text string, digest int")
    assert ed.dedup(same).collect() == [(7, "x", 1)]
    assert sum(r["kept"] for r in ed.dedup_report(same).collect()) == 1
