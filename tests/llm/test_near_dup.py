import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from weftline.llm import near_dup as nd, queries
from weftline.llm.components import components


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    """Row number -> (n links, group of row numbers)."""
    sets = [shingles(t) for _, t in rows]
    links, root = defaultdict(set), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i].add(j), links[j].add(i)
                root[find(i)] = find(j)
    return [(len(links[i]), find(i)) for i in range(len(rows))]


def check(got, rows):
    want = brute(rows)
    least = defaultdict(list)
    for (i, _), (_, g) in zip(rows, want):
        least[g].append(i)
    name = {g: min((i for i in v if i is not None), default=None) for g, v in least.items()}
    expected = sorted(str((i, name[g] if shingles(t) else i, n)) for (i, t), (n, g) in zip(rows, want))
    assert sorted(str((r["doc_id"], r["class_id"], r["n_links"])) for r in got) == expected


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(11)
    rows, i = [], 0
    passage = [f"p{k}" for k in range(60)]
    for g in range(25):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice((12, 80, 300)))]
        for k in range(rng.choice((1, 2, 5))):
            rows.append((i, edited(rng, base + (passage if g % 3 == 0 else []), k % 3)))
            i += 1
    hot = [f"h{rng.randrange(500)}" for _ in range(150)]
    rows += [(i + k, edited(rng, hot, k % 3)) for k in range(120)]
    return rows


def test_planted(spark, planted):
    df = spark.createDataFrame(planted, "doc_id bigint, text string")
    check(nd.near_report(df).collect(), planted)
    # small blocks deal a cluster over several tasks
    check(nd.near_report(df, block_rows=30).collect(), planted)
    check(nd.near_report(df, block_shingles=4000).collect(), planted)


def test_query(spark, sf_dir, small):
    check(queries.op9_near_duplicates(spark, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in small.collect()])


def test_odd_and_empty(odd, none):
    check(nd.near_report(odd).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    kept = nd.near_dedup(odd)
    assert kept.schema == odd.schema
    groups = {(g if shingles(r["text"]) else (r["doc_id"], r["text"])) for (_, g), r in zip(brute([(r["doc_id"], r["text"]) for r in odd.collect()]), odd.collect())}
    assert kept.count() == len(groups)
    assert nd.near_report(none).count() == 0 and nd.near_dedup(none).count() == 0


def test_banding_reaches_recall():
    for t, recall in ((0.8, 0.9999), (0.9, 0.99), (0.5, 0.95)):
        bands, rows = nd.banding(t, recall)
        assert 1 - (1 - t**rows) ** bands >= recall and bands * rows <= 128
    with pytest.raises(ValueError):
        nd.banding(0.05, 0.9999, 16)


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    i, j = map(np.ravel, np.meshgrid(range(40), range(40)))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert nd.intersections(sets, sets, i, j).tolist() == want
    assert nd.intersections(sets, sets, i[:5], j[:5]).tolist() == want[:5]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def test_sql(spark, sf_dir, planted, tmp_path):
    """The query's SQL on the small tables and on planted groups."""
    spark.createDataFrame(planted, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for folder, glob in ((sf_dir, ""), (str(tmp_path), "/*.parquet")):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{glob}'")
        got = queries.op9_near_duplicates(spark, folder)
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op9_near_duplicates']})")
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_leaves_no_tables_behind(spark, planted):
    """Only the two results stay of all that is written on the way."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    signed, classes = nd.near_groups(spark.createDataFrame(planted, "doc_id bigint, text string"))
    assert len(set(os.listdir(folder)) - before) <= 2 + 2  # and the components of the bands and of the links
    assert signed.count() == len(planted) and classes.count()
