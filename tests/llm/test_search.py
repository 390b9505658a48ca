"""Lexical search against scores of every document, by hand and by SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from weftline.llm import queries, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k, b=50):
    """[(item_id, rank, doc_id, score)] of docs [(id, text)] and items."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_all, l_all = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 100 - b + b * sum(c.values()) * n_all // max(l_all, 1)
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, 0 if d is None else d, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "straße", "A1", "x_y", "naïve-co-op"]
    text = lambda: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.choice([0, 1, 5, 30, 200])))
    docs = [(i, text() if rng.random() > 0.05 else None) for i in range(n)]
    # copies, more of them than k, some with the same id, and texts without id
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(5, "w1 w2 w3"), (5, "w1 w2 w3"), (None, "w1 w2 w3"), (None, "w4")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for i in range(12)] + [(3, "w1 W2 w1"), (None, "w4, W5!"), (20, ""), (21, None), (22, "nowhere"), (23, "... w0")]
    return docs, items


DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


@pytest.mark.parametrize("how", [{}, {"segment_bytes": 300}, {"block_bytes": 200}, {"segment_bytes": 2_000, "block_bytes": 60}])
def test_every_best_document(spark, how):
    docs, items = corpus()
    df = spark.createDataFrame(docs, DOCS).repartition(5).selectExpr("*", "1 AS terms", "2 AS Query")
    index = search.build_index(df, **{k: v for k, v in how.items() if k == "segment_bytes"})
    for k in (1, 5, 50, 1000):
        got = search.search(index, spark.createDataFrame(items, ITEMS), k=k, **{k: v for k, v in how.items() if k == "block_bytes"})
        assert found(got) == brute(docs, items, k), k


def test_other_weight_of_sizes_and_ids_of_text(spark):
    docs, items = corpus(100, 8)
    named = [(None if d is None else f"d{d}", t) for d, t in docs]
    index = search.build_index(spark.createDataFrame(named, "id string, body string"), "id", "body", b=75)
    got = search.search(index, spark.createDataFrame([(f"q{i}", t) for i, t in items], "item_id string, text string"), k=7)
    want = brute([(d, t) for d, t in named], [(f"q{i}", t) for i, t in items], 7, b=75)
    assert found(got) == want


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], DOCS)
    ask = spark.createDataFrame([(1, "a")], ITEMS)
    assert search.ranked(none, ask).count() == 0 and search.ranked(some, ask.limit(0)).count() == 0
    assert found(search.ranked(some, ask)) == brute([(1, "a")], [(1, "a")], 50)


def test_long_texts(spark):
    docs = [(i, "a b " * (20_000 * i) + "c") for i in range(4)]
    items = [(1, "a b c"), (2, "z " * 50_000 + "c")]
    index = search.build_index(spark.createDataFrame(docs, DOCS), segment_bytes=1 << 16)
    assert found(search.search(index, spark.createDataFrame(items, ITEMS), block_bytes=1)) == brute(docs, items, 50)


def test_bounds_hold_the_scores(spark):
    """Level one: w * byte is an upper bound, less than a step above the impact; few documents need level two."""
    import numpy as np

    rng = np.random.default_rng(2)
    tf, m = rng.integers(1, 1000, 5000), rng.integers(50, 200_000, 5000)
    exact = search.impacts(tf, m)
    level = -(-exact // search.STEP)
    assert level.max() <= 255 and exact.max() < 10**6
    assert (level * search.STEP >= exact).all() and ((level - 1) * search.STEP < np.maximum(exact, 1)).all()


def test_query_against_sql(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.op11_lexical_search(spark, sf_dir)
    want = c.sql(queries.ORACLES["op11_lexical_search"]).fetchall()
    assert found(got) == sorted(want, key=str) and len(want) > 1000
