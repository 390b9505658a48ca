"""Windows of test texts in documents, by hand and by SQL."""

import hashlib
import random
import re

import duckdb
import pytest

from weftline.llm import decontamination as dc, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if x := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    ids |= x
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    few = [f"t{i}" for i in range(7)] + ["É", "ñandú9"]
    text = lambda k, of=few: " ".join(rng.choices(of, k=k))
    items = [(i, text(rng.choice([1, 2, 3, 12, 25]), [f"u{j}" for j in range(400)])) for i in range(15)]
    items += [(15, items[3][1]), (3, items[3][1]), (None, "alone here"), (16, None), (17, ""), (18, "?! -"), (19, text(11))]
    docs = []
    for i in range(60):
        parts = [text(rng.choice([0, 3, 40]))]
        for _ in range(rng.choice([0, 1, 3])):
            _, t = rng.choice(items)
            w = (t or "").split()
            at = rng.randrange(len(w) + 1)
            parts += [rng.choice([" ".join(w), " ".join(w[at:]), " ".join(w).upper(), ", ".join(w)]), text(rng.choice([0, 1, 5]))]
        docs.append((i, rng.choice([" ", "\n", " -- "]).join(parts)))
    return docs + [(1, docs[1][1]), (None, docs[2][1]), (70, None), (71, ""), (72, "alone here " * 20_000)], items


DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def told(df):
    return sorted((tuple(r[k] for k in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"block_bytes": 120}, {"n": 4}, {"n": 1}])
def test_report(spark, how):
    docs, items = corpus()
    df = spark.createDataFrame(docs, DOCS).repartition(3).selectExpr("*", "1 AS spans", "2 AS RID", "3 AS n_words")
    assert told(dc.report(df, spark.createDataFrame(items, ITEMS), **how)) == brute(docs, items, how.get("n", 10))


def test_texts_are_cut(spark):
    tests = spark.createDataFrame([("a", "one two three four five six seven eight nine ten eleven"), ("b", "Short one!")], "item_id string, text string")
    docs = [(1, "Keep: (One, two three four five six seven eight nine TEN. Eleven) and this", "x"), (2, "a short  one. b", "y"), (3, "one two three four five six seven eight nine", "z"), (4, None, "n"), (5, "é short-one é", None)]
    df = spark.createDataFrame(docs, "id int, text string, spans string")
    for kw in ({}, {"block_bytes": 1}):
        cut = dc.decontaminate(df, tests, **kw)
        assert cut.columns == df.columns
        assert {r["id"]: (r["text"], r["spans"]) for r in cut.collect()} == {1: ("Keep: () and this", "x"), 2: ("a . b", "y"), 3: (docs[2][1], "z"), 4: (None, "n"), 5: ("é  é", None)}
        assert sorted(r["id"] for r in dc.decontaminate(df, tests, whole=True, **kw).collect()) == [3, 4]


def test_a_passage_in_all_tests_and_documents(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    items = [(i, f"{passage} own{i} words") for i in range(200)]
    docs = [(i, f"before {passage} after {i}") for i in range(300)]
    got = told(dc.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)))
    assert got == brute(docs, items) and {r[3] for r in got} == {200}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert dc.report(docs.limit(0), items).count() == 0
    assert told(dc.report(docs, items.limit(0))) == brute([(1, "a b")], []) and told(dc.report(docs, items)) == brute([(1, "a b")], [(1, "a")])


def test_query_against_sql(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    c.sql("CREATE TABLE odd_docs AS SELECT * FROM (VALUES (1, NULL), (2, ''), (3, 'short one'), (3, 'short one')) t(doc_id, text)")
    c.sql("CREATE TABLE odd_items AS SELECT * FROM (VALUES (NULL, 'One'), (7, NULL), (8, 'Short ONE'), (8, 'Short ONE')) t(item_id, text)")
    order = lambda sql: sorted(((r[0], *r[1:]) for r in c.sql(sql).select("doc_id, n_words, n_hit, n_items, items_sha256, contaminated").fetchall()), key=str)
    assert told(queries.op12_decontamination(spark, sf_dir)) == order(queries.ORACLES["op12_decontamination"])
    odd = [spark.createDataFrame(c.sql(f"SELECT * FROM {t}").fetchall(), s) for t, s in (("odd_docs", DOCS), ("odd_items", ITEMS))]
    assert told(dc.report(*odd)) == order(queries.leaks_sql("odd_docs", "odd_items"))
