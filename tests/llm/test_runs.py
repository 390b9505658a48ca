"""Maximal runs against all pairs of places, and by SQL."""

import hashlib
import random
import time
import zlib

import duckdb
from pyspark.sql import functions as F

from weftline.llm import queries, runs


def brute(w, least):
    """All stretches with words q apart alike, by every q."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, t - s, q) for (s, t), q in out.items()), key=lambda r: (r[0], r[2]))


def texts(rng, docs):
    for _ in range(docs):
        k, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.choice([0, 1, 5, 20, 60, 150])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 4) if n > 3 else 0):
            a = rng.randrange(len(w))
            w = (w[: rng.randrange(len(w))] + w[a : a + rng.randrange(1, 20)] * rng.randint(1, 5) + w[rng.randrange(len(w)) :])[:300] or [b"x"]
        yield w


def test_all_runs():
    """Texts of few words, of repeats in repeats, many at once and alone."""
    rng = random.Random(11)
    for _ in range(250):
        some = list(texts(rng, rng.randint(1, 8)))
        for least in (2, 3, 12):
            assert runs.runs_of(some, least) == [brute(w, least) for w in some]


def fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_words_with_very_many_runs():
    for w in (fibonacci(600), [b"a"] * 400, [b"a", b"b"] * 200, ([b"a"] * 7 + [b"b"]) * 30, fibonacci(100) * 4, [b"%d" % (i % 13) for i in range(300)] + [b"%d" % (i % 7) for i in range(300)]):
        for least in (2, 12):
            assert runs.runs_of([w], least) == [brute(w, least)]


def test_long_texts_take_about_linear_time():
    rng = random.Random(1)
    for make in (lambda n: fibonacci(n), lambda n: [b"a"] * n, lambda n: [b"%d" % rng.randrange(50) for _ in range(n // 10)] * 10):
        times = []
        for n in (20_000, 160_000):
            w = make(n)
            start = time.perf_counter()
            assert runs.runs_of([w])[0]
            times.append(time.perf_counter() - start)
        assert times[1] < 40 * max(times[0], 0.02)


def test_collapsed():
    w = b"x a b a b a b a b a b a b a b y".split()
    r = runs.runs_of([w])[0]
    assert r == [(1, 14, 2)] and runs.collapsed(w, r) == b"x a b y"


def planted(doc, text):
    w = (text or "").split()  # these texts hold no other white space
    if doc is None:
        return w
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def row(doc, w):
    found = brute([x.encode() for x in w], 12)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(((-length, s, q) for s, length, q in found), default=None)
    best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(found), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def told(df):
    return sorted((tuple(r[k] for k in NAMES) for r in df.collect()), key=str)


def test_report(spark):
    """Planted tails, nulls, empty texts, repeated rows, a null id, columns with names of its own."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["a", "b", "cc", "É"], k=rng.choice([0, 1, 3, 40, 300])))) for i in range(150)]
    rows += [(5, "a b " * 30), (5, "a b " * 30), (None, "x y z " * 10), (200, None), (201, ""), (202, "  "), (203, "w" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).selectExpr("*", "1 AS runs", "2 AS Collapsed", "3 AS n_runs")
    got = told(runs.report(runs.with_planted_runs(df)))
    assert got == sorted((row(d, planted(d, t)) for d, t in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(150)) > 5
    made, names = runs.periodic_runs(df)
    assert made.columns == [*df.columns, *names] and len({n.lower() for n in made.columns}) == len(made.columns)
    assert runs.report(df.limit(0)).count() == 0


def test_query_against_sql(spark, sf_dir, small):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted((tuple(r) for r in c.sql(queries.ORACLES["op13_periodic_runs"]).select(", ".join(NAMES)).fetchall()), key=str)
    assert told(queries.op13_periodic_runs(spark, sf_dir)) == want


def test_ids_of_any_kind(spark):
    df = spark.createDataFrame([(str(i), "a b c d " * 5) for i in range(40)], "doc_id string, text string")
    got = told(runs.report(runs.with_planted_runs(df)))
    assert got == sorted((row(str(i), planted(i, "a b c d " * 5)) for i in range(40)), key=str)
    assert df.where(F.col("doc_id").isNull()).count() == 0
