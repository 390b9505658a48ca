import hashlib
import re
from collections import defaultdict

import duckdb

from weftline.llm import mixing, queries

WEIGHTS = mixing.DOCUMENT_WEIGHTS


def brute(rows, fraction=1.0, epochs=4, seed=17):
    """Water-filling and prefixes, one Python step at a time."""
    docs = []
    for r in rows:
        s, lang = r["source"] or "", r["lang"] or ""
        d = "crawl" if s == "src0" else "books" if re.fullmatch("src[1-9]", s) else "forum"
        docs.append(((d, lang, s), r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))))
    tokens = defaultdict(int)
    for leaf, _, n in docs:
        tokens[leaf] += n
    weight = lambda p: ({"crawl": 2, "books": 5}.get(p[0], 3), {"en": 6, "de": 2}.get(p[-1], 1), 1)[len(p) - 1]
    quota = {}

    def deal(path, budget):
        if len(path) == 3:
            quota[path] = budget
            return
        kids = sorted({l[: len(path) + 1] for l in tokens if l[: len(path)] == path})
        cap = {k: sum(n for l, n in tokens.items() if l[: len(k)] == k) * epochs for k in kids}
        full, left = set(), budget
        while True:
            w = sum(weight(k) for k in kids if k not in full)
            new = {k for k in kids if k not in full and cap[k] * w <= weight(k) * left}
            if not new:
                break
            k = min(new, key=lambda k: (cap[k] / weight(k), k))
            full.add(k)
            left -= cap[k]
        run, w = 0, sum(weight(k) for k in kids if k not in full)
        for k in sorted(kids, key=lambda k: (cap[k] / weight(k), k)):
            if k in full:
                deal(k, cap[k])
            else:
                deal(k, (run + weight(k)) * left // w - run * left // w)
                run += weight(k)

    deal((), min(int(sum(tokens.values()) * fraction), sum(tokens.values()) * epochs))
    out = []
    for leaf, q in quota.items():
        at = 0
        for e in range(epochs + 1):
            key = lambda i: int(hashlib.md5(f"{seed}:{e}:{'' if i is None else i}".encode()).hexdigest()[:15], 16)  # noqa: E731,B023
            mine = sorted((key(i), i is not None, i, n) for l, i, n in docs if l == leaf)
            for h, _, i, n in mine:
                if at < q and tokens[leaf]:
                    out.append((i, *leaf, n, e, h, min(n, q - at)))
                at += n
    return sorted(out, key=str), quota


def test_query_and_sql(spark, sf_dir, small):
    got = sorted((tuple(r[c] for c in ("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "order_key", "take_tokens")) for r in queries.op4_mixing(spark, sf_dir).collect()), key=str)
    want, quota = brute(small.collect())
    assert got == want
    total = sum(r[4] for r in want if r[5] == 0)
    assert sum(r[-1] for r in got) == sum(quota.values()) and total
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cols = "doc_id, domain, lang, source, n_tokens, epoch, order_key, take_tokens"
    assert sorted(duckdb.sql(f"SELECT {cols} FROM ({queries.ORACLES['op4_mixing']})").fetchall(), key=str) == want


def test_budgets_and_ranges(small):
    """Scarce and plentiful budgets, and hash ranges of few rows."""
    for fraction, epochs, rows in ((0.3, 4, 3), (2.5, 3, 2), (50.0, 2, 5)):
        got = mixing.mix(small, mixing.document_levels(), WEIGHTS, fraction=fraction, max_epochs=epochs, range_rows=rows)
        want, _ = brute(small.collect(), fraction, epochs)
        assert sorted((tuple(r[c] for c in ("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "order_key", "take_tokens")) for r in got.collect()), key=str) == want


def test_odd_and_empty(odd, none):
    got = mixing.mix(odd, mixing.document_levels(), WEIGHTS)
    assert got.columns[: len(odd.columns)] == odd.columns and sum(r["take_tokens"] for r in got.collect()) == sum(r["n_tokens"] for r in odd.select(mixing.words("text").alias("n_tokens")).collect())
    assert mixing.mixed_documents(odd, mixing.document_levels(), WEIGHTS).schema == odd.schema
    assert mixing.mix(none, mixing.document_levels(), WEIGHTS).count() == 0


def test_no_python(spark, sf_dir):
    plan = queries.op4_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
