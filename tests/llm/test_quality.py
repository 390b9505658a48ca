import re

import duckdb
import pytest

from weftline.llm import quality, queries


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


TEXTS = ["", None, "a b c a b c", "a\n\n b \na\nb\n \nA", "x " * 30 + "y", "é# <b> $1\x0b|\u00a0|", "a b c d"]


@pytest.mark.parametrize("text", TEXTS)
def test_measures(text):
    d = quality.Doc(text)
    assert tuple(getattr(d, m) for m in quality.MEASURES) == brute(text)


def test_query_against_sql(spark, sf_dir):
    got = queries.op8_quality_rules(spark, sf_dir)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cols = got.columns
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES['op8_quality_rules']})").fetchall())


def test_order_changes_no_verdict(odd, small):
    rules = quality.default_rules()
    want = {r["doc_id"]: r["kept"] for r in quality.report(small, rules=rules).collect()}
    assert {r["doc_id"]: r["kept"] for r in quality.report(small, rules=rules[::-1], sample_rows=5).collect()} == want
    for r in small.collect():
        n, chars, symbols, dups, repeats = brute(r["text"])
        lines = len(quality.Doc(r["text"]).lines)
        assert want[r["doc_id"]] == (n >= 50 and 100 * repeats <= 50 * n and 100 * symbols <= 10 * n and 100 * dups <= 50 * lines and 3 * n <= chars <= 10 * n)


def test_clean_documents_stay(spark, sf_dir, small):
    """Of documents labelled good that have enough words, few go; of bad ones nearly all do."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0")
    rows = quality.report(small).join(labels, "doc_id").where("n_words >= 50").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_odd_and_empty(odd, none):
    kept = quality.cascade(odd, drop=True)
    assert kept.schema == odd.schema
    marked = quality.cascade(odd)
    assert marked.columns == [*odd.columns, "kept_"] and marked.where("kept_").count() == kept.count()
    assert quality.cascade(none).count() == 0 and quality.report(none).count() == 0
