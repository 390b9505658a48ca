import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import queries, token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(values, rule="most"):
    t = Tokenizer.from_file(PATH)
    values = [v or "" for v in values]
    text, ends, at = " ".join(values), [], 0
    for i, v in enumerate(values):
        at += len(v) + (i > 0)
        ends.append(at)
    starts = [0, *ends[:-1]]
    n, crossing = [0] * len(values), [0] * len(values)
    for a, b in t.encode(text, add_special_tokens=False).offsets:
        held = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends)]
        f = held.index(max(held)) if rule == "most" else next(i for i, (s, e) in enumerate(zip(starts, ends)) if s <= a < e)
        n[f] += 1
        crossing[f] += sum(h > 0 for h in held) > 1
    return n, crossing


def by_doc(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["field_no"]):
        out.setdefault(r["doc_id"], []).append((r["n_tokens"], r["crossing"]))
    return out


def fields(r):
    head, feed, tail = (r["text"] or "").partition("\n")
    return [r["source"], r["lang"], head + feed, tail]


def sections(text, size=1000):
    """Title with its line feed, then passages of so many characters."""
    text = text or ""
    title = text.find("\n") + 1
    borders = [0, *([title] if 0 < title < len(text) else []), *range(title + size, len(text), size), len(text)]
    return borders


def test_query(spark, sf_dir, small):
    """Against the offsets of whole texts; the counts add up to those of op1 but for the end id, and
    tokens do cross borders."""
    got = {}
    for r in sorted(queries.op5_token_counts(spark, sf_dir).collect(), key=lambda r: r["section"]):
        got.setdefault(r["doc_id"], []).append((r["char_start"], r["char_end"], r["n_tokens"], r["crossing"]))
    t, all_crossing = Tokenizer.from_file(PATH), 0
    for r in small.collect():
        borders = sections(r["text"])
        spans = np.array(t.encode(r["text"] or "", add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        n, c = tc.attribute(spans[:, 0], spans[:, 1], np.array(borders))
        assert got[r["doc_id"]] == list(zip(borders, borders[1:], n.tolist(), c.tolist()))
        all_crossing += c.sum()
    assert all_crossing > 0.2 * sum(len(x) - 2 for x in got.values())
    whole = {r["doc_id"]: r["n_tokens"] - 1 for r in queries.op1_token_files(spark, sf_dir).collect()}
    assert {k: sum(x[2] for x in v) for k, v in got.items()} == whole


def test_fields(small):
    got = by_doc(tc.field_token_counts(small, tc.document_fields(), PATH).collect())
    for r in small.collect():
        assert got[r["doc_id"]] == list(zip(*brute(fields(r))))


@pytest.mark.parametrize("rule", tc.RULES)
def test_crossing_tokens(spark, rule):
    """Borders within words: no separator."""
    df = spark.createDataFrame([(1, "hel", "lo wor", "ld!"), (2, None, "", "x"), (3, "", "", "")], "doc_id bigint, a string, b string, c string")
    got = tc.field_token_counts(df, {k: F.col(k) for k in "abc"}, PATH, separator="", rule=rule)
    t = Tokenizer.from_file(PATH)
    for i, rows in by_doc(got.collect()).items():
        text = {1: "hello world!", 2: "x", 3: ""}[i]
        assert sum(n for n, _ in rows) == len(t.encode(text, add_special_tokens=False).ids)
    first = by_doc(got.collect())[1]
    assert first == ([(1, 1), (1, 1), (1, 0)] if rule == "start" else first)


@given(st.lists(st.integers(0, 6), min_size=1, max_size=8), st.lists(st.integers(1, 5), max_size=12))
def test_attribute(sizes, spans):
    borders = np.r_[0, np.cumsum(sizes)]
    ends = np.cumsum(spans)
    ends = ends[ends <= borders[-1]]
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    n, _ = tc.attribute(starts, ends, borders)
    want = [0] * len(sizes)
    for a, b in zip(starts, ends):
        held = [max(0, min(b, e) - max(a, s)) for s, e in zip(borders, borders[1:])]
        want[held.index(max(held))] += 1
    assert n.tolist() == want


def test_units_and_whole_spans_agree(small):
    """Borders anywhere, in any text."""
    import random

    from weftline.llm.units import encoder

    t = Tokenizer.from_file(PATH)
    rng, alphabet = random.Random(4), "ab C.,;:!?'é ÀŸ\n\n  \t1#$\u00a0\u0301你"
    texts = [r[0] for r in small.select("text").limit(60).collect()] + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(1000)]
    for text in map(str, texts):
        spans = np.array(t.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        borders = np.array([0, *sorted(rng.randint(0, len(text)) for _ in range(3)), len(text)])
        for rule in tc.RULES:
            want, got = tc.attribute(spans[:, 0], spans[:, 1], borders, rule), tc.count_sections(encoder(PATH, True), text, borders, rule)
            assert all(map(np.array_equal, want, got))


def test_odd_and_empty(odd, none):
    """Fields and sections, against whole-text offsets; rows with one id stay apart."""
    got = sorted((r["doc_id"] or -1, r["field_no"], r["n_tokens"], r["crossing"]) for r in tc.field_token_counts(odd, tc.document_fields(), PATH).collect())
    want = [(r["doc_id"] or -1, i, n, c) for r in odd.collect() for i, (n, c) in enumerate(zip(*brute(fields(r))))]
    assert got == sorted(want)
    cut = F.array(F.lit(7), F.lit(None), F.lit(3), F.lit(10**9), F.lit(3))
    t, want = Tokenizer.from_file(PATH), []
    for r in odd.collect():
        text = r["text"] or ""
        borders = np.array([0, *(min(x, len(text)) for x in (3, 3, 7, 10**9)), len(text)])
        spans = np.array(t.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        want += [(r["doc_id"] or -1, i, n, c) for i, (n, c) in enumerate(zip(*(x.tolist() for x in tc.attribute(spans[:, 0], spans[:, 1], borders))))]
    rows = tc.section_token_counts(odd, cut, PATH).collect()
    assert sorted((r["doc_id"] or -1, r["section"], r["n_tokens"], r["crossing"]) for r in rows) == sorted(want)
    null = F.lit(None).cast("array<bigint>")
    assert tc.section_token_counts(odd, null, PATH).count() == odd.count()
    for cuts in (null, tc.document_sections()):
        assert tc.section_token_counts(none, cuts, PATH).count() == 0


def test_layout_and_odd_white_space(spark):
    """The title keeps its line feed, a space stands between fields, and tokens cross borders."""
    texts = ["Title here\nBody of  it\n\nmore\tand\n", "one line", "\n\n x", " a\n b ", "t\n", "x\r\ny \n\tz", None, ""]
    df = spark.createDataFrame([(i, t, "en", "src") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    got = tc.field_token_counts(df, tc.document_fields(), PATH).collect()
    rows = by_doc(got)
    for r in df.collect():
        assert rows[r["doc_id"]] == list(zip(*brute(fields(r))))
    ends = {r["field"]: r["char_end"] for r in got if r["doc_id"] == 0}
    assert ends["title"] == len("src en Title here\n")
