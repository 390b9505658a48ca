import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from weftline.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.sampled_from(("dot", "norm")), st.integers(2, 64), st.sampled_from((64 * 64, 5000)))
def test_every_constraint_holds(lengths, score, docs, attention):
    lengths = np.array(lengths, np.int64)
    where, offset = packing.pack_lengths(lengths, 64, docs, attention, score=score)
    bins = defaultdict(list)
    for n, w, o in zip(lengths, where, offset):
        bins[w].append((o, n))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1].tolist()]
        assert sum(n for _, n in b) <= 64 and len(b) <= docs and sum(n * n for _, n in b) <= attention
    # best-fit keeps no two sequences that fit together
    if docs == 64 and attention == 64 * 64:
        loads = sorted(sum(n for _, n in b) for b in bins.values())
        assert len(loads) < 2 or loads[0] + loads[1] > 64
        assert len(loads) <= 11 / 9 * (lengths.sum() / 64) + 2 or lengths.min(initial=64) > 20


def test_vector_choice():
    """The documents and attention that are left decide between sequences with the same tokens left: other
    bins than by tokens alone, and as few."""
    rng = np.random.default_rng(8)
    lengths = np.r_[rng.integers(1, 40, 4000), rng.integers(40, 2049, 800)]
    vector, _ = packing.pack_lengths(lengths)
    plain, _ = packing.pack_lengths(lengths, weights=(1.0, 0.0, 0.0))
    same = lambda where: {frozenset(np.flatnonzero(where == b).tolist()) for b in range(where.max() + 1)}
    assert same(vector) != same(plain)
    least = -(-int(lengths.sum()) // 2048)
    assert least <= vector.max() + 1 <= plain.max() + 1 <= least + 1
    # capacities of documents and attention that bind
    bound, _ = packing.pack_lengths(np.sort(rng.integers(1, 60, 3000)), 2048, docs=50, attention=2048 * 2048)
    assert np.bincount(bound).max() == 50


def test_too_long():
    with pytest.raises(ValueError):
        packing.pack_lengths(np.array([65]), 64)


def check(rows, docs, tokens):
    t = Tokenizer.from_file(PATH)
    want = sorted((i, p, s, len(x[s : s + tokens]), zlib.crc32(np.array(x[s : s + tokens], "<u4").tobytes())) for i, text in docs for x in [[*t.encode(text or "", add_special_tokens=False).ids, 0]] for p, s in enumerate(range(0, len(x), tokens)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1].tolist()] and sum(n for _, n in b) <= tokens
    return len(bins), sum(w[3] for w in want) / tokens


def test_query(spark, sf_dir, small):
    used, least = check(queries.op7_packing(spark, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in small.collect()], 2048)
    assert used <= least * 1.02 + 1


def test_special_strings(spark):
    texts = ["<|endoftext|> hello", "a<|startoftext|>b <|ENDOFTEXT|>", "plain < text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check(packing.pack(df, PATH, 0, tokens=4).collect(), list(enumerate(texts)), 4)


def test_odd_and_empty(odd, none):
    docs = odd.where("doc_id IS NOT NULL")
    rows = packing.pack(docs, PATH, 0, tokens=100, group_pieces=50).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 100)
    assert packing.pack(odd, PATH, 0).where("doc_id IS NULL").count() == 2
    assert packing.pack(none, PATH, 0).count() == 0
    ids = packing.pack(docs, PATH, 0, with_ids=True).first()
    assert zlib.crc32(ids["ids"]) == ids["ids_crc32"]
