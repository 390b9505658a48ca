import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from weftline.llm import queries, token_files, units

PATHS = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")]

SPECIAL = ["<|endoftext|> <|startoftext|>", "a<|endoftext|>b", " x <|EndOfText|> y", "one\n<|startoftext|>, two  <|endoftext|>\n", "<|endoftext| >", "a < b", None]


def whole(path):
    t = Tokenizer.from_file(path)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", PATHS)
def test_units_are_whole_text(path, small):
    rng, alphabet = random.Random(1), "abC.,;:!?'é ÀŸ\n\n  \t1#$_`\u00a0\u0301\x1c你"
    texts = [r[0] for r in small.select("text").collect()] + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(2000)] + SPECIAL
    enc, ids = units.encoder(path, units.spaced(path)), whole(path)
    got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts, 7)]
    assert got == [[*ids(t), 7] for t in texts]


def test_texts_together(monkeypatch):
    """Slices of regular texts, of which some words come again, and words of more bytes than are remembered."""
    monkeypatch.setattr(units, "KNOWN_BYTES", 3000, raising=False)
    rng, enc, ids = random.Random(2), units.UnitEncoder(PATHS[0], True), whole(PATHS[0])
    word = lambda n: "".join(rng.choices("aebcdÀéÿ×÷ß", k=rng.randint(1, n))) + rng.choice(["", "", ".", ",)", "'s", "7", "Ÿ", "你", "😀"])
    often = [word(8) for _ in range(50)]
    for _ in range(6):
        texts = [rng.choice(" \n").join(rng.choice(often) if rng.random() < 0.5 else word(8) for _ in range(rng.randint(1, 30))) for _ in range(60)]
        texts[7] = "\n".join(texts[:5]) + " " + "".join(rng.choices("abcde", k=2000))
        texts[9:12] = None, "", "two  spaces"
        got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts, 7)]
        assert got == [[*ids(t), 7] for t in texts]
    assert len(enc.known[0]) and sum(map(len, [*enc.first, *enc.rest, *enc.known[0].to_pylist()])) <= 3000


def test_words_met_before_need_no_library():
    enc, texts = units.UnitEncoder(PATHS[0], True), ["some words, and\nsome more words"]
    first, enc.plain = enc.encode(texts, 2), None
    assert enc.encode(texts * 2, 2) == first * 2 and not enc.rest


def test_small_slices_keep_few_words():
    enc = units.UnitEncoder(PATHS[0], True)
    enc.encode([" ".join(f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "lmnrst")], 2)
    enc.encode(["one two three"], 2)
    assert 3 < len(enc.known[0]) <= (units.KNOWN_TIMES + 1) * 3


def test_slices_are_even_and_whole():
    import pyarrow as pa

    for texts in ([], [None], ["", ""], ["abc"] * 10, ["x" * 50, "", None, "y"], [None, "x" * 9]):
        got = list(units.sized_slices(pa.array(texts, pa.string()), 8))
        assert [i for lo, hi in got for i in range(lo, hi)] == list(range(len(texts)))
    assert [hi - lo for lo, hi in units.sized_slices(pa.array(["abc"] * 10), 20)] == [5, 5]


def test_counts_of_the_code(spark, small, tmp_path):
    """They come with the chunks, from several partitions."""
    from collections import Counter

    token_files.write_ids(small, str(tmp_path), PATHS[0], 2)
    want = Counter(i for r in small.select("text").collect() for i in [*whole(PATHS[0])(r[0]), 2])
    assert {r["id"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/code").collect()} == want
    assert spark.read.parquet(f"{tmp_path}/blocks").agg({"n_ids": "sum"}).first()[0] == want.total()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=2000), st.integers(9, 16))
def test_codes(ids, bits):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=301)
    lengths = token_files.code_lengths(counts, bits)
    used = counts > 0
    assert (lengths[used] >= 1).all() and (lengths[used] <= bits).all() and (2.0 ** -lengths[used].astype(float)).sum() <= 1
    blocks = np.array_split(ids, 3)
    coded = [token_files.encode_block(b, lengths.tobytes()) for b in blocks]
    back = token_files.decode_blocks([c[0] for c in coded], [c[1] for c in coded], [len(b) for b in blocks], lengths.tobytes())
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(blocks, back))


def test_special_strings(spark):
    """A tokenizer as it is loaded takes the string of a special token for that token."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SPECIAL)], "doc_id bigint, text string")
    got = [np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.round_trip(df, PATHS[0], 2).orderBy("doc_id").collect()]
    assert got == [[*whole(PATHS[0])(t), 2] for t in SPECIAL] and got[1] == [64, 50256, 65, 2]


def test_lengths_are_optimal():
    """Against all ways to give four symbols lengths up to 3."""
    from itertools import product

    for counts in ([1, 1, 2, 9], [5, 5, 5, 5], [1, 2, 4, 8]):
        best = min(sum(a * b for a, b in zip(counts, ls)) for ls in product((1, 2, 3), repeat=4) if sum(2.0**-x for x in ls) <= 1)
        assert (token_files.code_lengths(np.array(counts), 3) * counts).sum() == best


def expected(df, path, end):
    ids, start, out = whole(path), 0, []
    for doc, text in sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0])):
        x = [*ids(text), end]
        out.append((doc, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


def test_query(spark, sf_dir, small):
    got = sorted(map(tuple, queries.op1_token_files(spark, sf_dir).collect()))
    assert got == expected(small, PATHS[0], 2)


def test_odd_and_empty(odd, none):
    got = token_files.round_trip(odd, PATHS[0], 2, block_ids=500)
    rows = sorted((r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got.collect())
    assert [s for s, *_ in rows] == [0, *np.cumsum([n for _, n, _ in rows])[:-1].tolist()]
    ids = whole(PATHS[0])
    assert sorted(x for *_, x in rows) == sorted([*ids(r["text"]), 2] for r in odd.collect())
    assert token_files.round_trip(none, PATHS[0], 2).count() == 0
