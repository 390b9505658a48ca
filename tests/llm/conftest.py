import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, Rid int, DIGEST string, kept boolean"


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    """The documents of the smallest tables."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with names that operators use."""
    long = " ".join(f"word{i % 977} x{i}." for i in range(40_000))
    body = "\n".join(" ".join(f"t{(7 * i + 3 * k) % 89}b" for i in range(30)) for k in range(4))
    texts = [(1, None), (2, ""), (3, ""), (4, "a"), (5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (6, long), (7, long + " end"), (8, body), (9, body.replace("t10b", "zz", 1)), (10, "  \n\t "), (11, "x \u00a0 y\x1c z"), (None, None), (12, body), (12, body)]
    rows = [(i, t, "en" if k % 2 else None, f"src{k % 3}" if k % 5 else None, 0, k, "d", True) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
