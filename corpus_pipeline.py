"""A corpus pipeline: documents become packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import exact_dedup, mixing, near_dup, packing, quality
from weftline.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.cascade(docs, drop=True)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.near_dedup(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, at the target weights; rows repeat by epochs."""
    return mixing.mixed_documents(docs, mixing.document_levels(), mixing.DOCUMENT_WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents with their place in a sequence of at most 2048 tokens and 32 documents."""
    return packing.pack(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end=0, docs=32)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near duplicates", near_copies),
    ("target mix", target_mix),
    ("packing", pack_sequences),
]

#: The last stage encodes with a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
