"""Token counts of the sections or fields of a document, by offsets.

A document's text is encoded once, whole (units.py).  Its sections are adjacent spans of characters, given
by the positions between them.  The character spans of the tokens are joined to the sections' spans as
intervals, and a token that lies across a border is given to one section by an explicit rule:

``most``   the section that holds most of its characters, the earlier one in a tie
``start``  the section of its first character

so that the counts of the sections always add up to the tokens of the text.  ``crossing`` says how
many of a section's tokens reach outside it.  A unit of text within one section gives it all its tokens;
only units across a border are joined token by token.

``section_token_counts`` takes a text and the positions between its sections, ``field_token_counts`` lays
fields out as one text, where a separator belongs to the field after it, as the vocabularies here join a
space to the word that follows.

A section without characters holds no token and gets a row; an empty or null text has only sections without
tokens.  Positions are clipped to the text and taken in ascending order; null positions count as none.
Fields with a null or empty value get a row too, which can hold their separator's token.  Rows are treated
one by one; rows with the same id give rows with the same id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .units import UnitEncoder, encoder, in_slices, spaced

RULES = ("most", "start")


def attribute(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """starts, ends: the tokens' spans, ascending.  borders: n + 1 ascending ends of n adjacent
    sections.  Tokens, and crossing tokens, of each section."""
    n = len(borders) - 1
    # sections without characters hold no token: of equal borders the last begins a section
    first = np.clip(np.searchsorted(borders, starts, "right") - 1, 0, max(n - 1, 0))
    last = np.clip(np.searchsorted(borders, np.maximum(ends - 1, starts), "right") - 1, 0, max(n - 1, 0))
    owner, crossing = first.copy(), last > first
    if rule == "most":
        for i in np.flatnonzero(crossing):
            f = np.arange(first[i], last[i] + 1)
            held = np.minimum(borders[f + 1], ends[i]) - np.maximum(borders[f], starts[i])
            owner[i] = f[np.argmax(held)]
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def count_sections(enc: UnitEncoder, text: str, borders: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and crossing tokens, of the sections of a text."""
    sections = len(borders) - 1
    if not text:
        return np.zeros(sections, np.int64), np.zeros(sections, np.int64)
    sizes, n = enc.units(text)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.clip(np.searchsorted(borders, starts, "right") - 1, 0, sections - 1)
    across = ends > borders[owner + 1]
    tokens, crossing = np.bincount(owner[~across], weights=n[~across], minlength=sections).astype(np.int64), np.zeros(sections, np.int64)
    if across.any():
        spans = np.concatenate([enc.offsets(text[s:e]) + s for s, e in zip(starts[across].tolist(), ends[across].tolist(), strict=True)])
        more, crossing = attribute(spans[:, 0], spans[:, 1], borders, rule)
        tokens = tokens + more
    return tokens, crossing


def section_token_counts(df: DataFrame, cuts: Column, tokenizer: str, id: str = "doc_id", text: str = "text", rule: str = "most") -> DataFrame:
    """One row for each row of df and section of its text: doc_id, section, char_start, char_end, n_tokens,
    crossing.  cuts: an array of the positions (in characters) between sections."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if not spaced(tokenizer):
        raise ValueError("spans need a vocabulary that keeps the text as it is")
    id_type = df.schema[id].dataType.simpleString()
    slim = df.select(F.col(id).alias("id"), text_or_empty(text).alias("text"), F.coalesce(cuts.cast("array<bigint>"), F.array().cast("array<bigint>")).alias("cuts"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, True)
        for b in batches:
            texts, cuts = b.column(1).to_pylist(), b.column(2)
            for lo, hi in in_slices(texts):
                begin, end, tokens, crossing, sizes = [], [], [], [], []
                for i, t in enumerate(texts[lo:hi], lo):
                    inner = np.asarray(cuts[i].values.drop_null(), np.int64)
                    borders = np.r_[0, np.sort(np.clip(inner, 0, len(t))), len(t)]
                    n, c = count_sections(enc, t, borders, rule)
                    begin.append(borders[:-1]), end.append(borders[1:]), tokens.append(n), crossing.append(c), sizes.append(len(n))
                no = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
                ids = b.column(0).take(pa.array(np.repeat(np.arange(lo, hi), sizes)))
                cols = [pa.array(np.concatenate(x), pa.int64()) for x in (begin, end, tokens, crossing)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(no), *cols], ["doc_id", "section", "char_start", "char_end", "n_tokens", "crossing"])

    return slim.mapInArrow(count, f"doc_id {id_type}, section int, char_start bigint, char_end bigint, n_tokens bigint, crossing bigint")


def field_token_counts(df: DataFrame, fields: dict[str, Column], tokenizer: str, id: str = "doc_id", separator: str = " ", rule: str = "most") -> DataFrame:
    """One row for each row of df and field: doc_id, field_no, field, char_start, char_end,
    n_tokens, crossing.  fields: name -> string expression over df, in text order."""
    values = [F.coalesce(c.cast("string"), F.lit("")) for c in fields.values()]
    slim = df.select(F.col(id).alias("id"), *(v.alias(f"f{i}") for i, v in enumerate(values)))
    parts = [F.col(f"f{i}") if i == 0 else F.concat(F.lit(separator), F.col(f"f{i}")) for i in range(len(values))]
    size, cuts = F.lit(0), []
    for p in parts[:-1]:
        size = size + F.length(p)
        cuts.append(size)
    laid = slim.select("id", F.concat(*parts).alias("text"), (F.array(*cuts) if cuts else F.array()).cast("array<bigint>").alias("cuts"))
    out = section_token_counts(laid, F.col("cuts"), tokenizer, "id", "text", rule)
    name = F.element_at(F.array(*map(F.lit, fields)), F.col("section") + 1)
    return out.select("doc_id", F.col("section").alias("field_no"), name.alias("field"), "char_start", "char_end", "n_tokens", "crossing")


def document_sections(text: str = "text", size: int = 1000) -> Column:
    """Positions between the title (the first line with its line feed) and passages of ``size`` characters,
    which take no heed of words."""
    n = F.length(text_or_empty(text))
    title = F.instr(text_or_empty(text), "\n")
    after = F.when(title + size < n, F.sequence(title + size, n - 1, F.lit(size)))
    return F.concat(F.when((title > 0) & (title < n), F.array(title)).otherwise(F.array().cast("array<int>")), F.coalesce(after, F.array().cast("array<int>")))


def document_fields(text: str = "text", source: str = "source", lang: str = "lang") -> dict[str, Column]:
    """source, language, and of the text the title (its first line) and the body (the rest)."""
    line_end = F.instr(text_or_empty(text), "\n")
    title = F.when(line_end > 0, F.substring(F.col(text), F.lit(1), line_end)).otherwise(F.col(text))
    body = F.when(line_end > 0, F.substring(F.col(text), line_end + 1, F.length(text)))
    return {"source": F.col(source), "lang": F.col(lang), "title": title, "body": body}
