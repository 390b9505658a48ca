"""Whole-text encoding with a public tokenizer, one distinct unit of text at a time.

The pre-tokenizers of the vocabularies used here never let a token span a visible character and
the white space after it, nor a plain letter and the punctuation (but for an apostrophe) after it.  Cutting there therefore
changes no id: a text's ids are the ids of its units, one after the other.  Each distinct unit is
encoded by the tokenizers library once and remembered, in a memory of bounded size; a unit of plain
letters is one pre-token and goes to the library's model directly.  Texts with white space outside
ASCII, and texts that hold the string of an added token, are encoded whole.  Where white space is kept,
many texts are encoded together: their units become a dictionary column, whose distinct values alone
are encoded, the plain ones in a few calls; those last met are remembered as columns, up to a number of
bytes.  The tests compare with
whole-text encoding.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_ASCII = r" \n\t\r\f\v"
#: Where white space is kept it belongs to what follows it, and a single line feed stands alone.
SPACED = re.compile(rf"\n(?=[^{_ASCII}])|[{_ASCII}]*[^{_ASCII}]+|[{_ASCII}]+")
#: The units among these that are neither a line feed nor a word after at most one space.
ODD = re.compile(rf"[{_ASCII}](?:[{_ASCII}]+[^{_ASCII}]*|\Z)|[\t\r\f\v][^{_ASCII}]*")
#: Plain letters, then ASCII punctuation; an apostrophe may begin a contraction and is left out.
WORD = re.compile(rf"([{_LETTERS}]+)([!-&(-/:-@\[-`{{-~]*)")
#: The same after at most one space, for Arrow.
STEM = rf"^(?P<stem> ?[{_LETTERS}]+)(?P<tail>[!-&(-/:-@\[-`{{-~]*)$"
#: Stems in a call of the library; bytes of those that are remembered, and how many for each of a slice.
AT_ONCE, KNOWN_BYTES, KNOWN_TIMES = 2000, 8 << 20, 8
_ODD_ASCII = ("\t", "\r", "\f", "\v", "  ", " \n", "\n ", "\n\n")
_OTHER_SPACE = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))) + "]")


def byte_letters() -> dict[int, str]:
    """How byte-level models write a byte: as itself where Latin-1 shows it, else past 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memory(dict):
    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most = make, most

    def __missing__(self, unit: str) -> bytes:
        ids = self.make(unit)
        if len(self) >= self.most:
            self.clear()
        self[unit] = ids
        return ids


class UnitEncoder:
    def __init__(self, path: str, spaced: bool, most: int = 800_000):
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # case is ignored, as some vocabularies look for them in lower-cased text
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.marks = sorted({re.match(r"[\W\d_]*", c)[0] for c in added})
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.spaced, self.letters = spaced, byte_letters()
        self.first = _Memory(lambda u: self._unit("", u, self.first), most // 4 if spaced else most)
        self.rest = _Memory(lambda u: self._unit(" ", u, self.rest), most)
        self.spans = _Memory(self._offsets, most // 16)
        # a tokenizer of plain units between line feeds, and the bytes of each of its tokens
        self.plain = Tokenizer(self.model)
        self.plain.pre_tokenizer = CharDelimiterSplit(self.letters[ord("\n")])
        vocab = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes[list(vocab.values())] = list(map(len, vocab))
        self.known = pa.array([], pa.string()), pa.array([], pa.binary())

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def pack(self, ids: list[int]) -> bytes:
        if sys.byteorder == "little":
            return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()
        return np.array(ids, self.dtype).tobytes()

    def _unit(self, lead: str, unit: str, memory: _Memory) -> bytes:
        m = WORD.fullmatch(unit)
        if not m:
            return self.whole(lead + unit)
        if m[2]:
            return memory[m[1]] + self.first[m[2]]
        text = lead + (unit if self.spaced else unit.lower())
        tokens = self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))
        return self.pack([t.id for t in tokens])

    def _unsplit(self, text: str) -> bool:
        """Whether a token of the text may span its units."""
        if not text.isascii() and _OTHER_SPACE.search(text) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return True
        return any(m in text for m in self.marks) and bool(self.added.search(text))

    def _parts(self, text: str) -> list[bytes]:
        if self._unsplit(text):
            return [self.whole(text)]
        first, rest = self.first.__getitem__, self.rest.__getitem__
        if not self.spaced:
            return list(map(first, text.split()))
        if text[0] in " \n" or text[-1] in " \n" or any(c in text for c in _ODD_ASCII):
            return list(map(first, SPACED.findall(text)))
        parts, feed = [], first("\n")
        for line in text.split("\n"):
            words = line.split(" ")
            parts.append(first(words[0]))
            parts += map(rest, words[1:])
            parts.append(feed)
        return parts[:-1]

    def units(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The characters and the tokens of each unit, in text order; white space must be kept."""
        if self._unsplit(text):
            parts, sizes = [self.whole(text)], np.array([len(text)])
        else:
            parts, sizes, at = [], [], 0
            for m in ODD.finditer(text):
                self._plain(text[at : m.start()], parts, sizes)
                parts.append(self.first[m[0]])
                sizes.append(np.array([len(m[0])]))
                at = m.end()
            self._plain(text[at:], parts, sizes)
            sizes = np.concatenate(sizes)
        return sizes, np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize

    def _plain(self, text: str, parts: list[bytes], sizes: list[np.ndarray]) -> None:
        """Adds the units of a text with single spaces and line feeds, none of them at its end."""
        if not text:
            return
        lengths, bare, begin, feed, rest = [], [], len(parts), self.first["\n"], self.rest.__getitem__
        for line in text.split("\n"):
            words = line.split(" ")
            bare.append(len(parts) - begin)
            parts.append(self.first[words[0]])
            parts += map(rest, words[1:])
            parts.append(feed)
            lengths += map(len, words)
            lengths.append(0)
        parts.pop()
        # a space comes before every word but the first of a line, and a line feed is one character
        size = np.array(lengths[:-1], np.int64) + 1
        size[bare] -= 1
        sizes.append(size)

    def _offsets(self, unit: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(unit, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)

    def offsets(self, unit: str) -> np.ndarray:
        """The spans of a unit's tokens, remembered for short units."""
        return self.spans[unit] if len(unit) <= 64 else self._offsets(unit)

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """The ids of each text, then ``end``, as little-endian integers of ``dtype``."""
        tail = np.array([end], self.dtype).tobytes()
        if not self.spaced:
            return [b"".join(self._parts(t)) + tail if t else tail for t in texts]
        out, together = [tail] * len(texts), []
        for i, t in enumerate(texts):
            if not t:
                continue
            if t[0] in " \n" or t[-1] in " \n" or any(c in t for c in _ODD_ASCII) or self._unsplit(t):
                out[i] = b"".join(self._parts(t)) + tail
            else:
                together.append(i)
        if together:
            for i, ids in zip(together, self._together([texts[i] for i in together]), strict=True):
                out[i] = ids + tail
        return out

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts with single spaces and line feeds, none of them at an end.  A unit begins at a
        space, at a line feed and after it."""
        column = pa.array(texts, pa.string())
        edges, n = np.frombuffer(column.buffers()[1], np.int32), len(texts)
        data = np.frombuffer(column.buffers()[2], np.uint8)[: edges[n]]
        feed = data == 10
        begin = feed | (data == 32)
        begin[1:] |= feed[:-1]
        begin[edges[:n]] = True
        at = np.r_[np.flatnonzero(begin), len(data)].astype(np.int32)
        units = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), column.buffers()[2]).dictionary_encode()
        ids = self._distinct(units.dictionary).take(units.indices)
        cuts = np.frombuffer(ids.buffers()[1], np.int32)[np.searchsorted(at, edges[: n + 1])].tolist()
        raw = memoryview(ids.buffers()[2])
        return (bytes(raw[s:e]) for s, e in pairwise(cuts))

    def _distinct(self, units: pa.StringArray) -> pa.BinaryArray:
        found = pc.extract_regex(units, STEM)
        stems, tails = (pc.struct_field(found, name).dictionary_encode() for name in ("stem", "tail"))
        marks = pa.array([self.whole(t) if t else b"" for t in tails.dictionary.to_pylist()], pa.binary())
        ids = pc.binary_join_element_wise(self._remembered(stems.dictionary).take(stems.indices), marks.take(tails.indices), pa.scalar(b"", pa.binary()))
        other = pc.is_null(ids)
        return pc.replace_with_mask(ids, other, pa.array([self.whole(u) for u in units.filter(other).to_pylist()], pa.binary()))

    def _remembered(self, stems: pa.StringArray) -> pa.BinaryArray:
        # a slice looks among as many as are worth it, so that small slices do not pay for large columns
        known, known_ids = (x[: KNOWN_TIMES * len(stems)] for x in self.known)
        at = pc.index_in(stems, value_set=known)
        new = pc.is_null(at)
        at, new_at = at.fill_null(0).to_numpy().copy(), np.flatnonzero(new.to_numpy(zero_copy_only=False))
        unmet = np.ones(len(known), bool)
        unmet[np.delete(at, new_at)] = False
        at[new_at] = len(known) + np.arange(len(new_at))
        ids = pa.concat_arrays([known_ids, self._stems(stems.filter(new))]).take(pa.array(at))
        known, known_ids = (pa.concat_arrays([x, y.filter(pa.array(unmet))]) for x, y in ((stems, known), (ids, known_ids)))
        most = int(np.searchsorted(np.cumsum(pc.binary_length(known).to_numpy()), KNOWN_BYTES, "right"))
        self.known = known[:most], known_ids[:most]
        return ids

    def _stems(self, stems: pa.StringArray) -> pa.BinaryArray:
        """Each is one pre-token.  As tokens are pieces of the text, their bytes tell where a stem ends."""
        lists = pa.ListArray.from_arrays(pa.array([*range(0, len(stems), AT_ONCE), len(stems)], pa.int32()), stems)
        ids = [np.zeros(0, self.dtype)]
        for text in pc.binary_join(lists, "\n").to_pylist():
            shown = text.encode().decode("latin-1").translate(self.letters)
            ids.append(np.array(self.plain.encode_batch_fast([shown], add_special_tokens=False)[0].ids, self.dtype))
        ids = np.concatenate(ids)
        ends, stem_ends = np.cumsum(self.bytes[ids]), np.cumsum(pc.binary_length(stems).to_numpy())
        cuts = np.searchsorted(ends, stem_ends) + 1
        if len(ids) != (cuts[-1] if len(cuts) else 0) or (ends[cuts - 1] != stem_ends).any():
            raise ValueError("the tokens of the vocabulary do not add up to the text")
        offsets = (np.r_[0, cuts] * self.dtype.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(stems), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> UnitEncoder:
    """The worker's own; it lives as long as the worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitEncoder(path, spaced)


def spaced(path: str) -> bool:
    """Whether the vocabulary keeps white space; asked of the tokenizer itself."""
    t = Tokenizer.from_file(path)
    return t.encode("a b", add_special_tokens=False).ids != t.encode("a  b", add_special_tokens=False).ids


def in_slices(texts: list, weight: int = 2_000_000):
    """Index ranges of the list with about ``weight`` characters each."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= weight:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def sized_slices(column: pa.Array, weight: int):
    """Even index ranges of a column of texts with at most about ``weight`` bytes each; no text becomes a
    Python string."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, weight = 0, max(1, -(-int(ends[-1]) // -(-int(ends[-1]) // weight))) if len(ends) and ends[-1] else weight
    while start < len(ends):
        end = min(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + weight)) + 1, len(ends))
        yield start, end
        start = end
