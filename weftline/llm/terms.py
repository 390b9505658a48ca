"""Terms of search and decontamination: runs of digits, letters and all that is not ASCII, with A-Z
lower-cased.  UTF-8 keeps ASCII apart, so bytes can be split."""

from __future__ import annotations

import re

#: Every byte as it counts in a term, or a blank if it ends one.
AS_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
TERM = re.compile(rb"[^ ]+")


def terms(text: bytes) -> list[bytes]:
    return text.translate(AS_TERM).split()


def term_spans(text: bytes) -> list[tuple[int, int]]:
    """Where each term begins and ends in the bytes."""
    return [m.span() for m in TERM.finditer(text.translate(AS_TERM))]
