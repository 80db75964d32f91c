"""Terms of UTF-8 texts for use inside tasks: runs of bytes that are no separators.

Separators are ASCII only and A-Z are lower-cased as bytes, so a term is always whole
characters. A long text is handled in pieces that are cut at separators; memory stays
at one piece and what a caller keeps of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

PIECE = 1 << 20

#: fixed values: letters and digits, or letters alone, with everything outside ASCII
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def pieces(raw: bytes, pattern: re.Pattern) -> Iterator[list[bytes]]:
    """Lists of the terms of a text, in order; short texts make one list."""
    raw = raw.lower()
    if len(raw) <= PIECE:
        yield pattern.findall(raw)
        return
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        met = pattern.match(raw, end - 1) if end < len(raw) else None
        end = met.end() if met else end  # a term that the cut would split goes with this piece
        yield pattern.findall(raw, at, end)
        at = end


def binary(values: list[bytes]):
    import pyarrow as pa

    return pa.array(values, pa.binary())
