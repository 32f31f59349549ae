"""Byte 4-grams of texts as uint32 codes, computed for many texts at once."""

from __future__ import annotations

import re

import numpy as np

from .common import slices

#: Bytes of text turned into grams at a time, which bounds a task's memory.
SLICE_BYTES = 1 << 20
LETTERS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
SPACES = re.compile(rb" +")
DIGITS = bytes(48 if 48 <= b <= 57 else b for b in range(256))


def letter_bytes(text: str | None) -> bytes:
    """Lower-cased UTF-8 in which every run of ASCII non-letters is one space, with a space before and two after."""
    return b" " + SPACES.sub(b" ", (text or "").lower().encode("utf-8", "replace").translate(LETTERS)).strip() + b"  "


def plain_bytes(text: str | None) -> bytes:
    """UTF-8 with digits as 0 and white space as single spaces, framed the same way."""
    return b" " + b" ".join((text or "").encode("utf-8", "replace").translate(DIGITS).split()) + b"  "


def grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ends): the 4-grams of all parts end to end, and where those of each part end. A part has at least 3 bytes."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"".join(parts), np.uint8)
    if len(raw) < 4:
        return np.zeros(0, np.uint32), np.zeros(len(parts), np.int64)
    wide = raw.astype(np.uint32)
    codes = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    keep = np.ones(len(raw), dtype=bool)
    ends = np.cumsum(sizes)
    for back in (1, 2, 3):
        keep[ends - back] = False
    return codes[keep[: len(codes)]], np.cumsum(sizes - 3)


def sliced(parts: list[bytes], most: int = SLICE_BYTES):
    """(first part, codes, ends) by slices of bounded size."""
    for a, b in slices([len(x) for x in parts], most):
        yield a, *grams(parts[a:b])


def sums_by(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of values within each part."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])
