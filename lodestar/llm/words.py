"""Whitespace words of a UTF-8 text and hashes of words and word windows.

A word is a run of bytes other than space and 0x09-0x0D, so the words are those of
``[^\\x20\\x09-\\x0D]+`` on the decoded text. A word's hashes are the halves of the XXH3-128 of its
bytes. The hash of every window of a size comes from those of two windows of a power of two that cover
it, and theirs from two halves each, with a multiplication and a shift after every step; so no sum of
powers stands behind it that chosen sequences could cancel out. Single stretches, of any length, are
hashed by XXH3 over their words' hashes.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest, xxh3_128_digest, xxh3_128_intdigest

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd factor by which the left half of a window differs from the right one.
_LEFT = np.uint64(0x9E3779B97F4A7C15)


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of data."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_pairs(data: bytes) -> np.ndarray:
    """Both 64-bit hashes of each word, one word a row."""
    words = data.split()  # bytes.split() parts at the same six bytes
    return np.frombuffer(b"".join(map(xxh3_128_digest, words)), dtype=np.uint64).reshape(-1, 2)


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word."""
    words = data.split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _LEFT
    out += right
    out ^= out >> np.uint64(32)
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of size words; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    half, width = words, 1
    while 2 * width <= size:
        half, width = _joined(half[:-width], half[width:]), 2 * width
    return mix(_joined(half[:n], half[size - width : size - width + n]) if width < size else half)


def _stretches(words: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    view, width = memoryview(np.ascontiguousarray(words)).cast("B"), words.itemsize * words[0].size
    return (view[a:b] for a, b in zip((starts * width).tolist(), (ends * width).tolist(), strict=True))


def stretch_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each stretch of words (hashes or pairs of them) from starts to ends (not included)."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    return np.fromiter(map(xxh3_64_intdigest, _stretches(words, starts, ends)), np.uint64, len(starts))


def stretch_pairs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Both 64-bit hashes of each stretch, one stretch a row."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.uint64)
    return np.frombuffer(b"".join(map(xxh3_128_digest, _stretches(words, starts, ends))), dtype=np.uint64).reshape(-1, 2)


def sequence_hash(words: np.ndarray) -> int:
    """A signed 128-bit hash of the whole word sequence, from the words' hashes (any shape); 0 without words."""
    return xxh3_128_intdigest(words.tobytes()) - (1 << 127) if len(words) else 0
