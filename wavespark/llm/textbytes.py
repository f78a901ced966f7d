"""Vectorized word spans and hashes over Arrow batches of texts (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 2**64)
#: Bytes of texts handled at a time; one longer text is handled alone.
CHUNK_BYTES = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets in them); a null is an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as runs of bytes b with inside[b], never across rows: starts, ends, first word of each row (and the end)."""
    own = np.zeros(len(data) + 2, bool)
    own[1:-1] = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(own[1:] & (~own[:-1] | cut))
    ends = np.flatnonzero(own[:-1] & (~own[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


class Hasher:
    """Polynomial hashes of any byte ranges of one buffer, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.inverse = powers(_B_INVERSE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_B, len(data)), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


#: Which bytes belong to words: all but white space; or letters, digits and all above ASCII.
NOT_SPACE = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
WORD_LIKE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
