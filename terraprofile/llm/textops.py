"""Words and shingles of whole texts, on UTF-8 bytes inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_ROWS = 256

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
# every byte that no word of letters and digits holds becomes a space, A-Z become a-z
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space; null has none."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII bytes; null has none."""
    return text.translate(_ALNUM).split() if text else []


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds the results of few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(_ODD[0])
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(_ODD[1])
    return x ^ (x >> np.uint64(32))


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles.

    Fewer words than k count as one shingle; no words give an empty set.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(k, n)
    acc = np.full(n - width + 1, n if n < k else k, np.uint64)
    for j in range(width):
        acc = mix(acc * np.uint64(_ODD[1]) + hashes[j : n - width + 1 + j])
    return np.unique(acc)
