"""Words and shingles of whole Arrow batches of texts at a time, in numpy.

Texts stay UTF-8 bytes: white space is ASCII and only A-Z are lower-cased, so bytes decide both. A word's hash is a
polynomial over its bytes, read off prefix sums modulo 2**64; a shingle's hash is a polynomial over its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
#: Bytes of text that are hashed at a time; one text is never cut.
PIECE = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x.astype(U, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U(shift)
        x *= U(factor)
    return x ^ (x >> U(31))


_OF_BYTE = mix(np.arange(1, 257, dtype=U) * U(_P))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, dtype=U)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U)
    return have[:n]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = column.fill_null("").cast(pa.large_binary()) if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past, bytes, offsets) of runs of texts of about PIECE bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        past = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        yield first, past, data[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first]
        first = past


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word, and the number of words before each text and in all: len(offsets) numbers."""
    ink = ~SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    starts = np.flatnonzero(ink & (first[:-1] | np.concatenate(([True], ~ink[:-1]))))
    ends = np.flatnonzero(ink & (first[1:] | np.concatenate((~ink[1:], [True])))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum(_OF_BYTE[LOWER[data]] * powers(_P, n), dtype=U, out=sums[1:])
    inverse = pow(_P, -1, 1 << 64)
    return mix((sums[ends] - sums[starts]) * powers(inverse, n + 1)[starts] + (ends - starts).astype(U))


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Each text's set of k-word shingles as sorted distinct 64-bit hashes; a text of fewer words is one shingle, of none empty."""
    weights = powers(_Q, k)
    for first, past, data, offsets in pieces(*texts_of(column)):
        starts, ends, before = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        m = len(words)
        whole = mix(sum((words[i : max(0, m - k + 1) + i] * weights[i] for i in range(k)), np.zeros(max(0, m - k + 1), U))) if m >= k else np.zeros(0, U)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= k:
                yield np.unique(whole[a : b - k + 1])
            elif b > a:
                yield mix(np.array([(words[a:b] * weights[: b - a]).sum(dtype=U) + U(b - a)], dtype=U))
            else:
                yield np.zeros(0, U)
