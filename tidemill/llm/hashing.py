"""Hashes of words, shingles and substrings of whole texts, in numpy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the memory of a worker.  A longer text is cut between words.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers, by multiplying and folding."""
    x = np.atleast_1d(np.asarray(x, np.uint64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BASE = 0x2545F4914F6CDD1D
_UNBASE = pow(BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0..n-1, modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS, _UNPOWERS = powers(BASE, 1024), powers(_UNBASE, 1024)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _UNPOWERS
    if len(_POWERS) < n:
        _POWERS, _UNPOWERS = powers(BASE, n), powers(_UNBASE, n)
    return _POWERS, _UNPOWERS


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any substring follows."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, end), equal for equal bytes wherever they are."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    return (np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)), offsets


def _spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words (A-Z lowered) in one stretch of bytes."""
    data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    inside = np.concatenate([[False], ~_spaces(data), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    return substring_hashes(prefix_sums(data), start, end), start


def words_by_row(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each row the hashes of its words, in order."""
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi - lo <= CHUNK:
            # One space after every row keeps words of two rows apart.
            bounds = offsets[row : last + 1] - lo + np.arange(last - row + 1)
            padded = np.full(hi - lo + last - row, 32, np.uint8)
            keep = np.ones(len(padded), bool)
            keep[bounds[1:] - 1] = False
            padded[keep] = data[lo:hi]
            hashes, start = _word_hashes(padded)
            at = np.searchsorted(start, bounds)
            for i in range(last - row):
                yield hashes[at[i] : at[i + 1]]
        else:
            parts = []
            while lo < hi:
                cut = min(hi, lo + CHUNK)
                while cut < hi and not _spaces(data[cut : cut + 1])[0]:
                    cut += 1
                parts.append(_word_hashes(data[lo:cut])[0])
                lo = cut
            yield np.concatenate(parts)
        row = last


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of k consecutive words, sorted; of all words if there are fewer, none without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    h = mix(words[: len(words) - k + 1] + np.uint64(k))
    for i in range(1, k):
        h = mix(h * np.uint64(3) + words[i : len(words) - k + 1 + i])
    return np.unique(h)
