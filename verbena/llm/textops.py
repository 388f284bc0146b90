"""Vectorised text kernels on Arrow string buffers.

The corpus operators work on the bytes of a whole Arrow batch at once: words
are found with one pass over the byte buffer and hashed with a polynomial
prefix sum, so no Python string is made for a word.  A *word* is a maximal run
of bytes other than ASCII white space (space, tab, LF, VT, FF, CR); words are
compared in lower case.  Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (the public splitmix64 one)."""
    x = x.astype(np.uint64, copy=True)
    t = x >> np.uint64(30)
    x ^= t
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64, kept by the process."""
    kept = getattr(np, "_verbena_powers", None)
    if kept is None or len(kept[0]) < n:
        size = 1 << int(n - 1).bit_length()
        kept = []
        for base in (_BASE, _BASE_INV):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            kept.append(np.multiply.accumulate(out))
        if size <= 1 << 20:
            np._verbena_powers = kept
    return kept[0][:n], kept[1][:n]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a string column; nulls are empty strings."""
    raw, _ = string_bytes(column)
    sizes = np.asarray(pc.fill_null(pc.utf8_length(column), 0), dtype=np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum(sizes)))


def lower(column: pa.Array) -> pa.Array:
    """Lower case by code point."""
    return pc.utf8_lower(column)


def spans(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which keep holds, never across rows: (start, end, row)."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inside = keep[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[row_starts] = inside[row_starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[row_starts[1:] - 1] = inside[row_starts[1:] - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, window: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes wherever they stand.

    Starts and ends must both be in ascending order.
    """
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, lo + window)))
        hi = int(end[j - 1])
        power, inverse = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix64(out)


def word_counts(column: pa.Array) -> np.ndarray:
    """The number of words of each row."""
    raw, offsets = string_bytes(column)
    black = ~_SPACE[raw]
    first = black.copy()
    first[1:] &= ~black[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = black[starts]
    total = np.concatenate(([0], np.cumsum(first, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-case word, offsets of the rows' words)."""
    raw, offsets = string_bytes(lower(column))
    start, end, row = spans(raw, offsets, ~_SPACE)
    return span_hashes(raw, start, end), np.searchsorted(row, np.arange(len(column) + 1))


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every n-gram of words; a row of 1 to n - 1 words gives one gram of all of them."""
    count = np.diff(offsets)
    if len(hashes) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    grams = np.where(count >= n, count - n + 1, 0)
    row = np.repeat(np.arange(len(count)), grams)
    first = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(grams)[:-1])), grams) + np.arange(len(row))
    value = np.zeros(len(row), dtype=np.uint64)
    for k in range(n):
        value = value * np.uint64(0xD6E8FEB86659FD93) + hashes[first + k]
    value = mix64(value)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        odd = np.empty(len(short), dtype=np.uint64)
        for i, r in enumerate(short):
            v = int(count[r])
            for h in hashes[offsets[r] : offsets[r + 1]]:
                v = (v * 0xD6E8FEB86659FD93 + int(h)) & 0xFFFFFFFFFFFFFFFF
            odd[i] = v
        value, row = np.concatenate((value, mix64(odd))), np.concatenate((row, short))
    return value, row
