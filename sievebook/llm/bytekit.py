"""Vectorised primitives over UTF-8 bytes, shared by the text operators.

Texts reach Python as Arrow batches; everything here works on the raw byte
buffer of a few texts at a time, so that memory follows ``CHUNK`` and the
longest single text, never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240607))
#: One random odd number for each byte, the digits of the polynomial hash.
DIGITS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
LOWER_DIGITS = DIGITS[_LOWER]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (a new array)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        for name, step in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, step, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; row i is bytes[offsets[i]:offsets[i+1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) over runs of rows of at most ``limit`` bytes; a longer row comes alone."""
    data, offsets = text_buffer(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; runs do not cross rows."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    edge = inside[1:] != inside[:-1]
    if len(offsets) > 2:  # a row that ends in a word byte beside one that starts with one
        cut = offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        cut = cut[inside[cut] & inside[cut + 1]]
        starts = np.flatnonzero(edge & inside[1:])
        ends = np.flatnonzero(edge & inside[:-1])
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        return starts, ends
    return np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], by differences of one running polynomial sum, in segments of bounded size."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK, "right")))
        hi = int(ends[j - 1])
        up, down = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(digits[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s = starts[i:j] - lo
        out[i:j] = (total[ends[i:j] - lo] - total[s]) * down[s]
        i = j
    out += (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    return mix(out)


def row_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offsets, starts, "right") - 1


_LANES = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words of one row; a row with fewer words, but some, gives its whole sequence."""
    counts = np.bincount(rows, minlength=n_rows)
    m = len(words) - k + 1
    if m > 0:
        total = words[:m] * _LANES[0]
        for j in range(1, k):
            total += words[j : m + j] * _LANES[j]
        keep = rows[:m] == rows[k - 1 :]
        hashes, owner = mix(total[keep]), rows[:m][keep]
    else:
        hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        at = np.concatenate([[0], np.cumsum(counts)])
        extra = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            w = words[at[r] : at[r + 1]]
            extra[i] = np.append(w * _LANES[: len(w)], _LANES[62:63] * _U(len(w))).sum(dtype=np.uint64)
        hashes, owner = np.concatenate([hashes, mix(extra)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def distinct_by_row(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row, and where each row's begin (n_rows + 1 positions); rows is ascending."""
    at = np.searchsorted(rows, np.arange(n_rows + 1))
    hashes = hashes.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            hashes[a:b].sort()
    if not len(hashes):
        return hashes, np.zeros(n_rows + 1, np.int64)
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    inner = at[(at > 0) & (at < len(hashes))]
    keep[inner] = True
    return hashes[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def byte_set(*ranges: tuple[int, int], invert: bool = False) -> np.ndarray:
    """Membership of each byte value in the given closed ranges."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return ~out if invert else out


#: Words between ASCII white space.
SPACED = byte_set((0x20, 0x20), (0x09, 0x0D), invert=True)
#: Words of digits, small letters and everything beyond ASCII; capitals count as small letters.
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
