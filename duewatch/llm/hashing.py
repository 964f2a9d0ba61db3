"""Vectorised word and shingle hashing over Arrow string buffers (numpy, inside tasks).

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z taken
as a-z. A word's hash is a polynomial over its bytes, read off a running sum,
so that no Python object per word is made. Buffers are handled in windows of
bounded size that end between words, so that one very long text needs no more
memory per byte than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Space and ASCII punctuation: words are then runs of letters, digits and non-ASCII characters.
PUNCTUATION = SPACE.copy()
PUNCTUATION[[c for c in range(128) if not chr(c).isalnum()]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEED = np.random.Generator(np.random.PCG64(20240601))
BYTE_CODE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_CODE[65:91] = BYTE_CODE[97:123]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and its inverses, modulo 2**64."""
    if _powers.get("up", np.empty(0)).size <= n:
        size = max(n + 1, WINDOW + 1)
        for name, step in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, step, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; :func:`span_hash` reads any substring's hash off them."""
    _, down = powers(data.size)
    out = np.empty(data.size + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_CODE[data] * down[:data.size], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, _ = powers(sums.size - 1)
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls have no bytes."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def document_groups(offsets: np.ndarray, most: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Consecutive rows [a, b) of at most ``most`` bytes together; a longer row stands alone."""
    a, n = 0, offsets.size - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def window_ends(space: np.ndarray) -> Iterator[tuple[int, int]]:
    s, n = 0, space.size
    while s < n:
        e = min(s + WINDOW, n)
        if e < n:
            back = np.flatnonzero(space[s:e])
            if back.size:
                e = s + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(space[e:])
                e = e + int(ahead[0]) + 1 if ahead.size else n
        yield s, e
        s = e


def word_spans(chunk: np.ndarray, bounds: np.ndarray,
               between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, space): the words of ``chunk``, in which rows begin and end at ``bounds``."""
    if not chunk.size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    space = between[chunk]
    edge = np.zeros(chunk.size + 1, bool)
    edge[bounds] = True
    word = ~space
    prior = np.empty(chunk.size, bool)
    prior[0], prior[1:] = True, space[:-1]
    after = np.empty(chunk.size, bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(word & (prior | edge[:-1]))
    return starts, np.flatnonzero(word & (after | edge[1:])) + 1, space


def words(data: np.ndarray, offsets: np.ndarray, a: int, b: int,
          between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of rows [a, b), and each word's row (counted from a)."""
    base = offsets[a]
    chunk = data[base:offsets[b]]
    if not chunk.size:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    starts, ends, space = word_spans(chunk, offsets[a:b + 1] - base, between)
    out = np.empty(starts.size, np.uint64)
    windows = [(0, chunk.size)] if b - a > 1 or chunk.size <= WINDOW else window_ends(space)
    for s, e in windows:
        i, j = np.searchsorted(starts, (s, e))
        if i < j:
            out[i:j] = span_hash(prefix_sums(chunk[s:e]), starts[i:j] - s, ends[i:j] - s)
    row = np.searchsorted(offsets[a:b + 1] - base, starts, "right") - 1
    return out, row.astype(np.int32)


def _chain(hashes: np.ndarray, at: np.ndarray | slice, k: int) -> np.ndarray:
    h = np.full(1, k, np.uint64)
    for j in range(k):
        part = hashes[at.start + j:at.stop + j] if isinstance(at, slice) else hashes[at + j]
        h = (h ^ part) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return mix(h)


def shingles(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in text order, and their rows.

    A row of fewer than k words has its whole sequence as one shingle; a row
    without words has none.
    """
    n = hashes.size
    parts, rows = [], []
    if n >= k:
        same = row[:n - k + 1] == row[k - 1:]
        parts.append(_chain(hashes, slice(0, n - k + 1), k)[same])
        rows.append(row[:n - k + 1][same])
    if n:
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        size = np.diff(np.r_[first, n])
        for m in range(1, k):
            if (at := first[size == m]).size:
                parts.append(_chain(hashes, at, m))
                rows.append(row[at])
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    h, r = np.concatenate(parts), np.concatenate(rows)
    if len(parts) > 1:
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r
