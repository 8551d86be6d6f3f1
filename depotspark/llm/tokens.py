"""Words of whole Arrow batches as 64-bit hashes, without a Python loop over words.

A word's hash is a sum of random byte values times powers of an odd base modulo 2**64, taken from prefix sums and
brought back to power 0 by the inverse base, then mixed. Two different words meet with probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: White space and ASCII punctuation: words of letters, digits and what isn't ASCII.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]  # A-Z as a-z
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
            up[0] = down[0] = 1
            _powers.update(n=size, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, at least one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start, n = 0, len(texts)
    while start < n:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield start, end
        start = end


def words(texts: pa.Array, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end, bytes of each word); null texts are empty. gaps: for each byte, whether it parts words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    at = at - at[0]
    if not raw.size:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
    gap = gaps[raw]
    edge = np.zeros(raw.size + 1, dtype=bool)
    edge[at] = True
    prev, nxt = np.empty(raw.size, bool), np.empty(raw.size, bool)
    prev[0], prev[1:] = True, gap[:-1]
    nxt[-1], nxt[:-1] = True, gap[1:]
    start = np.flatnonzero(~gap & (prev | edge[:-1]))
    end = np.flatnonzero(~gap & (nxt | edge[1:])) + 1
    up, down = _tables(raw.size + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(raw.size + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_VALUES[raw] * up[: raw.size], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, at), end - start


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of k-word shingles of each row; with fewer words, the whole sequence as one."""
    mult = [_U(0x9E3779B97F4A7C15 + 2 * 0x1B873593 * i | 1) for i in range(k)]
    n = h.size
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, n - k + 1), dtype=np.uint64)
        for i in range(k):
            full += h[i : n - k + 1 + i] * mult[i] if n >= k else 0
        full = mix(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        m = b - a
        if m >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif m:
            with np.errstate(over="ignore"):
                one = np.array([m], dtype=np.uint64)
                for i in range(m):
                    one = mix(one + h[a + i : a + i + 1] * mult[i])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
