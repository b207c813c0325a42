"""Vectorised work on batches of texts as one byte array: word edges, rolling hashes, batches of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
HASH_BYTES = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads low and high bits."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(29)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(32)
    return x


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1B54A32D192ED03))


BYTE = _byte_values()
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n at least; the longest table up to 1 << 23 is kept."""
    size = 1 << max(16, int(n).bit_length())
    for got in _pow.values():
        if len(got[0]) >= size:
            return got
    base = np.full(size, U(_P))
    base[0] = U(1)
    inv = np.full(size, U(_PINV))
    inv[0] = U(1)
    got = np.multiply.accumulate(base), np.multiply.accumulate(inv)
    if size <= 1 << 23:
        _pow.clear()
        _pow[size] = got
    return got


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int):
    """Runs of documents of about `most` bytes each; a longer document is a run of its own."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_table(is_word) -> np.ndarray:
    """256 flags from a predicate on a byte."""
    return np.array([bool(is_word(b)) for b in range(256)])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def edges(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of flagged bytes within a document."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = table[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    at = offs[:-1]
    before[at[at < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    at = offs[1:] - 1
    after[at[at >= 0]] = False
    return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each run: a polynomial from prefix sums, moved to position 0, then mixed with the length."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # runs of about HASH_BYTES at a time, so that powers and sums stay small
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + HASH_BYTES)))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        pw, inv = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTE[data[lo:hi]] * pw[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64) * U(0xA0761D6478BD642F))
        i = j
    return out


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words (k shorter than the array gives an empty result)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    mult = U(0xE7037ED1A0B428DB)
    for j in range(k):
        out = out * mult + words[j : j + n]
    return mix(out)


def blob(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string; unblob() with the same types gets them back."""
    head = np.array([len(a) for a in arrays], np.uint32).tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unblob(raw: bytes, *types) -> list[np.ndarray]:
    sizes = np.frombuffer(raw, np.uint32, len(types))
    out, at = [], 4 * len(types)
    for n, t in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw, t, int(n), at))
        at += int(n) * np.dtype(t).itemsize
    return out


def small(batches, rows: int = 1000):
    """Arrow batches in slices of at most `rows` rows, so that what is copied out of a batch stays small."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)
