"""Vectorised words and word hashes straight from Arrow's string buffers.

A word is a run of characters other than U+0020 and U+0009..U+000D. Each word gets a 64-bit hash: the sum of
random values of its bytes times powers of an odd number, mixed. The same words give the same hashes in every
task of every run. Words of more than LONG bytes, for which such sums have known collisions, get a BLAKE2 digest. With w
distinct words the chance that any two share a hash is about w * w / 2**60; a second, independent hash makes it 2**124.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES, _OTHER = (np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1) for seed in (20240501, 20240502))
LONG = 64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93 | 1
_Q_INV = pow(_Q, -1, 1 << 64)
_CHUNK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept for the next call up to the chunk's length."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        out = np.ones(max(n, 1 << 12), U64)
        out[1:] = U64(base)
        got = np.multiply.accumulate(out)
        if len(got) <= 2 * _CHUNK:
            _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of a batch: buf[starts[i]:ends[i]] is word i; first[d]:first[d+1] are those of document d."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def spans_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """buf, starts, ends and first of the words, without hashes."""
    buf, offsets = raw(column)
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    space = _SPACE[buf]
    before = np.empty(n, bool)
    before[:1] = True
    before[1:] = space[:-1]
    after = np.empty(n, bool)
    after[n - 1 :] = True
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return buf, starts, ends, np.searchsorted(starts, offsets)


def words_of(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> Words:
    """lower: A-Z count as a-z (in the hashes; buf stays as it is)."""
    buf, starts, ends, first = spans_of(column)
    return Words(buf, starts, ends, first, _hash(buf, starts, ends, lower))


def second_hashes(w: Words, lower: bool = True) -> np.ndarray:
    """Hashes of the same words, independent of the first ones."""
    return _hash(w.buf, w.starts, w.ends, lower, _OTHER)


def _hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, values: np.ndarray = _BYTES) -> np.ndarray:
    return hash_each(buf, [(starts, ends)], lower, values)[0]


def hash_each(buf: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], lower: bool = True, values: np.ndarray = _BYTES) -> list[np.ndarray]:
    """Hashes of the words that the first spans are, and of their parts that the others are; bytes are weighed once for all."""
    table = values[_LOWER] if lower else values
    starts, ends = spans[0]
    out = [np.empty(len(s), U64) for s, _ in spans]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK)))
        a, b = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(table[buf[a:b]] * powers(_P, b - a), out=sums[1:])
        for got, (first, last) in zip(out, spans, strict=True):
            x, y = np.searchsorted(first, [a, b])
            s, e = first[x:y] - a, last[x:y] - a
            got[x:y] = (sums[e] - sums[s]) * powers(_P_INV, b - a)[s] + (e - s).astype(U64)
        i = j
    out = [mix(got) for got in out]
    for got, (first, last) in zip(out, spans, strict=True):
        for i in np.flatnonzero(last - first > LONG).tolist():
            word = buf[first[i] : last[i]]
            salt = int(values[0]).to_bytes(8, "little")
            got[i] = int.from_bytes(blake2b((_LOWER[word] if lower else word).tobytes(), digest_size=8, salt=salt).digest(), "little")
    return out


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words (across documents too: see inside()); at most len - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if k <= 8:
        out = hashes[:n].copy()
        for i in range(1, k):
            out *= U64(_Q)
            out += hashes[i : i + n]
        return mix(out)
    out = np.empty(n, U64)
    for a in range(0, n, _CHUNK // 4):
        b = min(n, a + _CHUNK // 4)
        part = hashes[a : b + k - 1]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * powers(_Q, len(part)), out=sums[1:])
        out[a:b] = (sums[k : k + b - a] - sums[: b - a]) * powers(_Q_INV, b - a)
    return mix(out)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which of rolling()'s windows lie within one document."""
    total = int(first[-1])
    ok = np.ones(max(total - k + 1, 0), bool)
    for d in range(1, k):
        at = first[1:-1] - d
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok
