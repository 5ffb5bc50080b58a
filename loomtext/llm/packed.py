"""Columns of integers packed into compressed blobs, and tasks that read them bucket by bucket.

Shuffling hundreds of millions of small rows costs far more than the numbers in them. A map task therefore sorts what
it has by a hash, cuts it into buckets of hash ranges and sends one blob for each bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .runtime import released

_DTYPES = ["<u8", "<i8", "<u4", "<i4", "<u2", "|u1", "<f8", "<f4"]


def pack(*columns: np.ndarray, delta: int = 1) -> bytes:
    """The first `delta` columns, sorted u64, are kept as differences; all as byte planes, compressed."""
    n = len(columns[0])
    head, body = [np.array([n, len(columns), delta], "<u4").tobytes()], []
    for i, c in enumerate(columns):
        if i < delta:
            c = np.diff(c.astype("<u8"), prepend=np.uint64(0))
        kind = c.dtype.str if c.dtype.str in _DTYPES else "|u1" if c.dtype == bool else "<i8"
        c = c.astype(kind)
        head.append(bytes([_DTYPES.index(kind)]))
        body.append(np.ascontiguousarray(c.view(np.uint8).reshape(n, -1).T).tobytes() if n else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, width, delta = np.frombuffer(data[:12], "<u4").tolist()
    at, out = 12 + width, []
    for i in range(width):
        kind = np.dtype(_DTYPES[data[12 + i]])
        raw = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        at += n * kind.itemsize
        c = np.ascontiguousarray(raw.T).view(kind).reshape(n)
        out.append(np.cumsum(c, dtype=np.uint64) if i < delta else c)
    return out


def both(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def apart(blob: bytes) -> tuple[bytes, bytes]:
    n = 8 + int.from_bytes(blob[:8], "little")
    return blob[8:n], blob[n:]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so sorting by key sorts by bucket."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cuts(key: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that sorted keys fall into."""
    b = bucket_of(key, buckets)
    edges = np.flatnonzero(np.diff(b)) + 1
    for a, e in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(b)]]), strict=True):
        if e > a:
            yield int(b[a]), int(a), int(e)


def by_bucket(rows: DataFrame, spread: int, work: Callable[[int, list[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply work to the rows (bucket, ...) of each bucket; a task holds one bucket at a time."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != current:
                    if held:
                        yield from work(current, held)
                    held, current = [], row[0]
                held.append(row[1:])
        if held:
            yield from work(current, held)

    return rows.repartition(spread, rows.columns[0]).sortWithinPartitions(rows.columns[0]).mapInArrow(run, schema)
