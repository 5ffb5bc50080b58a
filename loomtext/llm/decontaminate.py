"""Benchmark decontamination: SimHash fingerprints of item-sized windows, found by multi-index Hamming blocks.

For a benchmark item of m words, each window of m words of a document (a shorter document is one window) has a multiset
of k-word shingles; a text shorter than k words is one shingle. A shingle that occurs n times counts as n elements
(shingle, 1) .. (shingle, n), so the weighted Jaccard similarity of two multisets, sum of minima over sum of maxima, is
the plain one of two sets. A 256-bit SimHash adds up the elements' bits as +1 and -1. When a window moves on, the last
element of the shingle that leaves goes and the next one of the shingle that enters comes, so running sums over both
give the fingerprints of all windows at once. Fingerprints are cut into 8 blocks of 32 bits; if two differ in at most
RADIUS = 64 bits, some block differs in at most 8 (8 * 9 > 64), so the block tests give every item within the radius,
with no miss; of unrelated pairs 2.8 % pass them. Those within the radius are verified by their similarity.

At similarity s the angle between two such sets has a cosine of at least 2s/(1+s), 0.89 at s = 0.8: 38.8 of 256 bits are
expected to differ, with a deviation of 5.7, so radius 64 is 4.4 of those away. Windows that share less than half of the
shingles that the similarity calls for are not fingerprinted at all; they can't reach it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_batches, cut, released, shared_dir, text_rows, without
from .words import U64, inside, mix, rolling, words_of

RADIUS, BLOCKS, BITS = 64, 8, 256
#: Benchmark text that one pass over the documents holds in each task; a larger benchmark takes more passes.
PASS_BYTES = 16 << 20
_BIT = np.arange(64, dtype=np.uint64)


def elements(h: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A hash of (shingle, number); that of the first one is the shingle's own."""
    return np.where(number > 1, mix(h + number.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), h)


def numbers(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each shingle occurs in the `size` places that end with it, and in those that begin with it."""
    n = len(h)
    kind = np.unique(h, return_inverse=True)[1].astype(np.int64) * (2 * n + 2 * size + 2) + size
    place = kind + np.arange(n)
    order = np.argsort(place)
    held, at = place[order], np.empty(n, np.int64)
    at[order] = np.arange(n)
    return at - np.searchsorted(held, place - size, "right") + 1, np.searchsorted(held, place + size) - at


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 and -1 for the bits of each element."""
    parts = [mix(h + U64(i * 0xD1B54A32D192ED03 % 2**64)) for i in range(BITS // 64)]
    return np.concatenate([((p[:, None] >> _BIT) & U64(1)).astype(np.int8) * 2 - 1 for p in parts], axis=1)


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """One row of BLOCKS 32-bit words for each row of sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint32)


class Group:
    """Items of one length in words, with their fingerprints in blocks."""

    def __init__(self, m: int, k: int, members: list[tuple[int, np.ndarray]]):
        self.m, self.k = m, min(k, m)
        self.size = m - self.k + 1
        self.ids = [i for i, _ in members]
        self.counts = [Counter(h.tolist()) for _, h in members]
        own = [elements(h, numbers(h, len(h))[0]) for _, h in members]
        self.prints = np.concatenate([_fingerprints(_signs(e).sum(axis=0, dtype=np.int64)[None, :]) for e in own])
        self.shingles = np.unique(np.concatenate([h for _, h in members]))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for every two fingerprints within the radius."""
        hit = np.zeros((len(prints), len(self.prints)), bool)
        for b in range(BLOCKS):
            hit |= np.bitwise_count(prints[:, b, None] ^ self.prints[None, :, b]) <= RADIUS // BLOCKS
        w, i = np.nonzero(hit)
        near = np.bitwise_count(prints[w] ^ self.prints[i]).sum(axis=1) <= RADIUS
        return w[near], i[near]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    low = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return low / (sum(a.values()) + sum(b.values()) - low)


class Index:
    """All items, by length; and which shingles any item has."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            h = words_of(pa.array([text])).hashes
            if len(h):
                by.setdefault(len(h), []).append((item, rolling(h, min(k, len(h)))))
        self.groups = [Group(m, k, members) for m, members in sorted(by.items())]
        self.ks = sorted({g.k for g in self.groups})
        self.known = {n: np.unique(np.concatenate([g.shingles for g in self.groups if g.k == n])) for n in self.ks}
        self.first = {n: np.zeros(1 << 20, bool) for n in self.ks}
        for n in self.ks:
            self.first[n][(self.known[n] >> U64(44)).astype(np.int64)] = True

    def shared(self, h: np.ndarray, n: int) -> np.ndarray:
        """Places of shingles that some item has."""
        at = np.flatnonzero(self.first[n][(h >> U64(44)).astype(np.int64)])
        known = self.known[n]
        return at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]


def _matches(g: Group, h: np.ndarray, threshold: float) -> dict[int, tuple[float, int]]:
    """Of one document's shingles: item index to its best similarity and the first window that has it."""
    size = min(g.size, len(h))
    own = g.shingles[np.minimum(np.searchsorted(g.shingles, h), len(g.shingles) - 1)] == h
    runs = np.concatenate([[0], np.cumsum(own)])
    need = threshold / (1 + threshold) * (size + g.size) / 2
    starts = np.flatnonzero(runs[size:] - runs[:-size] >= need)
    best: dict[int, tuple[float, int]] = {}
    if not len(starts):
        return best
    for part in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
        for a in range(0, len(part), 1024):
            some = part[a : a + 1024]
            lo, hi = int(some[0]), int(some[-1]) + size
            come, go = numbers(h[lo:hi], size)
            sums, left = np.zeros((hi - lo + 1, BITS), np.int32), np.zeros((hi - lo + 1, BITS), np.int32)
            np.cumsum(_signs(elements(h[lo:hi], come)), axis=0, out=sums[1:])
            np.cumsum(_signs(elements(h[lo:hi], go)), axis=0, out=left[1:])
            w, items = g.candidates(_fingerprints(sums[some - lo + size] - left[some - lo]))
            for i in np.unique(items).tolist():
                places = some[w[items == i]]
                # An upper bound first: shingles at places whose shingle the item has.
                member = np.isin(h[lo:hi], np.fromiter(g.counts[i], np.uint64, len(g.counts[i])))
                have = np.concatenate([[0], np.cumsum(member)])
                most = have[places - lo + size] - have[places - lo]
                order = np.argsort(-most, kind="stable")
                for j in order.tolist():
                    low = min(int(most[j]), g.size)
                    bound = low / (size + g.size - low)
                    if bound < threshold or i in best and bound < best[i][0]:
                        break
                    p = int(places[j])
                    s = weighted_jaccard(Counter(h[p : p + size].tolist()), g.counts[i])
                    if s >= threshold and (i not in best or (-s, p) < (-best[i][0], best[i][1])):
                        best[i] = (s, p)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of each document for each item it contains.

    Among equal windows the first. Null and empty texts and items contain and match nothing. A-Z count as a-z. Repeated
    rows give repeated results; columns other than those named play no part. Documents aren't shuffled. The benchmark
    travels with the tasks, in passes of at most PASS_BYTES.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    passes = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES
    out = None
    for i in range(passes):
        got = [tuple(r) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == i).collect()]
        found = _one_pass(text_rows(docs, id_col, text_col), got, threshold, k)
        out = found if out is None else out.unionByName(found)
    return out


def _one_pass(rows: DataFrame, items: list[tuple[int, str]], threshold: float, k: int) -> DataFrame:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, k)
        for b in batches:
            w = words_of(b.column(1))
            ids = b.column(0).to_pylist()
            out: list[tuple] = []
            for n in index.ks:
                h = rolling(w.hashes, n)
                hits = index.shared(h, n)
                hits = hits[inside(w.first, n)[hits]]
                docs = np.unique(np.searchsorted(w.first, hits, "right") - 1)
                for d in docs.tolist():
                    a, e = int(w.first[d]), int(w.first[d + 1])
                    own = h[a : e - n + 1]
                    mine = np.unique(own[hits[(hits >= a) & (hits < e)] - a])
                    for g in index.groups:
                        if g.k == n and np.isin(mine, g.shingles, assume_unique=True).any():
                            out += [(ids[d], g.ids[i], s, p, min(g.m, e - a)) for i, (s, p) in sorted(_matches(g, own, threshold).items())]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return rows.mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long, n_words long")


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that contain a benchmark item, with all columns; rows with null ids stay."""
    found = contaminated(docs, benchmark, threshold, k, id_col, text_col).select(F.col("doc_id").alias("__hit")).where("__hit is not null")
    found = cut(found, f"{shared_dir(docs.sparkSession)}/contaminated")
    return without(docs, found.distinct(), docs[id_col].cast("long") == found["__hit"], found.count())
