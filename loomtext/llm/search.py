"""Ranked lexical search: sort-based accumulation over all documents.

Terms are runs of digits, letters and bytes beyond ASCII, with A-Z as a-z. A first scan counts documents, terms and the
document frequencies of the asked terms; each task sends its sums only. A second scan scores: a task concatenates the
(item, document, impact) entries of all matched terms of a range of documents, packs item and document into one key,
sorts the keys by radix passes over 16-bit digits, adds up each key's impacts with reduceat, and keeps each item's best
in a heap. Ranges end at ENTRIES entries, so a task's memory doesn't grow with its input. The bests of all tasks, one
row for each item and task, are written, partitioned by ranges of items and selected once more.

Items travel with the tasks in blocks of about BLOCK_BYTES of text, two scans for each; documents are never shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_batches, cut, partitions, released, shared_dir, text_rows
from .words import _BYTES, _OTHER, _hash, raw

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Text of the items that one pair of scans looks for, and entries that a task sorts at once.
BLOCK_BYTES, ENTRIES = 4 << 20, 2_000_000
#: A null doc_id ranks as this one.
LAST = (1 << 63) - 1
RANKED = "item_id long, rank int, doc_id long, score long"


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where each term begins, where it ends, each text's first term and the number of all)."""
    buf, offsets = raw(column)
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = _TERM[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return buf, starts, ends, np.searchsorted(starts, offsets)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts unsigned keys: stable passes over 16-bit digits, which numpy sorts by counting."""
    order = np.arange(len(keys))
    most = int(keys.max()) if len(keys) else 0
    for shift in range(0, most.bit_length(), 16):
        digit = (keys >> np.uint64(shift)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys rising, the sum of each one's values)."""
    if not len(keys):
        return keys, values
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


class Items:
    """The asked terms and the items of each: items[first[t]:first[t + 1]] are those of term t."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids = sorted({i for i, _ in rows}, key=lambda i: (i is None, i))
        at = {i: n for n, i in enumerate(self.ids)}
        buf, starts, ends, first = terms_of(pa.array([t for _, t in rows], pa.string()))
        one, two = (_hash(buf, starts, ends, True, v) for v in (_BYTES, _OTHER))
        owner = np.repeat(np.array([at[i] for i, _ in rows], np.int64), np.diff(first))
        # Two asked terms that share the first hash (one in 10^10 for 10^4 terms) would count as one; a document's
        # term has to agree in both.
        self.hashes, at_first, term = np.unique(one, return_index=True, return_inverse=True)
        self.checks = two[at_first]
        pairs = np.unique(np.stack([term.ravel(), owner]), axis=1) if len(term) else np.zeros((2, 0), np.int64)
        self.items, self.first = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.hashes) + 1))
        self.often = np.diff(self.first)

    def found(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n, doc, term, tf): terms of each text, and each text's asked terms with their number of occurrences."""
        buf, starts, ends, first = terms_of(column)
        n, none = np.diff(first), np.zeros(0, np.int64)
        if not len(self.hashes) or not len(starts):
            return n, none, none, none
        h = _hash(buf, starts, ends, True, _BYTES)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        hit = hit[_hash(buf, starts[hit], ends[hit], True, _OTHER) == self.checks[at[hit]]]
        doc = np.searchsorted(first, hit, "right") - 1
        key, tf = summed((doc * len(self.hashes) + at[hit]).astype(np.uint64), np.ones(len(hit), np.int64))
        doc, term = np.divmod(key.astype(np.int64), len(self.hashes))
        return n, doc, term, tf


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1)))."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)


def lengths(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents with n terms each: 10 + (90 * n * N) div L, without overflow."""
    if len(n) and int(n.max()) * 90 * docs >= 1 << 63:
        return np.array([10 + 90 * v * docs // terms for v in n.tolist()], np.int64)
    return 10 + 90 * n * docs // max(terms, 1)


class Best:
    """The k best documents of each item: larger scores first, then smaller ids."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # what a score needs to get in

    def add(self, item: np.ndarray, doc_id: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.least[item]
        for i, d, s in zip(item[keep].tolist(), doc_id[keep].tolist(), score[keep].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -d))
            elif (s, -d) > heap[0]:
                heapq.heapreplace(heap, (s, -d))
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def ranked(self, i: int) -> list[tuple[int, int]]:
        return [(-d, s) for s, d in sorted(self.heaps[i], reverse=True)]


def _count(rows: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """(N, L, df of each asked term) over all rows."""
    size = len(items.hashes)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size + 2, np.int64)
        for b in batches:
            n, _, term, _ = items.found(b.column(1))
            sums[:size] += np.bincount(term, minlength=size)
            sums[size:] += [np.count_nonzero(n), int(n.sum())]
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    sums = np.zeros(size + 2, np.int64)
    for r in rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[r["at"]] = r["n"]
    return int(sums[size]), int(sums[size + 1]), sums[:size]


def _score(rows: DataFrame, items: Items, k: int) -> DataFrame:
    """Each task's k best of each item: (item_id, docs, scores), 64-bit integers as bytes."""
    docs, terms, df = _count(rows, items)
    weight = weights(df, docs)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.ids), k)
        for b in batches:
            n, doc, term, tf = items.found(b.column(1))
            if not len(doc):
                continue
            ids = b.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * lengths(n, docs, terms)[doc]))
            made = np.concatenate([[0], np.cumsum(items.often[term])])
            heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            for a, e in _ranges(np.append(heads, len(doc)), made):
                often = items.often[term[a:e]]
                owner = items.items[_spans(items.first[term[a:e]], often)]
                key = owner.astype(np.uint64) * np.uint64(len(ids)) + np.repeat(doc[a:e], often).astype(np.uint64)
                key, score = summed(key, np.repeat(impact[a:e], often))
                at, place = np.divmod(key.astype(np.int64), len(ids))
                best.add(at, ids[place], score)
        rows = [(items.ids[i], *(np.array(c, "<i8").tobytes() for c in zip(*best.ranked(i), strict=True))) for i in range(len(items.ids)) if best.heaps[i]]
        for s in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + 10_000], strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["item_id", "docs", "scores"])

    return rows.mapInArrow(run, "item_id long, docs binary, scores binary")


def _ranges(heads: np.ndarray, made: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents (which begin at heads) of at most ENTRIES entries, or one document."""
    i, last = 0, len(heads) - 1
    while i < last:
        j = max(i + 1, int(np.searchsorted(made[heads], made[heads[i]] + ENTRIES, "right")) - 1)
        yield int(heads[i]), int(heads[j])
        i = j


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, equal scores by doc_id.

    Null and empty texts have no terms; an item without terms, or whose terms no document has, gives no rows. Rows of
    items with one id (null too) count as one item with the terms of all, once each. Repeated documents count and rank
    each by itself; a null doc_id ranks last among equal scores. Columns other than those named play no part.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = text_rows(docs, id_col, text_col)
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    blocks = 1 + (asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // BLOCK_BYTES
    base = shared_dir(spark, "search")
    found = None
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64(F.coalesce(F.col("item_id"), F.lit(0))), F.lit(blocks)) == i)
        own = cut(_score(rows, Items([tuple(r) for r in block.collect()]), k), f"{base}/{i}")
        found = own if found is None else found.unionByName(own)

    @released
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, current, out = None, None, []
        for b in batches:
            for item, ids, scores in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if best is None or item != current:
                    out += _ranked(best, current)
                    best, current = Best(1, k), item
                best.add(np.zeros(len(ids) // 8, np.int64), np.frombuffer(ids, "<i8"), np.frombuffer(scores, "<i8"))
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        yield _rows(out + _ranked(best, current))

    return found.repartitionByRange(partitions(spark), "item_id").sortWithinPartitions("item_id").mapInArrow(select, RANKED)


def _ranked(best: Best | None, item: int | None) -> list[tuple]:
    return [] if best is None else [(item, rank, None if d == LAST else d, s) for rank, (d, s) in enumerate(best.ranked(0), 1)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item_id", "rank", "doc_id", "score"])
