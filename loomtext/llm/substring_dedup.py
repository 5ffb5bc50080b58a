"""Removal of repeated passages: fixed-block anchors.

A window is WINDOW = 50 consecutive words of one document. The reference is cut into non-overlapping blocks of 25
words: any window of 50 words holds a whole block of its document, whatever its place (2 * 25 - 1 < 50). So where two
documents share a window, a rolling window of 25 words of the one meets a block of the other. All blocks are indexed
and every rolling window of 25 words probes them; documents that meet are candidates. Their hits are extended to
windows of 50: each one's smallest document is found among the candidates' windows, and a window is removed if that is
smaller than its own document. Overlapping removed windows merge, so what goes is the maximal repeat.

A map task first settles what its own documents settle: of documents with a window in common all but the smallest
lose it, and only one entry for a window leaves the task. So the shuffle has at most one entry for each window and
task, also for a passage that a third of all documents share. Candidates may meet by chance, which costs time only; the
windows that decide are compared by two independent 64-bit hashes of their words. Among 10^13 windows the chance that
any two different ones agree in both is about 10^-13.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import apart, both, bucket_of, by_bucket, cuts, pack, unpack
from .runtime import arrow_batches, cut, drop_path, partitions, released, shared_dir, text_rows
from .words import inside, mix, rolling, second_hashes, words_of

WINDOW, BLOCK = 50, 25
#: Windows that a map task sorts at once.
FLUSH = 1 << 21
#: Bytes of text whose windows a bucket holds, about 1.5 million (a task has one bucket in memory at a time).
BUCKET_BYTES = 10 << 20
#: Lists of document ids up to this length are broadcast (8 bytes each); longer ones are shuffled.
BROADCAST_IDS = 500_000
NO_ID = np.iinfo(np.int64).max  # a null id counts as larger than all others


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def _windows(batches: Iterator[pa.RecordBatch], k: int, twice: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, document, whether it is a reference block) of all rolling windows of k words of documents that have WINDOW words, sorted by the first two.

    twice: a second hash in place of the last, and sorted by both hashes and then the document.
    """
    keys, docs, refs, n = [], [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, doc, ref = np.concatenate(keys), np.concatenate(docs), np.concatenate(refs)
        order = np.lexsort((doc, ref, key) if twice else (doc, key))
        return key[order], doc[order], ref[order]

    for b in batches:
        w = words_of(b.column(1), lower=False)
        many = np.diff(w.first)
        d = w.doc
        h = rolling(w.hashes, k)
        d = d[: len(h)]
        ok = inside(w.first, k) & (many[d] >= WINDOW)
        keys.append(h[ok])
        docs.append(_ids(b.column(0))[d[ok]])
        refs.append(rolling(second_hashes(w, lower=False), k)[ok] if twice else ((np.arange(len(h)) - w.first[d]) % BLOCK == 0)[ok])
        n += int(ok.sum())
        if n >= FLUSH:
            yield flush()
            keys, docs, refs, n = [], [], [], 0
    if n:
        yield flush()


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal keys, and each entry's run."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _several(doc: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a run (sorted by document) has more than one document."""
    ends = np.append(starts[1:], len(doc)) - 1
    return doc[starts] != doc[ends]


def _probe(buckets: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, doc, ref in _windows(batches, BLOCK):
            starts, run_of = _groups(key)
            has_ref = np.logical_or.reduceat(ref, starts)
            settled = has_ref & _several(doc, starts)
            local = np.unique(doc[settled[run_of]])
            send = ~settled[run_of]
            send[starts] = True
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            send &= new
            key, doc, ref = key[send], doc[send], has_ref[run_of[send]]
            rows = [(-1, pack(local.view(np.uint64)))]
            for b, i, j in cuts(key, buckets):
                ids, place = np.unique(doc[i:j], return_inverse=True)
                rows.append((b, both(pack(key[i:j] >> np.uint64(16), place.astype("<u4"), ref[i:j].astype(np.uint8)), pack(ids.view(np.uint64)))))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 64]], pa.int64()), pa.array([r[1] for r in rows[i : i + 64]], pa.binary())], ["bucket", "blob"])

    return run


def _meet(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Documents that have a block or rolling window which another document has too, one of them as a block."""
    if bucket < 0:
        found = [unpack(blob)[0].view(np.int64) for (blob,) in rows]
    else:
        keys, docs, refs = [], [], []
        for (blob,) in rows:
            packed, ids = apart(blob)
            key, place, ref = unpack(packed)
            keys.append(key)
            docs.append(unpack(ids)[0].view(np.int64)[place])
            refs.append(ref)
        key, doc, ref = np.concatenate(keys), np.concatenate(docs), np.concatenate(refs)
        order = np.lexsort((doc, key))
        key, doc, ref = key[order], doc[order], ref[order]
        starts, run_of = _groups(key)
        good = np.logical_or.reduceat(ref.astype(bool), starts) & _several(doc, starts)
        found = [doc[good[run_of]]]
    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["doc_id"])


def _flagged(doc: np.ndarray, key: np.ndarray, doc_buckets: int) -> Iterator[tuple[int, bytes]]:
    """(document bucket, blob) of removed windows: documents and hashes."""
    if not len(doc):
        return
    at = bucket_of(mix(doc.view(np.uint64).copy()), doc_buckets)
    order = np.lexsort((key, doc, at))
    doc, key, at = doc[order], key[order], at[order]
    edges = np.flatnonzero(np.diff(at, prepend=-1))
    for i, j in zip(edges, np.append(edges[1:], len(at)), strict=True):
        yield int(at[i]), pack(doc[i:j].view(np.uint64), key[i:j])


def _per_document(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One row for each document, with the hashes of all its removed windows."""
    parts = [unpack(blob) for (blob,) in rows]
    doc, key = np.concatenate([p[0] for p in parts]).view(np.int64), np.concatenate([p[1] for p in parts])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    starts, _ = _groups(doc)
    for i in range(0, len(starts), 256):
        some = starts[i : i + 256]
        ends = np.append(starts[i + 1 : i + 256], starts[i + 256] if i + 256 < len(starts) else len(doc))
        yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array([pack(key[x:y]) for x, y in zip(some, ends, strict=True)], pa.binary())], ["doc_id", "blob"])


def _extend(buckets: int, doc_buckets: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, doc, other in _windows(batches, WINDOW, twice=True):
            starts, run_of = _groups(key, other)
            lost = doc > doc[starts][run_of]
            rows = [(-1 - at, blob) for at, blob in _flagged(doc[lost], key[lost], doc_buckets)]
            key, doc, other = key[starts], doc[starts], other[starts]
            for b, i, j in cuts(key, buckets):
                ids, place = np.unique(doc[i:j], return_inverse=True)
                rows.append((b, both(pack(key[i:j], other[i:j], place.astype("<u4")), pack(ids.view(np.uint64)))))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 64]], pa.int64()), pa.array([r[1] for r in rows[i : i + 64]], pa.binary())], ["bucket", "blob"])

    return run


def _smallest(doc_buckets: int):
    def work(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, others, docs = [], [], []
        for (blob,) in rows:
            packed, ids = apart(blob)
            key, other, place = unpack(packed)
            keys.append(key)
            others.append(other)
            docs.append(unpack(ids)[0].view(np.int64)[place])
        key, other, doc = np.concatenate(keys), np.concatenate(others), np.concatenate(docs)
        order = np.lexsort((doc, other, key))
        key, other, doc = key[order], other[order], doc[order]
        starts, run_of = _groups(key, other)
        lost = doc > doc[starts][run_of]
        out = list(_flagged(doc[lost], key[lost], doc_buckets))
        yield pa.RecordBatch.from_arrays([pa.array([-1 - d for d, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["bucket", "blob"])

    return work


@released
def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (doc_id, text or null, blob): a document's removed windows come before its text."""
    current, lost = None, []
    for b in batches:
        w = words_of(b.column(1), lower=False)
        ids = _ids(b.column(0))
        real = b.column(1).is_valid().to_pylist()
        out = []
        for i, blob in enumerate(b.column(2).to_pylist()):
            if ids[i] != current:
                current, lost = ids[i], []
            if not real[i]:
                lost.append(unpack(blob)[0])
                continue
            a, e = int(w.first[i]), int(w.first[i + 1])
            steps = np.zeros(e - a + 1, np.int32)
            if lost and e - a >= WINDOW:
                at = np.flatnonzero(np.isin(rolling(w.hashes[a:e], WINDOW), np.concatenate(lost)))
                steps[at] += 1
                steps[at + WINDOW] -= 1
            keep = np.cumsum(steps[:-1]) == 0
            spans = zip(w.starts[a:e][keep].tolist(), w.ends[a:e][keep].tolist(), strict=True)
            kept = b" ".join([w.buf[s:t].tobytes() for s, t in spans])
            out.append((None if ids[i] == NO_ID else int(ids[i]), e - a, int((~keep).sum()), kept.decode()))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], ["doc_id", "n_words", "n_removed", "kept"])


@released
def _untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        split = [t.encode().split() for t in b.column(1).to_pylist()]
        n = pa.array([len(x) for x in split], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(np.zeros(len(split), np.int64)), pa.array([b" ".join(x).decode() for x in split], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document without the words of windows that a smaller document has too.

    kept holds the remaining words joined by one space. Windows are judged on the input. Null and empty texts have no
    words; documents with fewer than 50 lose none. Rows that share an id don't take windows from one another; a null id
    counts as the largest. Whole texts count, however long. Other columns play no part. An empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    base, spread = shared_dir(spark), partitions(spark)
    blobs = "bucket long, blob binary"
    rows = text_rows(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, doc_buckets = max(2 * spread, size // BUCKET_BYTES), max(8, spread // 2, size // (4 * BUCKET_BYTES))
    candidates = cut(by_bucket(rows.mapInArrow(_probe(buckets), blobs), spread, _meet, "doc_id long").distinct(), f"{base}/candidates")
    some = _among(rows, candidates, candidates.count())
    ended = cut(some.mapInArrow(_extend(buckets, doc_buckets), blobs), f"{base}/windows")
    lost = by_bucket(ended.where("bucket >= 0"), spread, _smallest(doc_buckets), blobs).union(ended.where("bucket < 0"))
    flags = cut(by_bucket(lost, spread, _per_document, "doc_id long, blob binary"), f"{base}/flags")
    drop_path(spark, f"{base}/windows")
    touched = flags.select("doc_id")
    n = flags.count()
    with_flags = _among(rows, touched, n) if n <= BROADCAST_IDS else rows
    schema = "doc_id long, n_words long, n_removed long, kept string"
    mixed = with_flags.select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "text", F.lit(None).cast("binary").alias("blob")).unionByName(flags.select("doc_id", F.lit(None).cast("string").alias("text"), "blob"))
    cleaned = mixed.repartition(spread, "doc_id").sortWithinPartitions("doc_id", F.col("text").isNotNull()).mapInArrow(_cleaned, schema)
    if n > BROADCAST_IDS:
        return cleaned
    rest = rows.join(F.broadcast(touched.withColumnRenamed("doc_id", "__id")), F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("__id"), "left_anti")
    return cleaned.unionByName(rest.mapInArrow(_untouched, schema))


def _among(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """rows whose id is in ids; texts move only if the ids are too many to broadcast."""
    ids = ids.withColumnRenamed("doc_id", "__id")
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("__id"), "left_semi")
