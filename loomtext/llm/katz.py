"""Katz backoff of order 2: Good-Turing discounted bigram and unigram counts, exactly normalised backoff weights.

    P(w | h) = c*(h, w) / c(h)          if the training texts have the bigram
             = a(h) * P(w)              otherwise; a(h) = 1 if h is no training history
    a(h)     = (1 - sum of the first line over the words seen after h) / (1 - sum of P over the same words)
    P(w)     = c*(w) / N                if the training texts have the word, the rest of 1 for the unknown word

c* is Good-Turing's count r* for r <= 5, as Katz scales it, and r - 1/2 above, and also where Good-Turing gives no
count between 0 and r (few data). So every history leaves some mass, and both lines sum to exactly 1 over all known
words and the unknown one. A text is its words and one end; the history of its first token is a begin mark.

train() stores the model as tables below one path, and score() evaluates any texts from them, also in a later session:

    unigrams       (word, count), words as 64-bit hashes
    kind=bigrams   (bucket, blob): words, histories and counts of a bucket of words, packed; read_bigrams() opens them
    weights        (bucket, blob): histories, counts and backoff weights of a bucket of histories; read_weights()
    stats          one row of JSON: sizes, discounts, number of buckets, frequent words

Counts, weights and scores grow with the corpus and stay on the executors. For each token one shuffle brings (word,
history, document) to the bucket of its word, where the table has c(h, w), c(w) and so P(w). Since each word is the
history of exactly one token, the sum of log c(h) over a text's tokens is that of log c(w) over its words, so it needs
no other bucket. Only a(h) lies with the history: tokens that back off look it up there, in a second, smaller shuffle.
Words with more than a bucket's share of tokens are spread by their history; their counts, at most twice as many as
there are buckets, are known to all tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packed import apart, both, bucket_of, by_bucket, cuts, pack, unpack
from .runtime import arrow_batches, crc_mod, cut, drop_path, partitions, released, shared_dir
from .words import U64, mix, words_of

K = 5
FLUSH = 1 << 21
#: Training tokens in a bucket (about 100 bytes each in a task that reads it), and how many buckets there are at least.
BUCKET_TOKENS, LEAST_BUCKETS = 1_750_000, 32
BEGIN, END = U64(0xB0B0B0B0B0B0B0B1), U64(0xE0E0E0E0E0E0E0E1)
_ROWS = "bucket long, blob binary"


def discounted(c: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """c* of counts above 0: stars[r] for r <= K, c - 1/2 above."""
    return np.where(c <= K, stars[np.minimum(c, K)], c - 0.5)


def good_turing(n: np.ndarray) -> np.ndarray:
    """r* for r <= K from the numbers n[r] of types seen r times, r <= K + 1."""
    n = np.asarray(n, float)
    out = np.arange(K + 1) - 0.5
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        if n[r] and n[r + 1] and tail < 1:
            star = ((r + 1) * n[r + 1] / n[r] - r * tail) / (1 - tail)
            if 0 < star < r:
                out[r] = star
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs in which all keys stay the same."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spread(starts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[starts[1:]] = 1
    return np.cumsum(out)


def _send(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 64]], pa.int64()), pa.array([r[1] for r in rows[i : i + 64]], pa.binary())], ["bucket", "blob"])


def _count_words(buckets: int):
    """Word counts of training texts, END included, by bucket."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, count = np.unique(np.concatenate(held), return_counts=True)
            yield from _send([(b, pack(key[i:j], count[i:j].astype("<u4"))) for b, i, j in cuts(key, buckets)])

        for b in batches:
            held += [words_of(b.column(1)).hashes, np.full(b.num_rows, END)]
            n += len(held[-2])
            if n >= FLUSH:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    return run


def _sum_words(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    parts = [unpack(blob) for (blob,) in rows]
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    count = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["word", "count"])


def _with_ends(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a batch, each text's words and one end; their histories; first tokens of texts, and the end."""
    x, m = words_of(column), len(column)
    first = x.first + np.arange(m + 1)
    w, h = np.empty(len(x.hashes) + m, U64), np.empty(len(x.hashes) + m, U64)
    is_end = np.zeros(len(w), bool)
    is_end[first[1:] - 1] = True
    w[is_end] = END
    w[~is_end] = x.hashes
    h[1:] = w[:-1]
    h[first[:-1]] = BEGIN
    return w, h, first


def _route(w: np.ndarray, h: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each token: its word's, or of word and history where the word is a frequent one."""
    if not len(hot):
        return bucket_of(w, buckets)
    is_hot = hot[np.minimum(np.searchsorted(hot, w), len(hot) - 1)] == w
    return bucket_of(np.where(is_hot, mix(w * U64(3) + h), w), buckets)


def _small(x: np.ndarray, top: int) -> np.ndarray:
    return x.astype("|u1" if top <= 256 else "<u2" if top <= 65536 else "<u4")


def _pack_pairs(w: np.ndarray, h: np.ndarray, c: np.ndarray) -> bytes:
    hs, hi = np.unique(h, return_inverse=True)
    return both(pack(w, _small(hi, len(hs)), _small(c, int(c.max()) + 1) if c.max() < 1 << 32 else c), pack(hs))


def _open_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = apart(blob)
    w, hi, c = unpack(a)
    return w, unpack(b)[0][hi], c.astype(np.int64)


def _add_pairs(w: np.ndarray, h: np.ndarray, c: np.ndarray, *first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of c over equal (w, h), sorted by them, after the columns in first."""
    order = np.lexsort((h, w, *first))
    cols = [x[order] for x in (*first, w, h)]
    starts = _runs(*cols)
    return (*(x[starts] for x in cols), np.add.reduceat(c[order], starts))


def _pairs(buckets: int, hot: np.ndarray):
    """Bigram counts of training texts by bucket."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            w, h = (np.concatenate([x[i] for x in held]) for i in range(2))
            b, w, h, c = _add_pairs(w, h, np.ones(len(w), np.int64), _route(w, h, hot, buckets))
            yield from _send([(int(b[i]), _pack_pairs(w[i:j], h[i:j], c[i:j])) for i, j in zip(*_edges(b), strict=True)])

        for b in batches:
            held.append(_with_ends(b.column(1))[:2])
            n += len(held[-1][0])
            if n >= FLUSH:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return run


def _count_pairs(stats: dict):
    """One bucket of words: its table of bigrams, the sums that weights need by history, and numbers of types."""
    stars, h_buckets = np.array(stats["stars"]), stats["buckets"]
    hot, hot_counts = stats["hot"], stats["hot_counts"]

    def work(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = [_open_pairs(blob) for (blob,) in rows]
        rows.clear()
        w, h, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        w, h, c = _add_pairs(w, h, c)
        starts = _runs(w)
        cw = _word_counts(w[starts], np.add.reduceat(c, starts), hot, hot_counts)
        p1 = (discounted(cw, stars) / stats["n"])[_spread(starts, len(w))]
        out = [("bigrams", bucket, _pack_pairs(w, h, c)), ("types", 0, np.bincount(np.minimum(c, K + 2), minlength=K + 3).astype("<i8").tobytes())]
        order = np.argsort(h, kind="stable")
        h, c, p1 = h[order], c[order], p1[order]
        starts = _runs(h)
        many = [np.add.reduceat((c == r).astype(np.int64), starts).astype("<u4") for r in range(1, K + 1)]
        large = np.add.reduceat(np.where(c > K, 1, 0), starts).astype("<u4")
        mass = np.add.reduceat(np.where(c > K, c, 0), starts)
        sums, key = np.add.reduceat(p1, starts), h[starts]
        out += [("sums", b, pack(key[i:j], sums[i:j], mass[i:j], large[i:j], *(x[i:j] for x in many))) for b, i, j in cuts(key, h_buckets)]
        for i in range(0, len(out), 64):
            kinds, buckets, blobs = zip(*out[i : i + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], ["kind", "bucket", "blob"])

    return work


def _word_counts(words: np.ndarray, counts: np.ndarray, hot: np.ndarray, hot_counts: np.ndarray) -> np.ndarray:
    """Counts of a bucket's words; those of frequent words, of which it has a part only, from the list."""
    if not len(hot):
        return counts
    at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
    return np.where(hot[at] == words, hot_counts[at], counts)


def _tokens(buckets: int, doc_buckets: int, hot: np.ndarray):
    """(word, history, document, times) of all texts by bucket, and each document's id and side by document bucket."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid0 = TaskContext.get().partitionId() << 40
        parts: list[tuple[np.ndarray, ...]] = []
        docs: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            w, h, d = (np.concatenate([p[i] for p in parts]) for i in range(3))
            uid, doc, none, out = (np.concatenate([p[i] for p in docs]) for i in range(4))
            b = _route(w, h, hot, buckets)
            order = np.lexsort((d, h, w, b))
            b, w, h, d = b[order], w[order], h[order], d[order]
            starts = _runs(b, w, h, d)
            times = np.diff(np.append(starts, len(w))).astype("<u4")
            b, w, h, d = b[starts], w[starts], h[starts], d[starts]
            rows = []
            for i, j in zip(*_edges(b), strict=True):
                us, ui = np.unique(d[i:j], return_inverse=True)
                hs, hi = np.unique(h[i:j], return_inverse=True)
                t = times[i:j]
                rows.append((int(b[i]), b"K" + both(pack(w[i:j], _small(hi, len(hs)), _small(ui, len(us)), _small(t, int(t.max()) + 1)), both(pack(hs), pack(uid[us].view(np.uint64))))))
            at = bucket_of(mix(uid.view(np.uint64)), doc_buckets)
            order = np.argsort(at, kind="stable")
            for i, j in zip(*_edges(at[order]), strict=True):
                o = order[i:j]
                rows.append((-1 - int(at[o[0]]), b"D" + pack(uid[o].view(np.uint64), doc[o], none[o].astype(np.uint8), out[o].astype(np.uint8))))
            yield from _send(rows)

        seen = 0
        for b in batches:
            w, h, first = _with_ends(b.column(1))
            m, base = b.num_rows, sum(len(p[0]) for p in docs)
            parts.append((w, h, np.repeat(np.arange(m) + base, np.diff(first))))
            docs.append((uid0 + seen + np.arange(m), b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(0).is_null().to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)))
            seen += m
            n += len(w)
            if n >= FLUSH:
                yield from flush()
                parts, docs, n = [], [], 0
        if parts:
            yield from flush()

    return run


def _edges(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = _runs(b)
    return starts, np.append(starts[1:], len(b))


def _evaluate(stats: dict):
    """One bucket of words, its table and its tokens: the parts of scores that need no weight, and tokens that back off."""
    stars, stars2, total, norm = np.array(stats["stars"]), np.array(stats["stars2"]), max(stats["n"], 1), np.log10(stats["n"] + stats["v"] + 1)
    hot, hot_counts, buckets, unknown = stats["hot"], stats["hot_counts"], stats["buckets"], stats["unknown"]

    def work(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if bucket < 0:
            yield from _send([(bucket, blob) for (blob,) in rows])
            return
        ws, hs, us, ts, cs, uids, base = [], [], [], [], [], [], 0
        tables = [_open_pairs(blob[1:]) for (blob,) in rows if blob[:1] == b"T"]
        for (blob,) in rows:
            if blob[:1] == b"K":
                a, b = apart(blob[1:])
                w, hi, ui, t = unpack(a)
                hd, ud = map(unpack, apart(b))
                ws.append(w)
                hs.append(hd[0][hi])
                us.append(ui.astype(np.int64) + base)
                ts.append(t.astype(np.int64))
                uids.append(ud[0])
                cs.append(np.zeros(len(w), np.int64))
                base += len(ud[0])
        rows.clear()
        if not uids:
            return
        for w, h, c in tables:  # as tokens of no document that occur 0 times
            ws.append(w)
            hs.append(h)
            us.append(np.full(len(w), base))
            ts.append(np.zeros(len(w), np.int64))
            cs.append(c)
        del tables
        uid, m = np.concatenate(uids), base
        w, h = np.concatenate(ws), np.concatenate(hs)
        order = np.lexsort((h, w))
        w, h, d, t, c = w[order], h[order], np.concatenate(us)[order], np.concatenate(ts)[order], np.concatenate(cs)[order]
        del ws, hs, us, ts, cs, order
        starts = _runs(w)
        cw = _word_counts(w[starts], np.add.reduceat(c, starts), hot, hot_counts)
        p1 = np.where(cw > 0, discounted(np.maximum(cw, 1), stars) / total, unknown)
        of_word = _spread(starts, len(w))
        pairs = _runs(w, h)
        c = np.add.reduceat(c, pairs)[_spread(pairs, len(w))]
        # parts of documents
        known = np.bincount(d, t * (cw > 0)[of_word], m + 1)[:m]
        every = np.bincount(d, t, m + 1)[:m]
        base_sum = np.bincount(d, t * (np.log10(cw + 1) - norm)[of_word], m + 1)[:m]
        as_history = np.where(w[starts] == END, 0, np.log10(np.maximum(cw, 1)))
        gain = np.log10(np.where(c > 0, discounted(np.maximum(c, 1), stars2), p1[of_word])) - as_history[of_word]
        score = np.bincount(d, t * gain, m + 1)[:m]
        rows_out = []
        at = bucket_of(mix(uid), buckets)
        order = np.lexsort((uid, at))
        for i, j in zip(*_edges(at[order]), strict=True):
            o = order[i:j]
            rows_out.append((-1 - int(at[o[0]]), b"P" + pack(uid[o], base_sum[o], score[o], known[o].astype("<u4"), (every - known)[o].astype("<u4"))))
        # tokens that back off, to their history
        back = np.flatnonzero((c == 0) & (t > 0))
        if len(back):
            key, who, times = h[back], uid[d[back]], t[back]
            order = np.argsort(key, kind="stable")
            key, who, times = key[order], who[order], times[order]
            for b, i, j in cuts(key, buckets):
                us2, ui = np.unique(who[i:j], return_inverse=True)
                rows_out.append((b, b"U" + both(pack(key[i:j], ui.astype("<u4"), times[i:j].astype("<u4")), pack(us2))))
        yield from _send(rows_out)

    return work


def _weigh(stars2: np.ndarray):
    """One bucket of histories: their counts and weights."""
    def work(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        yield from _send([(bucket, pack(*_table([unpack(blob) for (blob,) in rows], stars2)))])

    return work


def _back_off(doc_buckets: int):
    """One bucket of histories: what tokens that back off add to their documents' scores."""
    def work(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        table = [unpack(blob[1:]) for (blob,) in rows if blob[:1] == b"W"]
        h, c, a = table[0] if table else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0))
        worth = np.log10(a * np.maximum(c, 1))
        out, who, add = [], [], []
        for (blob,) in rows:
            if blob[:1] == b"U":
                x, us = apart(blob[1:])
                key, ui, times = unpack(x)
                at = np.minimum(np.searchsorted(h, key), max(len(h) - 1, 0))
                value = np.where(h[at] == key, worth[at], 0.0) if len(h) else np.zeros(len(key))
                who.append(unpack(us)[0][ui])
                add.append(value * times)
        if who:
            uid, at = np.unique(np.concatenate(who), return_inverse=True)
            total = np.bincount(at, np.concatenate(add))
            db = bucket_of(mix(uid), doc_buckets)
            order = np.lexsort((uid, db))
            for i, j in zip(*_edges(db[order]), strict=True):
                o = order[i:j]
                out.append((-1 - int(db[o[0]]), b"B" + pack(uid[o], total[o])))
        yield from _send(out)

    return work


def _table(gathered: list[list[np.ndarray]], stars2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories with their counts and backoff weights, from the buckets' parts."""
    if not gathered:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0)
    key, at = np.unique(np.concatenate([g[0] for g in gathered]), return_inverse=True)
    col = lambda i: np.bincount(at, np.concatenate([g[i] for g in gathered]).astype(float))
    sums, mass, large = col(1), col(2), col(3)
    many = [col(3 + r) for r in range(1, K + 1)]
    c = mass + sum(r * x for r, x in enumerate(many, 1))
    kept = mass - 0.5 * large + sum(stars2[r] * x for r, x in enumerate(many, 1))
    return key, np.round(c).astype(np.int64), (1 - kept / c) / (1 - sums)


def _scores(stats: dict):
    def work(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        got: dict[bytes, list] = {b"D": [], b"P": [], b"B": []}
        for (blob,) in rows:
            got[blob[:1]].append(unpack(blob[1:]))
        rows.clear()
        uid, doc, none, out = (np.concatenate([g[i] for g in got[b"D"]]) for i in range(4))
        order = np.argsort(uid)
        uid, doc, none, out = uid[order], doc[order], none[order].astype(bool), out[order].astype(bool)
        n = len(uid)
        base, score, known, unk = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for p in got[b"P"]:
            at = np.searchsorted(uid, p[0])  # each blob has a document once
            base[at] += p[1]
            score[at] += p[2]
            known[at] += p[3]
            unk[at] += p[4]
        for p in got[b"B"]:
            score[np.searchsorted(uid, p[0])] += p[1]
        score -= np.log10(max(stats["begins"], 1))
        cols = [pa.array(doc, mask=none), pa.array(out), pa.array(known + unk), pa.array(known), pa.array(np.full(n, stats["n"], np.int64)), pa.array(base), pa.array(score)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return work


def train(docs: DataFrame, path: str, text_col: str = "text") -> None:
    """Learn from all rows and store the model's tables below path, a new folder that all executors share.

    Null and empty texts are the end alone. Repeated rows count each time. An empty table makes a model that knows no word.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    spread = partitions(spark)
    rows = docs.select(F.lit(0), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = cut(by_bucket(rows.mapInArrow(_count_words(spread * 3 // 2 + 1), _ROWS), spread, _sum_words, "word long, count long"), f"{path}/unigrams")
    sizes = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0)), *(F.count(F.when(F.col("count") == r, 1)) for r in range(1, K + 2))).first()
    stats = {"v": sizes[0], "n": sizes[1], "stars": good_turing([0, *sizes[2:]]).tolist()}
    # Later buckets follow the tokens: a task holds one in memory, and each sends a blob to each of the next ones.
    stats["buckets"] = buckets = max(min(spread, LEAST_BUCKETS), stats["n"] // BUCKET_TOKENS + 1)
    stats["begins"] = int((words.where(F.col("word") == int(END.view(np.int64))).first() or [0, 0])[1]) if stats["n"] else 0
    seen_mass = words.select(F.sum(F.when(F.col("count") > K, F.col("count") - 0.5).otherwise(F.get(F.array(*map(F.lit, stats["stars"])), F.col("count").cast("int"))))).first()[0] or 0.0
    stats["unknown"] = 1 - seen_mass / stats["n"] if stats["n"] else 1.0
    share = stats["n"] / min(2 * buckets, 100_000)
    hot = sorted((r["word"] & (2**64 - 1), r["count"]) for r in words.where(F.col("count") > share).collect())
    stats["hot"], stats["hot_counts"] = [k for k, _ in hot], [c for _, c in hot]

    pairs = rows.mapInArrow(_pairs(buckets, np.array(stats["hot"], U64)), _ROWS)
    counted = by_bucket(pairs, spread, _count_pairs(_arrays(stats)), "kind string, " + _ROWS)
    counted.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/pairs")
    kinds = spark.read.schema(_ROWS + ", kind string").parquet(f"{path}/pairs")
    types = [np.frombuffer(r["blob"], "<i8") for r in kinds.where("kind = 'types'").toLocalIterator()]
    stats["stars2"] = good_turing(np.sum(types, axis=0)[: K + 2] if types else np.zeros(K + 2)).tolist()
    cut(by_bucket(kinds.where("kind = 'sums'").select("bucket", "blob"), spread, _weigh(np.array(stats["stars2"])), _ROWS), f"{path}/weights")
    drop_path(spark, f"{path}/pairs/kind=sums")
    spark.createDataFrame([(json.dumps(stats),)], "stats string").coalesce(1).write.parquet(f"{path}/stats")


def _arrays(stats: dict) -> dict:
    return stats | {"hot": np.array(stats["hot"], U64), "hot_counts": np.array(stats["hot_counts"], np.int64)}


def _blobs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(f"{path}/weights") if kind == "weights" else spark.read.schema(_ROWS + ", kind string").parquet(f"{path}/pairs").where(F.col("kind") == kind).select("bucket", "blob")


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    """(history, word, count) of a stored model; history and word are hashes."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(1):
                w, h, c = _open_pairs(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(w.view(np.int64)), pa.array(c)], ["history", "word", "count"])

    return _blobs(spark, path, "bigrams").mapInArrow(run, "history long, word long, count long")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(history, count, weight) of a stored model; history is a hash."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(1):
                h, c, a = unpack(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(a)], ["history", "count", "weight"])

    return _blobs(spark, path, "weights").mapInArrow(run, "history long, count long, weight double")


def score(docs: DataFrame, path: str, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row, from the model stored at path.

    base_score is that of add-one smoothed word counts, score that of the Katz model, both log10. held_out is passed on.
    Null and empty texts are the end alone. Repeated rows have rows of their own; null ids stay null. With a model
    that knows no word every token is unknown. An empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    base, spread = shared_dir(spark), partitions(spark)
    stats = _arrays(json.loads(spark.read.parquet(f"{path}/stats").first()[0]))
    side = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), side.alias("held_out"))
    marked = lambda kind, mark: _blobs(spark, path, kind).select("bucket", F.concat(F.lit(mark).cast("binary"), "blob").alias("blob"))
    tokens = rows.mapInArrow(_tokens(stats["buckets"], stats["buckets"], stats["hot"]), _ROWS)
    parts = cut(by_bucket(tokens.unionByName(marked("bigrams", "T")), spread, _evaluate(stats), _ROWS), f"{base}/parts")
    back = cut(by_bucket(parts.where("bucket >= 0").unionByName(marked("weights", "W")), spread, _back_off(stats["buckets"]), _ROWS), f"{base}/back")
    return by_bucket(parts.where("bucket < 0").unionByName(back), spread, _scores(stats), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", model_to: str | None = None) -> DataFrame:
    """score() of all rows by what train() learns from those not held out; the model stays at model_to, if given.

    held_out: a condition on docs; by default crc32 of the id as text, mod 7, is 2.
    """
    spark = docs.sparkSession
    side = F.coalesce(crc_mod(id_col, 7) == 2 if held_out is None else held_out, F.lit(False))
    path = model_to or shared_dir(spark)
    train(docs.where(~side), path, text_col)
    return score(docs, path, side, id_col, text_col)
