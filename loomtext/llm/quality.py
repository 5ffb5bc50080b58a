"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The last sum equals all pairwise interactions <v_i, v_j> x_i x_j in time linear in a document's features. Features:
each distinct word, hashed, with equal weights of unit length; each structure statistic (shares of kinds of characters,
word lengths, repetition) and the length as metadata, in standard units and as one of its tenths. Trained by Adam on a
bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .packed import pack, unpack
from .runtime import arrow_batches, released, text_rows
from .words import U64, inside, raw, rolling, words_of

BITS, RANK, BINS = 16, 8, 10
#: Training rows of each class at most.
EACH = 6000
_ASCII = np.arange(256)
_KINDS = {
    "upper": (_ASCII >= 65) & (_ASCII <= 90),
    "lower": (_ASCII >= 97) & (_ASCII <= 122),
    "digit": (_ASCII >= 48) & (_ASCII <= 57),
    "wide": _ASCII >= 128,
    "newline": _ASCII == 10,
    "stop": np.isin(_ASCII, [33, 44, 46, 58, 59, 63]),
    "symbol": np.isin(_ASCII, [*range(35, 39), 42, 43, 47, *range(60, 63), 64, *range(91, 97), *range(123, 127)]),
    "quote": np.isin(_ASCII, [34, 39, 40, 41, 45]),
}
STATS = [*_KINDS, "log_chars", "word_length", "distinct_words", "distinct_fives", "odd_ends", "caps_words"]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: distinct (document, hashed word) sorted, as two columns, and the statistics of each document."""
    buf, off = raw(column)
    w = words_of(column)
    m = len(off) - 1
    size = np.maximum(np.diff(off), 1)

    def per_doc(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
        out, some = np.zeros(m, np.int64), edges[1:] > edges[:-1]
        if some.any():
            out[some] = np.add.reduceat(mask, edges[:-1][some], dtype=np.int64)
        return out

    stats = [per_doc(kind[buf], off) / size for kind in _KINDS.values()]
    n = np.diff(w.first)
    many = np.maximum(n, 1)
    bucket = (w.hashes >> U64(64 - BITS)).astype(np.int64)
    cells = np.unique(w.doc << BITS | bucket)
    doc, word = cells >> BITS, cells & ((1 << BITS) - 1)
    five = rolling(w.hashes, 5)
    ok = inside(w.first, 5)
    fd, fh = w.doc[: len(five)][ok], five[ok]
    order = np.lexsort((fh, fd))
    fd, fh = fd[order], fh[order]
    new = np.ones(len(fd), bool)
    new[1:] = (fd[1:] != fd[:-1]) | (fh[1:] != fh[:-1])
    fives = np.bincount(fd, minlength=m)
    last = buf[w.ends - 1] if len(w.ends) else buf[:0]
    letters = _KINDS["upper"] | _KINDS["lower"] | _KINDS["digit"] | _KINDS["wide"] | _KINDS["stop"]
    lower = np.append(_KINDS["lower"][buf], False)
    no_lower = ~np.logical_or.reduceat(lower, np.stack([w.starts, w.ends], axis=1).ravel())[::2] if len(w.starts) else lower[:0]
    stats += [
        np.log1p(np.diff(off)),
        (per_doc(w.ends - w.starts, w.first)) / many,
        np.bincount(doc, minlength=m) / many,
        np.where(fives > 0, np.bincount(fd[new], minlength=m) / np.maximum(fives, 1), 1.0),
        per_doc(~letters[last], w.first) / many,
        per_doc(no_lower, w.first) / many,
    ]
    return doc, word, np.stack(stats, axis=1)


@dataclass
class Machine:
    """Weights, and what standardises and bins the statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    edges: np.ndarray

    def design(self, doc: np.ndarray, word: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, value) sorted by document."""
        return _design(doc, word, stats, self.mean, self.spread, self.edges)

    def score(self, doc: np.ndarray, word: np.ndarray, stats: np.ndarray) -> np.ndarray:
        m = len(stats)
        d, i, x = self.design(doc, word, stats)
        v = self.factors[i] * x[:, None]
        starts = np.searchsorted(d, np.arange(m))
        s = np.add.reduceat(v, starts, axis=0)
        q = np.add.reduceat(v * v, starts, axis=0)
        y = self.bias + np.add.reduceat(self.linear[i] * x, starts) + 0.5 * (s * s - q).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(y.astype(np.float64), -30, 30)))


def _design(doc, word, stats, mean, spread, edges):
    m, k = stats.shape
    n = np.bincount(doc, minlength=m)
    z = np.clip((stats - mean) / spread, -4, 4)
    bins = np.stack([np.searchsorted(edges[j], stats[:, j], "right") for j in range(k)], axis=1)
    first = 1 << BITS
    d = np.concatenate([doc, np.repeat(np.arange(m), k), np.repeat(np.arange(m), k)])
    i = np.concatenate([word, np.tile(first + np.arange(k), m), (first + k + np.arange(k) * BINS + bins).ravel()])
    x = np.concatenate([1 / np.sqrt(np.maximum(n, 1))[doc], 0.5 * z.ravel(), np.full(m * k, 0.5)]).astype(np.float32)
    order = np.argsort(d, kind="stable")
    return d[order], i[order], x[order]


def train(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], epochs: int = 6, seed: int = 5) -> Machine:
    """Adam on logistic loss; parts: (document, word, statistics, label) as features() gives them, documents from 0 in each."""
    stats = np.concatenate([p[2] for p in parts])
    y = np.concatenate([p[3] for p in parts]).astype(np.float32)
    k = stats.shape[1]
    mean, spread = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    base = np.cumsum([0] + [len(p[2]) for p in parts])
    doc = np.concatenate([p[0] + b for p, b in zip(parts, base, strict=False)])
    d, i, x = _design(doc, np.concatenate([p[1] for p in parts]), stats, mean, spread, edges)
    at = np.searchsorted(d, np.arange(len(y) + 1))
    rng = np.random.default_rng(seed)
    width = (1 << BITS) + k + k * BINS
    lin, fac = np.zeros(width, np.float32), rng.normal(0, 0.02, (width, RANK)).astype(np.float32)
    both = np.concatenate([lin[:, None], fac], axis=1)
    m1, m2 = np.zeros_like(both), np.zeros_like(both)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias, step = np.log(p / (1 - p)), 0
    for _ in range(epochs):
        perm = rng.permutation(len(y))
        for a in range(0, len(y), 256):
            take = perm[a : a + 256]
            step += 1
            lens = at[take + 1] - at[take]
            rows = np.repeat(at[take] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            ii, xx = i[rows], x[rows]
            own = np.repeat(np.arange(len(take)), lens)
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            wv = both[ii] * xx[:, None]
            v = wv[:, 1:]
            s = np.add.reduceat(v, starts, axis=0)
            out = bias + np.add.reduceat(wv[:, 0], starts) + 0.5 * (s * s - np.add.reduceat(v * v, starts, axis=0)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[take]) / len(take)
            grad = np.concatenate([np.ones((len(ii), 1), np.float32), s[own] - v], axis=1) * (g[own] * xx)[:, None]
            hit, inv = np.unique(ii, return_inverse=True)
            order = np.argsort(inv, kind="stable")
            total = np.add.reduceat(grad[order], np.searchsorted(inv[order], np.arange(len(hit))), axis=0) + 1e-5 * both[hit]
            m1[hit] = 0.9 * m1[hit] + 0.1 * total
            m2[hit] = 0.99 * m2[hit] + 0.01 * total * total
            rate = 0.02 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            both[hit] -= rate * m1[hit] / (np.sqrt(m2[hit]) + 1e-8)
            bias -= 0.02 * float(g.sum())
    return Machine(float(bias), both[:, 0].copy(), both[:, 1:].copy(), mean, spread, edges)


def _in_order(ids: np.ndarray, doc: np.ndarray, word: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sample by id and hash of the text, whatever files, splits and batches it came in: training depends on the order."""
    order = np.lexsort((ids[2], ids[0]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    doc = rank[doc]
    cells = np.lexsort((word, doc))
    return doc[cells], word[cells], stats[order], ids[1][order].astype(np.int32)


def fit(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Machine | float:
    """A machine from at most `each` labelled rows of each class; with fewer than two classes, the share of label 1 (or 0.5).

    Features of the sample, not texts, come to the driver. Classes keep their shares: the larger one is thinned no
    further than the bound, and the bias is set right for it. The same rows give the same machine on any layout of files.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows, sizes = sample(docs, labels, "quality", each)
    if len(sizes) < 2:
        return float(next(iter(sizes), 0.5))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                doc, word, stats = features(b.column(1))
                ids = np.stack([b.column(i).to_numpy().astype("<i8") for i in (0, 2, 3)])
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (ids.tobytes(), pack((doc << BITS | word).view(np.uint64)), stats.astype("<f8").tobytes())], ["ids", "cells", "stats"])

    base, ids, docs_of, words, stats_of = 0, [], [], [], []
    for r in rows.select("doc_id", "text", "label", F.xxhash64("text").alias("hash")).mapInArrow(run, "ids binary, cells binary, stats binary").toLocalIterator():
        ids.append(np.frombuffer(r["ids"], "<i8").reshape(3, -1))
        cells = unpack(r["cells"])[0].view(np.int64)
        docs_of.append((cells >> BITS) + base)
        words.append(cells & ((1 << BITS) - 1))
        stats_of.append(np.frombuffer(r["stats"], "<f8").reshape(-1, len(STATS)))
        base += ids[-1].shape[1]
    parts = [_in_order(np.concatenate(ids, axis=1), np.concatenate(docs_of), np.concatenate(words), np.concatenate(stats_of))] if ids else []
    y = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0)
    if len(np.unique(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    machine = train(parts)
    odds = lambda a, b: np.log(a / b)
    machine.bias += float(odds(sizes[1], sizes[0]) - odds((y == 1).sum(), (y == 0).sum()))
    return machine


def score(docs: DataFrame, model: Machine | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row; no shuffle. Null and empty texts are scored as texts without words.

    Repeated rows and null ids are scored like others; whole texts count; other columns play no part.
    """
    arrow_batches(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.full(b.num_rows, model) if isinstance(model, float) else model.score(*features(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, each: int = EACH) -> DataFrame:
    """(doc_id, held_out, score, predicted), learnt from labels of rows that aren't held out."""
    return score(docs, fit(docs, labels, each)).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def quality_stage(docs: DataFrame, labels: DataFrame, each: int = EACH, threshold: float = 0.5) -> DataFrame:
    """docs whose score is at least the threshold, with all columns. Texts are scored where they are, without a shuffle."""
    model = fit(docs, labels, each)
    names, spark = docs.columns, docs.sparkSession
    arrow_batches(spark)
    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("scored"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                col = b.column(b.num_columns - 1)
                s = np.full(b.num_rows, model) if isinstance(model, float) else model.score(*features(col))
                yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(s >= threshold))

    kept = flat.mapInArrow(run, flat.drop("scored").schema)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
