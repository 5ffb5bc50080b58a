"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over block-max inverted indexes.

Terms are words without end punctuation and the first 3 and 4 and last 4 bytes of longer ones (word families in a language that
nobody listed), A-Z as a-z. The vocabulary is all terms of the labelled sample; their document frequencies come from all
documents. Examples are vectors over it with weights (1 + log tf) * idf, of unit length, and lie in blocks of 64. Terms
that many examples have are columns of a matrix, with each column's largest weight in each block; all others have lists
of their examples, which are added up first. A document's cosine with any example of a block is at most the most that
the lists gave there and the sum of its weights times the block's largest ones, so blocks whose bound is below the k-th
best cosine are left out; where that spares few, one product with all blocks costs less, and bounds are tried again later. What comes near the k-th best is added up again in double precision: the k nearest are exact.
Their labels vote with weight cosine squared divided by the number of examples of their class, as the classes are
sampled and met unevenly; the share of label 1 in these votes is the score. It ranks; a rising map makes it a
probability, which is given beside it. The map is learnt from the examples alone, each searched among all others and
counted by how many labelled rows of its class it stands for. Labels of held-out rows play no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .packed import pack, unpack
from .runtime import arrow_batches, cut, released, shared_dir, text_rows
from .words import U64, hash_each, mix, spans_of

#: Examples of each class at most; neighbours; examples in a block; terms kept as columns; documents searched at once;
#: blocks of each document that give the first bound; batches after one that needed most blocks which try no bounds.
EACH, NEAREST, BLOCK, COLUMNS, TOGETHER, FIRST, WHOLE = 3000, 15, 64, 1536, 256, 8, 15
#: Ranges of terms whose document frequencies are added up apart.
RANGES = 16
_STOP = np.zeros(256, bool)
_STOP[[33, 34, 39, 40, 41, 44, 46, 58, 59, 63]] = True
_AFFIXES = [(3, False), (4, False), (4, True)]


def terms_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, term hash) of all words of a batch, then of each kind of affix."""
    buf, starts, ends, first = spans_of(column)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for _ in range(3):
        cut_ = (ends > starts) & _STOP[buf[np.maximum(ends - 1, 0)]] if len(buf) else np.zeros(0, bool)
        ends = ends - cut_
    ok = ends > starts
    starts, ends, doc = starts[ok], ends[ok], doc[ok]
    longer = [ends - starts > n for n, _ in _AFFIXES]
    parts = [(ends[on] - n, ends[on]) if last else (starts[on], starts[on] + n) for (n, last), on in zip(_AFFIXES, longer, strict=True)]
    whole, *hashes = hash_each(buf, [(starts, ends), *parts])
    yield doc, whole
    for (n, last), on, h in zip(_AFFIXES, longer, hashes, strict=True):
        yield doc[on], mix(h + U64(2 * n + last))


class Vocabulary:
    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        top = (self.hashes >> U64(42)).astype(np.int64)
        self.start = np.searchsorted(top, np.arange((1 << 22) + 1)).astype(np.int32)

    def __reduce__(self):
        return Vocabulary, (self.hashes,)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, term) of those of h that are in the vocabulary."""
        top = (h >> U64(42)).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        places, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(left):
            hit = self.hashes[at] == h[left]
            places.append(left[hit])
            terms.append(at[hit].astype(np.int64))
            at = at + 1
            on = ~hit & (at < end)
            left, at, end = left[on], at[on], end[on]
        return np.concatenate(places), np.concatenate(terms)

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, times), sorted, of the terms in the vocabulary."""
        docs, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for doc, h in terms_of(column):
            place, term = self.find(h)
            docs.append(doc[place])
            terms.append(term)
        cells, times = np.unique(np.concatenate(docs) * max(len(self.hashes), 1) + np.concatenate(terms), return_counts=True)
        return *np.divmod(cells, max(len(self.hashes), 1)), times


def vocabulary(sampled: DataFrame) -> np.ndarray:
    """All terms of the labelled sample; one task reads the bounded sample."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, U64)
        for b in batches:
            seen = np.unique(np.concatenate([seen, *(h for _, h in terms_of(b.column(0)))]))
        yield pa.RecordBatch.from_arrays([pa.array([pack(seen)], pa.binary())], ["terms"])

    rows = sampled.select("text").repartition(1).mapInArrow(run, "terms binary").collect()
    return np.unique(np.concatenate([np.zeros(0, U64), *(unpack(bytes(r[0]))[0] for r in rows)]))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), then the same for the next."""
    return np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)


@dataclass
class Examples:
    """The examples' vectors by place, and the index over them, which is built where it is first searched."""

    vocab: Vocabulary
    idf: np.ndarray
    none: float = 0.0
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    term: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    alike: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    column: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def vectors(self, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        x = (1 + np.log(times)) * self.idf[term]
        return x / np.sqrt((x * x).sum())

    def build(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """examples: (id, label, terms, times), those without terms left out. Alike ones get places side by side."""
        df = np.zeros(len(self.vocab.hashes), np.int64)
        for _, _, t, _ in examples:
            df[t] += 1
        common = df >= max(2, len(examples) // 100)

        def leading(e: tuple[int, int, np.ndarray, np.ndarray]) -> tuple[int, int]:
            x = self.vectors(e[2], e[3]) * common[e[2]]
            return int(e[2][np.argmax(x)]), e[0]

        rows = sorted(examples, key=leading)
        self.ids = np.array([e[0] for e in rows], np.int64)
        self.labels = np.array([e[1] for e in rows], np.int64)
        self.at = np.cumsum([0, *(len(e[2]) for e in rows)])
        self.term = np.concatenate([np.zeros(0, np.int32), *(np.asarray(e[2], np.int32) for e in rows)])
        self.times = np.concatenate([np.zeros(0, np.int32), *(np.asarray(e[3], np.int32) for e in rows)])
        first: dict[bytes, int] = {}
        self.alike = np.array([first.setdefault(np.asarray(t, np.int32).tobytes() + np.asarray(c, np.int32).tobytes(), i) for i, (_, _, t, c) in enumerate(rows)], np.int64)
        self.column = None

    def _index(self) -> None:
        n, m = len(self.ids), len(self.vocab.hashes)
        self.blocks = -(-n // BLOCK)
        slot = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.at))
        self.weight = (1 + np.log(self.times)) * self.idf[self.term]
        self.weight /= np.sqrt(np.bincount(slot, self.weight * self.weight, n))[slot]
        df = np.bincount(self.term, minlength=m)
        wide = np.argsort(-df, kind="stable")[:COLUMNS]
        wide = np.sort(wide[df[wide] > BLOCK])
        self.whole = 0  # so many batches of documents are next searched without bounds
        self.column = np.full(m, -1, np.int32)
        self.column[wide] = np.arange(len(wide))
        col = self.column[self.term]
        self.wide = np.zeros((self.blocks * BLOCK, len(wide)), np.float32)
        self.wide[slot[col >= 0], col[col >= 0]] = self.weight[col >= 0]
        self.finer = np.zeros_like(self.wide)  # what single precision leaves of the weights
        self.finer[slot[col >= 0], col[col >= 0]] = self.weight[col >= 0] - self.wide[slot[col >= 0], col[col >= 0]].astype(float)
        self.most = self.wide.reshape(self.blocks, BLOCK, len(wide)).max(axis=1)
        rest = np.flatnonzero(col < 0)
        rest = rest[np.argsort(self.term[rest], kind="stable")]
        self.slots, self.weights = slot[rest].astype(np.int64), self.weight[rest]
        self.list_at = np.zeros(m + 1, np.int64)
        self.list_at[1:] = np.cumsum(np.where(self.column < 0, df, 0))
        self.error = (len(wide) + 16) * 2.0**-23  # of single-precision sums of as many products, at lengths up to 1

    def nearest(self, term: np.ndarray, x: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest with a cosine above 0, nearest first, ties by place in the index."""
        return self.nearest_of(np.array([0, len(term)]), term, x, k)[0]

    def nearest_of(self, first: np.ndarray, term: np.ndarray, x: np.ndarray, k: int = NEAREST) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() of each document; document d has terms first[d]:first[d + 1]."""
        n = len(first) - 1
        if not len(self.ids):
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        if self.column is None:
            self._index()
        size = self.blocks * BLOCK
        score = np.zeros((n, size))
        q = np.zeros((n, self.wide.shape[1]), np.float32)
        own = []  # each document's columns and their weights
        for d in range(n):
            t, y = term[first[d] : first[d + 1]], x[first[d] : first[d + 1]]
            col = self.column[t]
            own.append((col[col >= 0], y[col >= 0]))
            q[d, own[d][0]] = own[d][1]
            t, y = t[col < 0], y[col < 0]
            many = self.list_at[t + 1] - self.list_at[t]
            at = _ranges(self.list_at[t], many)
            score[d] = np.bincount(self.slots.take(at, mode="clip"), self.weights.take(at, mode="clip") * np.repeat(y, many), size) if len(at) else 0
        if self.whole:
            self.whole -= 1
            return self._kept(score, self._all(score, q), own, k)
        bound = (q @ self.most.T + score.reshape(n, self.blocks, BLOCK).max(axis=2)) * (1 + self.error)
        rank = np.empty((n, self.blocks), np.int64)
        best = np.argsort(-bound, axis=1, kind="stable")
        np.put_along_axis(rank, best, np.arange(self.blocks)[None, :], 1)
        done, least = np.zeros((n, self.blocks), bool), np.zeros(n)
        found = np.zeros((n, size), np.float32)
        for upto in (FIRST, self.blocks):
            todo = (rank < upto) & ~done & (bound > 0) & (bound >= (least - self.error)[:, None])
            many = todo.sum(axis=0)
            if upto > FIRST and 2 * many.sum() >= n * self.blocks:  # most need most: one product, as for the next documents
                found, self.whole = self._all(score, q), WHOLE
                break
            for b in np.flatnonzero(many).tolist():
                part = slice(b * BLOCK, (b + 1) * BLOCK)
                if 2 * many[b] >= n:  # most need it: no copies of rows; what the others get is right, too
                    np.add(score[:, part], q @ self.wide[part].T, out=found[:, part], casting="same_kind")
                else:
                    rows = np.flatnonzero(todo[:, b])
                    found[rows, part] = score[rows, part] + q[rows] @ self.wide[part].T
            done |= todo
            if upto == FIRST and (seen := min(FIRST, self.blocks) * BLOCK) >= k:
                least = np.partition(np.take_along_axis(found.reshape(n, self.blocks, BLOCK), best[:, :FIRST, None], 1).reshape(n, seen), seen - k, axis=1)[:, seen - k].astype(float)
        return self._kept(score, found, own, k)

    def _all(self, score: np.ndarray, q: np.ndarray) -> np.ndarray:
        """All cosines in single precision, no block left out."""
        found = q @ self.wide.T
        return np.add(score, found, out=found, casting="same_kind")

    def _kept(self, score: np.ndarray, found: np.ndarray, own: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k nearest of each document, by sums in double precision of what comes near the k-th best found."""
        least = np.zeros(len(own))
        if self.blocks >= k:  # the k-th best of all is no less than that of the blocks' best
            least = np.partition(found.reshape(len(own), self.blocks, BLOCK).max(axis=2), self.blocks - k, axis=1)[:, self.blocks - k].astype(float)
        out = []
        for d in range(len(own)):
            s = np.flatnonzero((found[d] > 0) & (found[d] >= least[d] - 2 * self.error))
            if len(s) > k:
                s = s[found[d, s] >= float(np.partition(found[d, s], len(s) - k)[len(s) - k]) - 2 * self.error]
            cell = s[:, None], own[d][0][None, :]
            c = score[d, s] + (self.wide[cell].astype(float) + self.finer[cell]) @ own[d][1]
            top = np.lexsort((s, -np.round(c, 12)))[:k]
            out.append((s[top], c[top]))
        return out

    def scores(self, first: np.ndarray, term: np.ndarray, times: np.ndarray) -> list[tuple[float, list[int]]]:
        """(score, nearest examples' ids) of each document; one that shares no term with any example has no votes."""
        return [(self.vote(near, cosine) if len(near) else self.none, self.ids[near].tolist()) for near, cosine in self.neighbours(first, term, times)]

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        pull = cosine**2 / np.maximum(np.bincount(self.labels, minlength=2), 1)[self.labels[near]]
        return float(min(1.0, pull @ self.labels[near] / pull.sum()))

    def neighbours(self, first: np.ndarray, term: np.ndarray, times: np.ndarray, k: int = NEAREST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """nearest_of() of documents with terms and their times, some documents at once."""
        for a in range(0, len(first) - 1, TOGETHER):
            own = first[a : a + TOGETHER + 1]
            t, c = term[own[0] : own[-1]], times[own[0] : own[-1]]
            doc = np.repeat(np.arange(len(own) - 1), np.diff(own))
            x = (1 + np.log(c)) * self.idf[t]
            x /= np.sqrt(np.bincount(doc, x * x, len(own) - 1))[doc]
            yield from self.nearest_of(own - own[0], t, x, k)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising map from x to the weighted mean of y: neighbours that fall are pooled. Each pool's mean is drawn
    towards that of all by one observation, so that a pure pool isn't certain; between knots the map is linear."""
    base, one = float(np.average(y, weights=w)), float(w.mean())
    pools: list[list[float]] = []  # weight, sum of y, sum of x
    for i in np.argsort(x, kind="stable").tolist():
        pools.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.maximum.accumulate(np.array([(p[1] + one * base) / (p[0] + one) for p in pools]))


def _each_among_others(sampled: DataFrame, model: Examples) -> list[tuple[int, int, float]]:
    """(id, label, score from all other examples) of each example that has neighbours among them, by id; searched in tasks."""
    shared = sampled.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            doc, term, times = m.vocab.counts(b.column(1))
            out: list[float | None] = []
            for i, (near, cosine) in zip(b.column(0).to_pylist(), m.neighbours(np.searchsorted(doc, np.arange(b.num_rows + 1)), term, times, NEAREST + 1), strict=True):
                other = np.flatnonzero(m.ids[near] != i)[:NEAREST]
                out.append(m.vote(near[other], cosine[other]) if len(other) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.float64())], ["doc_id", "label", "score"])

    found = sampled.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, score double")
    return sorted((r["doc_id"], r["label"], r["score"]) for r in found.where("score is not null").toLocalIterator())


def _term_rows(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, term, times = shared.value.counts(b.column(1))
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            blobs = [pack(term[i:j], times[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(blobs, pa.binary())], ["doc_id", "label", "terms"])

    return rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, terms binary")


def frequencies(docs: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many of docs each term is, and how many docs there are. A task sends one blob for each range of terms."""
    edges = np.linspace(0, len(vocab.hashes), RANGES + 1).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    names = "part int, df binary, n long"

    def rows_of(part: list[int], df: list[np.ndarray], n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([pack(x, delta=0) for x in df], pa.binary()), pa.array(n, pa.int64())], ["part", "df", "n"])

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(shared.value.hashes), np.int64), 0
        for b in batches:
            df += np.bincount(shared.value.counts(b.column(1))[1], minlength=len(df))
            n += b.num_rows
        if n:
            yield rows_of(list(range(RANGES)), [df[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)], [n] * RANGES)

    @released
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for part, blob, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                df = unpack(blob)[0]
                old = sums.get(part, [0, 0])
                sums[part] = [old[0] + df, old[1] + n]
        yield rows_of(list(sums), [v[0] for v in sums.values()], [v[1] for v in sums.values()])

    df, n = np.zeros(len(vocab.hashes), np.int64), 0
    for r in text_rows(docs).mapInArrow(count, names).repartition(RANGES, "part").mapInArrow(total, names).collect():
        df[edges[r["part"]] : edges[r["part"] + 1]] += unpack(bytes(r["df"]))[0]
        n = max(n, r["n"])
    return df, n


def fit(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Examples:
    """The examples: at most `each` labelled rows of each class. The sample's terms, not its texts, come to the driver."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows, sizes = sample(docs, labels, "toxic", each)
    sampled = cut(rows, f"{shared_dir(spark)}/sample")
    vocab = Vocabulary(vocabulary(sampled))
    df, n = frequencies(docs, vocab)
    model = Examples(vocab, np.log((n + 1) / (df + 1)) + 1, sizes.get(1, 0) / max(1, sum(sizes.values())))
    every = {}
    for r in _term_rows(sampled, vocab).toLocalIterator():
        term, times = unpack(bytes(r["terms"]))
        every[r["doc_id"]] = (r["doc_id"], r["label"], term.astype(np.int32), times.astype(np.int32))
    model.build([every[i] for i in sorted(every) if len(every[i][2])])
    rows = _each_among_others(sampled, model)
    y, x = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
    if len(np.unique(y)) == 2:
        model.knots = isotonic(x, y, np.array([sizes[c] / int((y == c).sum()) for c in (0, 1)])[y])
    return model


def toxicity(docs: DataFrame, labels: DataFrame, each: int = EACH, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, probability) for each row; evidence is the nearest examples' ids, nearest first.

    Learnt from labels of rows that aren't held out. Null and empty texts, and texts that share no term with any example,
    have no neighbours and get the share of label 1 among those labels. Repeated rows and null ids are scored like
    others. Without labels all get 0. probability is the calibrated score; with examples of one class only it is the score
    itself, as where nothing votes. Documents aren't shuffled; the index is bounded by the sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, each))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, term, times = shared.value.vocab.counts(b.column(1))
            out = shared.value.scores(np.searchsorted(doc, np.arange(b.num_rows + 1)), term, times)
            likely = [float(np.interp(s, *shared.value.knots)) if near and shared.value.knots else s for s, near in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array(likely, pa.float64())], ["doc_id", "score", "evidence", "probability"])

    scored = text_rows(docs).mapInArrow(run, "doc_id long, score double, evidence array<long>, probability double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "evidence", "probability")
