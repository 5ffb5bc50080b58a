"""The k best vectors of each query, exactly, kept in a task while its vectors stream by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import arrow_batches, released

#: Bytes of query vectors that one scan takes along; rows and queries of one product.
QUERY_BYTES, ROWS, QUERIES = 32 << 20, 2048, 512
#: Digits that cosines are compared at.
DIGITS = 9
SCHEMA = "query_id long, vec_id long, score double"


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


class Best:
    """Of n queries: ids and scores of the k best, larger scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, own: np.ndarray, score: np.ndarray) -> None:
        """score[i, j]: of vector own[i] for query queries[j]. All ties with the k-th best take part."""
        k, n = self.k, len(own)
        least = self.scores[queries, -1]
        if n > k:
            least = np.maximum(least, np.partition(score, n - k, axis=0)[n - k])
        row, col = np.nonzero(score >= least)
        if not len(row):
            return
        old = np.unique(col)
        q = np.concatenate([col, np.repeat(old, k)])
        s = np.concatenate([score[row, col], self.scores[queries[old]].ravel()])
        i = np.concatenate([own[row], self.ids[queries[old]].ravel()])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        self.scores[queries[q[keep]], place[keep]], self.ids[queries[q[keep]], place[keep]] = s[keep], i[keep]

    def batches(self, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(query_ids), 4096):
            q, place = np.nonzero(self.scores[a : a + 4096] > -np.inf)
            q = q + a
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(self.ids[q, place]), pa.array(self.scores[q, place])], ["query_id", "vec_id", "score"])


def query_blocks(queries: DataFrame, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of queries(query_id, embedding) in blocks of about QUERY_BYTES, one at a time."""
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("query_id").isNotNull() & (F.size("embedding") == d))
    n = rows.count()
    blocks = max(1, -(-n * d * 8 // QUERY_BYTES))
    for i in range(blocks if n else 0):
        got = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        if got:
            yield np.array([r[0] for r in got], np.int64), unit(np.array([r[1] for r in got], float))


def scored(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, visits: Callable[[int], np.ndarray] | None = None) -> DataFrame:
    """(query_id, vec_id, score) of each task's k best, from vectors(vec_id, embedding) or, with visits, (vec_id, embedding, cell).

    visits(cell): the queries, by place, that look into a cell. A task gives k rows for each query, whatever it reads.
    """
    d = q.shape[1]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, every = Best(len(ids), k), np.arange(len(ids))
        for b in batches:
            own, v = b.column(0).to_numpy(), unit(matrix(b.column(1), d))
            cells = b.column(2).to_numpy() if visits else np.zeros(len(own), np.int64)
            for c in np.unique(cells).tolist():
                at, asked = np.flatnonzero(cells == c), visits(c) if visits else every
                for i in range(0, len(at), ROWS):
                    some = at[i : i + ROWS]
                    for j in range(0, len(asked), QUERIES):
                        those = asked[j : j + QUERIES]
                        best.add(those, own[some], np.round(v[some] @ q[those].T, DIGITS))
        yield from best.batches(ids)

    arrow_batches(vectors.sparkSession)
    return vectors.mapInArrow(run, SCHEMA)


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
