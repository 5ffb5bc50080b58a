"""A vector index: trained cells, vectors stored by cell, and exact or approximate search that leaves cells out.

Cells are directions trained by spherical k-means on a bounded sample. Every vector lies in the cell of its nearest
direction; the table is partitioned by cell, so cells that aren't needed aren't read. The angle between a query and any
vector of a cell is at least the angle to its direction less the cell's widest angle. An exact search looks into each
query's nearest cells first and then into those whose bound still reaches its k-th best; an approximate one stops after
the first step.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import topk
from loomtext.session import arrow_batches, released
from loomtext.sources import rules as R

#: Bytes of the training sample, rounds of training, cells at most, cells looked into first.
TRAIN_BYTES, ROUNDS, MOST_CELLS, FIRST = 64 << 20, 12, 4096, 4
#: Cosines are compared at topk.DIGITS; bounds give way by this much.
SLACK = 1e-8


def train(v: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit directions of cells: k-means++ starts, then spherical k-means; an empty cell moves to the worst placed vector."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(v)))]
    far = 1 - v @ v[chosen[0]]
    while len(chosen) < min(cells, len(v)):
        p = np.maximum(far, 0)
        if p.sum() <= 1e-9:
            break  # all vectors are among the chosen ones
        chosen.append(int(rng.choice(len(v), p=p / p.sum())))
        far = np.minimum(far, 1 - v @ v[chosen[-1]])
    c = v[chosen].copy()
    for _ in range(ROUNDS):
        own, near = nearest(v, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, v)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = v[np.argsort(near, kind="stable")[: len(empty)]]
        c = topk.unit(sums)
    return c


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, cosine) of each vector."""
    own, cos = np.empty(len(v), np.int64), np.empty(len(v))
    for a in range(0, len(v), 4096):
        s = v[a : a + 4096] @ c.T
        own[a : a + 4096] = s.argmax(axis=1)
        cos[a : a + 4096] = s.max(axis=1)
    return own, cos


def build(vectors: DataFrame, path: str, cells: int | None = None, keep: tuple[str, ...] = ()) -> int:
    """Store vectors(vec_id, embedding, and the columns to keep) as an index at path; the number of cells.

    Null ids and vectors, and vectors of another length than most, aren't stored. By default there are as many cells as
    the square root of the number of vectors. A cell with far more vectors than others is written by several tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), *keep).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).collect()
    d, n = (sizes[0]["d"], sizes[0]["count"]) if sizes else (R.DIMENSION, 0)
    rows = rows.where(F.size("embedding") == d)
    cells = cells or max(1, min(MOST_CELLS, round(n**0.5)))
    taken = rows.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(cells, TRAIN_BYTES // (8 * d))).collect() if n else []
    c = train(topk.unit(np.array([r[0] for r in taken], float)), cells) if taken else np.zeros((0, d))

    @released
    def place(batches):
        for b in batches:
            own, cos = nearest(topk.unit(topk.matrix(b.column(1), d)), c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arccos(np.clip(cos, -1, 1))), pa.array(own.astype(np.int32))], [*b.schema.names, "angle", "cell"])

    arrow_batches(spark)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", angle double, cell int"
    rows.mapInArrow(place, schema).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(schema).parquet(f"{path}/vectors")
    of_cells = {r["cell"]: r for r in stored.groupBy("cell").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("n")).collect()}
    listed = [(i, [float(x) for x in c[i]], r["widest"], r["n"]) for i, r in sorted(of_cells.items())]
    spark.createDataFrame(listed, "cell int, direction array<double>, widest double, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(json.dumps({"dimension": d, "metric": "cosine", "schema": schema}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_index")
    return len(listed)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int | None = None, condition: str | None = None, read: list[int] | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank) from the index at path: the k vectors of largest cosine, ties by vec_id.

    Exact; with probes, only the so many nearest cells of each query. condition: SQL over the kept columns; only such
    vectors count. read: gets the number of cells read by each step. Cells, a bounded list, and one block of queries at a
    time come to the driver; vectors stay where they are.
    """
    meta = json.loads(spark.read.text(f"{path}/_index").first()[0])
    stored = spark.read.schema(meta["schema"]).parquet(f"{path}/vectors")
    if condition:
        stored = stored.where(condition)
    listed = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    if not listed:
        return topk.ranked(spark.createDataFrame([], topk.SCHEMA), k)
    number, widest = np.array([r["cell"] for r in listed]), np.array([r["widest"] for r in listed])
    c = np.array([r["direction"] for r in listed])
    out = None
    for ids, q in topk.query_blocks(queries, c.shape[1]):
        angle = np.arccos(np.clip(q @ c.T, -1, 1))
        first = np.zeros(angle.shape, bool)
        np.put_along_axis(first, np.argsort(angle, axis=1, kind="stable")[:, : probes or FIRST], True, 1)

        def look(wanted: np.ndarray, ids=ids, q=q) -> DataFrame:
            by_cell = {int(number[i]): np.flatnonzero(wanted[:, i]) for i in np.flatnonzero(wanted.any(axis=0))}
            if read is not None:
                read.append(len(by_cell))
            rows = stored.where(F.col("cell").isin(list(by_cell))).select("vec_id", "embedding", "cell")
            return topk.ranked(topk.scored(rows, ids, q, k, by_cell.__getitem__), k).drop("rank")

        found = look(first)
        if probes is None:
            got = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect()
            least = np.full(len(ids), -2.0)
            at = {int(i): p for p, i in enumerate(ids)}
            for r in got:
                least[at[r["query_id"]]] = r["least"]
            reach = np.cos(np.maximum(0, angle - widest)) + SLACK
            rest = ~first & (reach >= least[:, None])
            if rest.any():
                found = found.unionByName(look(rest))
        out = found if out is None else out.unionByName(found)
    return topk.ranked(out if out is not None else spark.createDataFrame([], topk.SCHEMA), k)
