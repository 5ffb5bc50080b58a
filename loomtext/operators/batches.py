"""Greedy batches whose cuts depend on all items before them, found without one task for a group.

Where a batch that begins at an item ends depends only on that item and the next max_items ones. Groups are cut into
pieces of equal numbers of items. Each piece, with the first items of the next one, follows every possible first cut to
where it leaves the piece and counts the batches on the way; these small tables are followed from piece to piece of a
group; then every piece, told its first cut, numbers its own items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import arrow_batches, cut, released, shared_dir


def next_cuts(n: np.ndarray, size: int, max_tokens: int, max_items: int) -> np.ndarray:
    """Of the first `size` items: where the batch that begins there ends. n also has what follows, max_items items if there are."""
    sums = np.concatenate([[0], np.cumsum(n)])
    start = np.arange(size)
    fits = np.searchsorted(sums, sums[:size] + max_tokens, "right") - 1
    return np.maximum(start + 1, np.minimum(fits, start + max_items))


def ways(cuts: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first cuts 0 .. entries - 1: how far into the next piece it leads, and over how many batches."""
    size = len(cuts)
    leave, count = [0] * size, [0] * size
    for i, t in zip(range(size - 1, -1, -1), cuts[::-1].tolist(), strict=True):
        leave[i], count[i] = (t - size, 1) if t >= size else (leave[t], count[t] + 1)
    return np.array(leave[:entries]), np.array(count[:entries])


def greedy_batches(items: DataFrame, max_tokens: int, max_items: int, piece: int = 50_000) -> DataFrame:
    """items(g string, o long, n long) with batch, an int from 0 in each g, in order of o and n. Null g is a group, null o comes first."""
    spark = items.sparkSession
    arrow_batches(spark)
    base, piece = shared_dir(spark, "batches"), max(piece, max_items)
    rows = items.select(F.when(F.col("g").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "g")).alias("g"), "o", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).alias("n"))
    # The place of each item in its group: within its range, and the sizes of the ranges before.
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = cut(rows.repartitionByRange(ranges, "g", "o", "n").withColumn("p", F.spark_partition_id()), f"{base}/dealt")
    sizes = dealt.groupBy("g", "p").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("g", "p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("g", "p").orderBy("o", "n")) - 1
    placed = dealt.withColumn("i", own).join(offsets, ["g", "p"]).select("g", "o", "n", (F.col("i") + F.col("before")).alias("i"))
    pieces = placed.groupBy("g", F.floor(F.col("i") / piece).alias("q")).agg(F.array_sort(F.collect_list(F.struct("i", "o", "n"))).alias("r"))
    pieces = cut(pieces.select("g", "q", F.transform("r", lambda r: r["o"]).alias("o"), F.transform("r", lambda r: r["n"]).alias("n")), f"{base}/pieces")
    heads = pieces.select("g", (F.col("q") - 1).alias("q"), F.slice("n", 1, max_items).alias("more"))
    known = pieces.join(heads, ["g", "q"], "left").select("g", "q", F.coalesce("more", F.array().cast("array<bigint>")).alias("more"), "n", "o")

    def cuts_of(b: pa.RecordBatch, row: int) -> np.ndarray:
        n, more = (np.array(b.column(c)[row].as_py(), np.int64) for c in (3, 2))
        return next_cuts(np.concatenate([n, more]), len(n), max_tokens, max_items)

    @released
    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [ways(cuts_of(b, i), max_items) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([g[i].tolist() for g in got], pa.list_(pa.int32())) for i in (0, 1))], ["g", "q", "leave", "count"])

    @released
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, entry, number = None, 0, 0
        for b in batches:
            out = []
            for g, leave, count in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if g != group:
                    group, entry, number = g, 0, 0
                out.append((entry, number))
                if entry < len(leave):
                    entry, number = leave[entry], number + count[entry]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([e for e, _ in out], pa.int32()), pa.array([n for _, n in out], pa.int32())], ["g", "q", "entry", "number"])

    @released
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cuts = cuts_of(b, i).tolist()
                begins = np.zeros(len(cuts), np.int32)
                at, first = b.column(5)[i].as_py(), b.column(6)[i].as_py()
                while at < len(cuts):
                    begins[at] = 1
                    at = cuts[at]
                batch = (np.cumsum(begins) + first - 1).astype(np.int32)
                size = len(cuts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * size)), b.column(4)[i].values, b.column(3)[i].values, pa.array(batch)], ["g", "o", "n", "batch"])

    tables = known.mapInArrow(table, "g string, q long, leave array<int>, count array<int>")
    entries = tables.repartition("g").sortWithinPartitions("g", "q").mapInArrow(follow, "g string, q long, entry int, number int")
    done = known.join(entries, ["g", "q"]).select("g", "q", "more", "n", "o", "entry", "number").mapInArrow(number, "g string, o long, n long, batch int")
    return done.withColumn("g", F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)))
