"""As-of joins: what was in force at each place, by one ordered union and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def heading_paths(places: DataFrame, headings: DataFrame, levels: int = 6) -> DataFrame:
    """places(doc_key, start) with path: the headings(doc_key, at, level, text) in force there, by rising level.

    A heading is in force from its place on until one of its own or a lower level. Headings and places are sorted
    together, once; the last heading of each level is carried along, and counts if no lower one is nearer. Headings of
    one place count in order of level, then text. A null level or place is no heading. Repeated places keep their rows.
    """
    h = headings.where(F.col("level").between(1, levels) & F.col("at").isNotNull()).select("doc_key", F.col("at").cast("long").alias("at"), F.lit(0).alias("kind"), "level", "text")
    p = places.select("doc_key", F.col("start").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("text"))
    order = Window.partitionBy("doc_key").orderBy("at", "kind", "level", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = h.unionByName(p).withColumn("n", F.row_number().over(order))
    last = [F.last(F.when(F.col("level") == k, F.struct("n", "level", "text")), ignorenulls=True).over(upto).alias(f"l{k}") for k in range(1, levels + 1)]
    held = both.select("doc_key", "at", "kind", *last).where("kind = 1")
    nearer = lambda k: F.greatest(*[F.coalesce(F.col(f"l{j}.n"), F.lit(0)) for j in range(1, k)], F.lit(0)) if k > 2 else F.coalesce(F.col("l1.n"), F.lit(0)) if k == 2 else F.lit(0)
    path = F.array_compact(F.array(*[F.when(F.col(f"l{k}.n") > nearer(k), F.struct(F.col(f"l{k}.level").alias("level"), F.col(f"l{k}.text").alias("text"))) for k in range(1, levels + 1)]))
    return held.select("doc_key", F.col("at").alias("start"), path.alias("path"))
