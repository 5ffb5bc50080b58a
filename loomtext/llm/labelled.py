"""A bounded sample of labelled rows, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import crc_mod, text_rows


def held_out() -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, mod 3, is 1."""
    return crc_mod("doc_id", 3) == 1


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most `each` training rows of each class, least hash of the id first; and the classes' sizes.

    Labels other than 0 and 1, null ids and ids without a document are left out; an id labelled twice counts with its
    larger label. The ids, at most 2 * each, are broadcast to the documents.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = known.where("label = 0").orderBy(order, "doc_id").limit(each).unionByName(known.where("label = 1").orderBy(order, "doc_id").limit(each))
    rows = [(r["doc_id"], r["label"]) for r in chosen.collect()]
    ids = docs.sparkSession.createDataFrame(rows or [(None, None)], "doc_id long, label int")
    return text_rows(docs, id_col, text_col).join(F.broadcast(ids), "doc_id"), sizes
