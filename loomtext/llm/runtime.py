"""Helpers shared by the operators: their rows, ids and lists of keys; and the session's, passed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.session import arrow_batches, cut, drop_path, give_back, released, shared_dir

__all__ = ["arrow_batches", "crc_mod", "cut", "drop_path", "give_back", "is_table", "partitions", "released", "shared_dir", "text_rows", "without"]


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, don't reach an operator. A null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, mod n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Key lists up to this length are broadcast (tens of bytes each); longer ones are shuffled.
BROADCAST_KEYS = 300_000


def without(docs: DataFrame, keys: DataFrame, on: Column, n: int) -> DataFrame:
    """docs without rows that meet one of the n keys. Texts move only if the keys are too many to broadcast."""
    return docs.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, on, "left_anti")


def is_table(docs: DataFrame) -> bool:
    """Whether docs is one table just as it was read from files, whose rows so have a lasting file and place."""
    return docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
