"""Exact deduplication as a stateful stream, with DataFrame and streaming operations only.

Rows land as (digest, identifier, locator). A stream over them keeps one keyed entry for each digest, without expiry,
in the RocksDB state store on disk: the largest identifier, where its content is, and how many rows had the digest.
Later rows only update their entry, so the stream may go on for as long as data arrive. Digests that more than one
row has are hits; their full texts are compared, aggregated below the shuffle so that a hot group sends one text for
each task. Should one digest ever stand for different texts, those rows are grouped by the whole text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import arrow_batches, cut, drop_path, is_table, shared_dir, without

#: A list of hit digests is broadcast up to this many; beyond it, the texts are shuffled to it.
BROADCAST_DIGESTS = 100_000


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def landed_digests(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """(digest, doc_id, file, row) of a table read from files; file and row locate the content."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(digest(text).alias("digest"), F.col(id_col).cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def keyed_state(spark: SparkSession, stream: DataFrame, checkpoint: str) -> DataFrame:
    """Bring the state up to date with what the stream has now, and read it: digest, keep_id, file, row, group_size.

    Call it again with the same checkpoint when more data have arrived; only new files are read.
    """
    conf = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores would each set space aside
        "spark.sql.streaming.minBatchesToRetain": "1",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        # nulls lose against any identifier, and among equal identifiers the first place wins
        rank = F.struct(F.col("doc_id"), F.struct((-F.col("row")).alias("row"), F.col("file").alias("file")).alias("place"))
        state = stream.groupBy("digest").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
        state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        store = spark.read.format("statestore").load(checkpoint)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    best, size = (f"value.`{name}`" for name in store.schema["value"].dataType.names)
    return store.select(F.col("key.digest").alias("digest"), F.col(f"{best}.doc_id").alias("keep_id"), F.col(f"{best}.place.file").alias("keep_file"), (-F.col(f"{best}.place.row")).alias("keep_row"), F.col(size).alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", from_files: bool | None = None, digest=sha256) -> DataFrame:
    """One row for each row of docs: doc_id, file, row (its locator), keep_id, group_size, kept, text_sha256.

    from_files: docs is one table just as it was read from files, so that its rows have lasting locators (found out by
    default); otherwise it is written to the shared folder first. Null texts are empty and form one group with empty ones. Null ids lose
    against others. Of rows that share both text and id, the first in file order stays. Very long texts are compared
    whole. An empty table gives no rows. Other columns play no part, whatever their names.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    base = shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not (is_table(docs) if from_files is None else from_files):
        docs = cut(rows, f"{base}/rows")
        id_col, text_col = "doc_id", "text"
    landed = cut(landed_digests(docs, id_col, text_col, digest), f"{base}/landed")
    state = cut(keyed_state(spark, spark.readStream.schema(landed.schema).parquet(f"{base}/landed"), f"{base}/stream"), f"{base}/state")
    drop_path(spark, f"{base}/stream")
    joined = landed.join(state, "digest")
    first = F.col("file").eqNullSafe(F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    alike = joined.select("doc_id", "file", "row", "keep_id", "group_size", first.alias("kept"), F.col("digest").alias("text_sha256"))

    hits = state.where("group_size > 1").select("digest")
    n = hits.count()
    if not n:
        return alike
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    compared = texts.join(F.broadcast(hits) if n <= BROADCAST_DIGESTS else hits, "digest", "left_semi")
    clashes = cut(compared.groupBy("digest").agg(F.size(F.collect_set("text")).alias("texts")).where("texts > 1").select("digest"), f"{base}/clashes")
    if clashes.isEmpty():
        return alike
    # One digest, several texts: group those rows by the whole text.
    located = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    located = located.withColumn("digest", digest(F.col("text"))).join(clashes, "digest", "left_semi")
    groups = located.groupBy("text").agg(F.max(F.struct("doc_id", F.struct((-F.col("row")).alias("row"), "file").alias("place"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    apart = located.join(groups, "text").select("doc_id", "file", "row", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("file").eqNullSafe(F.col("best.place.file")) & (F.col("row") == -F.col("best.place.row"))).alias("kept"), F.col("digest").alias("text_sha256"))
    return alike.join(clashes, alike["text_sha256"] == clashes["digest"], "left_anti").unionByName(apart)


def dedup_stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", from_files: bool | None = None) -> DataFrame:
    """docs without the rows that exact_dedup() drops, with all columns."""
    spark = docs.sparkSession
    if not (is_table(docs) if from_files is None else from_files):
        docs = cut(docs, f"{shared_dir(spark)}/docs")
    dropped = exact_dedup(docs, id_col, text_col, from_files=True).where(~F.col("kept")).select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    dropped = cut(dropped, f"{shared_dir(spark)}/dropped", 2 * docs.count())
    names = docs.columns
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    kept = without(placed, dropped, (placed["__file"] == dropped["__file"]) & (placed["__row"] == dropped["__row"]), dropped.count())
    return kept.select(*[F.col(f"__doc.`{c}`").alias(c) for c in names])
