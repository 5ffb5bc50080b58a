"""Incremental core: what is left to do, snapshot comparison, upsert and job log. Only keys and hashes meet in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import native as N


def unprocessed(raw: DataFrame, sources: DataFrame, chunks: DataFrame, source: str | None = None) -> DataFrame:
    """raw(document_id, source_id, html, text, ...) with a page or a text and no chunks yet, with the source's code.

    sources is a dimension; Spark broadcasts it if its size is known to be small.
    """
    have = raw.where("html is not null or text is not null")
    dim = sources.select(F.col("id").alias("source_id"), "code")
    if source is not None:
        dim = dim.where(F.lower("code") == source.lower())
    return have.join(dim, "source_id").join(chunks.select("document_id").distinct(), "document_id", "left_anti")


def unembedded(chunks: DataFrame, raw: DataFrame, sources: DataFrame, source: str | None = None) -> DataFrame:
    """Chunks without an embedding_id, with their document's url and source; missing fields get their defaults."""
    dim = sources.select(F.col("id").alias("source_id"), F.col("code").alias("source_name"))
    if source is not None:
        dim = dim.where(F.lower("source_name") == source.lower())
    docs = raw.select("document_id", "source_id", F.col("url").alias("source_url")).join(dim, "source_id")
    path = F.coalesce(F.from_json("heading_path", "array<struct<level:int,text:string>>"), F.array().cast("array<struct<level:int,text:string>>"))
    rows = chunks.where("embedding_id is null").join(docs, "document_id")
    return rows.withColumn("heading_path", path).withColumn("chunk_type", F.coalesce("chunk_type", F.lit("text"))).withColumn("content_type", F.lit("html"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source_id", "url"), hash_col: str = "content_hash") -> DataFrame:
    """(keys, old_hash, new_hash, change): new, modified, unchanged or deleted."""
    a = old.select(*keys, F.col(hash_col).alias("old_hash"), F.lit(True).alias("__old"))
    b = new.select(*keys, F.col(hash_col).alias("new_hash"), F.lit(True).alias("__new"))
    change = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "deleted").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("modified")
    return a.join(b, list(keys), "full_outer").select(*keys, "old_hash", "new_hash", change.alias("change"))


#: What stays of a page that has changed; all other columns that the new rows have are overwritten.
LASTING = ("id", "document_id", "content_type", "last_modified")


def merge_documents(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source_id", "url")) -> DataFrame:
    """The table after an upsert: absent keys are inserted and changed ones overwritten, both as pending; the rest stays.

    One shuffle on the keys. Of several new rows with one key the last by crawled_at counts (then the larger hash).
    """
    latest = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in new.columns if c not in keys]), F.struct("crawled_at", "content_hash")).alias("n"))
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o"))
    joined = o.join(latest, list(keys), "full_outer")
    hit = F.col("n").isNotNull() & (F.col("o").isNull() | ~F.col("o.content_hash").eqNullSafe(F.col("n.content_hash")))
    fields = []
    for c in old.columns:
        if c in keys:
            fields.append(F.col(c))
        elif c == "status":
            fields.append(F.when(hit, F.lit("pending")).otherwise(F.col("o.status")).alias(c))
        elif c not in LASTING and c in new.columns:
            fields.append(F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in new.columns:
            fields.append(F.when(F.col("o").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            fields.append(F.col(f"o.{c}").alias(c))
    return joined.select(*fields)


def job_log(diff: DataFrame, source_id: str = "source_id") -> DataFrame:
    """Per source: pages found, new, changed and deleted."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return diff.groupBy(source_id).agg(n("new", "modified", "unchanged").alias("pages_found"), n("new").alias("pages_new"), n("modified").alias("pages_changed"), n("deleted").alias("pages_deleted"))


def crawl_jobs(runs: DataFrame, counts: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows of crawl_jobs for runs(source_id, job_type, started_at, completed_at, failure).

    counts: job_log(); errors(source_id, url, error). A run with a failure has failed, without an end it is running, else
    it is completed; only a completed one has counts, and its errors as a sorted list in metadata_json.
    """
    said = errors.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages_errored"), F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("url", "error"))).alias("errors"))).alias("metadata_json"))
    done = F.col("status") == "completed"
    n = lambda c: F.when(done, F.coalesce(c, F.lit(0)).cast("int")).otherwise(0).alias(c)
    rows = runs.withColumn("status", F.when(F.col("failure").isNotNull(), "failed").when(F.col("completed_at").isNull(), "running").otherwise("completed"))
    joined = rows.join(counts, "source_id", "left").join(said, "source_id", "left")
    key = F.sha2(F.concat_ws("|", "source_id", "job_type", F.col("started_at").cast("string")).cast("binary"), 256).alias("id")
    return joined.select(key, "source_id", "job_type", "status", n("pages_found"), n("pages_new"), n("pages_changed"), n("pages_deleted"), n("pages_errored"), "started_at", "completed_at", F.col("failure").alias("error_message"), F.when(done, F.col("metadata_json")).alias("metadata_json"))


def mark_processed(raw: DataFrame, written: DataFrame) -> DataFrame:
    """raw with status processed where this run wrote chunks."""
    done = written.select("document_id").distinct().withColumn("__done", F.lit(True))
    return raw.join(done, "document_id", "left").withColumn("status", F.when(F.col("__done"), "processed").otherwise(F.col("status"))).drop("__done")


def ensure_sources(have: DataFrame, wanted: DataFrame) -> DataFrame:
    """have, and those of wanted whose code it lacks; rows that are there stay as they are."""
    return have.unionByName(wanted.join(have.select("code"), "code", "left_anti").select(*have.columns))


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunks(document_id, chunk_index, ...) with an id that a repeated run gives again, and total_chunks."""
    from pyspark.sql import Window

    key = F.sha2(F.concat_ws("|", "document_id", F.col("chunk_index").cast("string")).cast("binary"), 256)
    return chunks.withColumn("id", key).withColumn("total_chunks", F.count(F.lit(1)).over(Window.partitionBy("document_id")))


def content_keys(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with content and url hashes, and how many pages share the content."""
    rows = pages.select("page_id", "url", N.content_hash("html").alias("content_hash"), N.url_hash("url").alias("url_hash"))
    copies = rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("first_page"))
    joined = rows.join(copies.withColumnRenamed("content_hash", "__hash"), F.col("content_hash").eqNullSafe(F.col("__hash")), "left")  # a hot hash is split, as its row is repeated
    return joined.select("page_id", "url", "content_hash", "url_hash", "copies", "first_page")
