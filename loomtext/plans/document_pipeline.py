"""The whole batch: pages and texts to validated chunks, and chunks to vectors. Lazy; errors are a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import native as N
from loomtext.operators import chunk, extract, merge, validate, vectors
from loomtext.sources import rules as R


def process(pages: DataFrame | None, texts: DataFrame | None, tokens: str = "bpe", size: int = R.CHUNK_TOKENS, overlap: int = R.CHUNK_OVERLAP, least: int = R.LEAST_TOKENS, most: int = R.MOST_TOKENS) -> DataFrame:
    """pages(page_id, url, source, html) and texts(doc_id, source, text) to checked chunks; see validate.checked()."""
    parts = []
    if pages is not None:
        got = extract.extract_pages(pages).where("error is null")
        parts.append(got.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("doc_key"), "url", "source", F.lit("html").alias("content_type"), "title", "text", "headings", "tables"))
    if texts is not None:
        none = lambda t: F.array().cast(t)
        parts.append(texts.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_key"), F.lit("").alias("url"), "source", F.lit("html").alias("content_type"), F.lit("").alias("title"), "text", none(extract.HEADINGS).alias("headings"), none(extract.TABLES).alias("tables")))
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.unionByName(p)
    docs = docs.withColumn("metadata", N.metadata("text", "headings", "title", "source"))
    made = chunk.chunks(docs, size, overlap, tokens)
    made = made.withColumn("document_metadata", F.col("metadata")).withColumn("metadata", F.create_map(F.lit("source_agency"), F.col("metadata.source_agency"), F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("chunk_type"), F.col("chunk_type")))
    # one shuffle for all that follows: the windows over a document's chunks are satisfied by it
    return validate.checked(made.repartition("doc_key"), least, most)


def to_rows(checked: DataFrame) -> DataFrame:
    """What is stored of each kept chunk: a repeatable id, its number and how many its document has."""
    rows = validate.kept(checked).withColumnRenamed("doc_key", "document_id")
    return merge.with_chunk_ids(rows).select("id", "document_id", "chunk_text", "chunk_index", "total_chunks", "token_count", "word_count", "chunk_type", F.to_json("heading_path").alias("heading_path"), "source_url", "source_name", "document_metadata", F.lit(None).cast("string").alias("embedding_id"))


def vectors_of(rows: DataFrame, dim: int = 64, embedder=vectors.hashed_batch) -> DataFrame:
    """(namespace, vector_id, id, embedding) of rows that have no embedding yet."""
    todo = rows.where("embedding_id is null")
    made = vectors.embed(todo, embedder, dim, keep=("source_name",))
    return vectors.namespaced(made).select("namespace", "vector_id", "id", "embedding")
