"""Embedding batches, vector upsert by namespace, and retrieval: cosine, rank fusion and its quality. BM25 is in text_index.py."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.operators import topk
from loomtext.operators.batches import greedy_batches
from loomtext.session import arrow_batches
from loomtext.sources import rules as R


def embed_batches(chunks: DataFrame, group: str = "doc_key", order: str = "chunk_index", max_tokens: int = R.EMBED_TOKENS, max_items: int = R.EMBED_ITEMS) -> DataFrame:
    """chunks(group, order, token_count) with batch, numbered in each group in order.

    A batch ends before the item that would take it over max_tokens, or when it has max_items; an item over the limit has
    one of its own. A group of any size is dealt to many tasks (batches.greedy_batches). A null order comes first, equal
    orders in order of their tokens; a null count is 0.
    """
    rows = chunks.select(F.col(group).cast("string").alias("g"), F.col(order).cast("long").alias("o"), F.col("token_count").cast("long").alias("n"))
    return greedy_batches(rows, max_tokens, max_items).select(F.col("g").alias(group), F.col("o").alias(order), F.col("n").alias("token_count"), "batch")


def token_share(batched: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each item's share: its batch's tokens divided by its number of items, rounded down."""
    w = Window.partitionBy(*keys)
    return batched.withColumn("share", F.floor(F.sum("token_count").over(w) / F.count(F.lit(1)).over(w)))


def hashed_vector(text: str, dim: int) -> list[float]:
    """An offline stand-in for an embedding service: signed hashed words, of unit length."""
    import zlib

    said = text.lower().split()
    h = np.fromiter(map(zlib.crc32, map(str.encode, said)), np.int64, len(said))
    v = np.bincount(h % dim, np.where(h >> 31, 1.0, -1.0), dim)
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


def hashed_batch(texts: list[str], dim: int) -> tuple[list[tuple[int, list[float]]], int]:
    """A batch as a service answers it: (index, vector) in any order, and the tokens used."""
    return [(i, hashed_vector(t, dim)) for i, t in enumerate(texts)], sum(len(t.split()) for t in texts)


def embed(chunks: DataFrame, embedder: Callable[[list[str], int], tuple[list[tuple[int, list[float]]], int]] = hashed_batch, dim: int = 64, max_items: int = R.EMBED_ITEMS, attempts: int = 3, wait: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """chunks(id, chunk_text) to (id, embedding, tokens) and the columns to keep; the embedder gets the texts of an Arrow batch, at most max_items.

    Answers may come in any order. A call that fails is made again, after wait, 2 * wait, .. seconds (30 at most), and
    the last error fails the task. tokens is each item's equal share of its call's usage, rounded down.
    """
    import pyarrow as pa

    arrow_batches(chunks.sparkSession)

    def call(texts: list[str]) -> tuple[list[tuple[int, list[float]]], int]:
        for left in range(attempts - 1, -1, -1):
            try:
                return embedder(texts, dim)
            except Exception:
                if not left:
                    raise
                time.sleep(min(30.0, wait * 2 ** (attempts - 1 - left)))
        raise ValueError("attempts must be at least 1")

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, max_items):
                part = b.slice(a, max_items)
                answers, used = call([t or "" for t in part.column(1).to_pylist()])
                vectors = [v for _, v in sorted(answers)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array(np.full(part.num_rows, used // part.num_rows)), *part.columns[2:]], ["id", "embedding", "tokens", *keep])

    rows = chunks.select(F.col("id").cast("string").alias("id"), "chunk_text", *keep)
    return rows.mapInArrow(run, "id string, embedding array<float>, tokens long" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep))


def namespaced(vectors: DataFrame) -> DataFrame:
    """vectors(id, source_name, embedding, ...) once under their source and once under all, with vector_id."""
    low = F.lower("source_name")
    return vectors.withColumn("vector_id", F.concat_ws("-", low, F.col("id").cast("string"))).withColumn("namespace", F.explode(F.array(low, F.lit("all"))))


def archive(vectors: DataFrame, day: str, model: str) -> DataFrame:
    """(key, payload) of vectors to archive: embeddings/day/vector_id/embeddings.json and its JSON."""
    payload = F.to_json(F.struct("vector_id", F.lit(model).alias("model"), "token_count", "embedding", "source_name", "source_url", "chunk_index", "metadata"))
    return vectors.select(F.concat_ws("/", F.lit("embeddings"), F.lit(day), "vector_id", F.lit("embeddings.json")).alias("key"), payload.alias("payload"))


def upsert_vectors(store: DataFrame, new: DataFrame) -> DataFrame:
    """store after new has replaced what has its (namespace, vector_id). Of new rows with one key the largest counts."""
    keys = ["namespace", "vector_id"]
    last = new.groupBy(*keys).agg(F.max(F.struct(*[c for c in store.columns if c not in keys])).alias("__n")).select(*keys, "__n.*")
    return store.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*store.columns))


def upsert_fallback(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """chunks(id, source_name, embedding, embedding_id, ...) with the vectors of results(id, embedding) written to their rows.

    Rows without a new vector, or with a null one, keep what they have; of repeated results the largest counts.
    """
    new = results.groupBy("id").agg(F.max("embedding").alias("__v"))
    vector_id = F.concat_ws("-", "source_name", F.col("id").cast("string"))
    got = chunks.join(new, "id", "left")
    return got.withColumn("embedding_id", F.when(F.col("__v").isNotNull(), vector_id).otherwise(F.col("embedding_id"))).withColumn("embedding", F.coalesce("__v", "embedding")).drop("__v")


def ensure_index(spark: SparkSession, path: str, dimension: int = R.DIMENSION, metric: str = "cosine") -> bool:
    """Make the vector table at path, partitioned by namespace, with its dimension and metric; False if it is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return False
    spark.createDataFrame([(dimension, metric)], "dimension int, metric string").coalesce(1).write.json(f"{path}/_index")
    spark.createDataFrame([], "vector_id string, embedding array<float>, metadata string, namespace string").write.partitionBy("namespace").parquet(f"{path}/vectors")
    return True


METADATA_FIELDS = ("source_name", "source_url", "chunk_index", "chunk_type", "word_count", "title", "section", "source_agency", "effective_date", "topic_tags", "property_types", "citizenship_types")


def vector_metadata(chunks: DataFrame) -> DataFrame:
    """id and the fixed fields that go with a vector; texts default to "", lists to empty ones."""
    m = lambda f, empty: F.coalesce(F.col(f"metadata.{f}"), empty).alias(f)
    none = F.array().cast("array<string>")
    return chunks.select("id", *METADATA_FIELDS[:5], *(m(f, F.lit("")) for f in METADATA_FIELDS[5:9]), *(m(f, none) for f in METADATA_FIELDS[9:]))


def set_embedding_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """chunks with the embedding_id of ids(id, embedding_id) where there is one."""
    new = ids.select("id", F.col("embedding_id").alias("__new"))
    return chunks.join(new, "id", "left").withColumn("embedding_id", F.coalesce("__new", "embedding_id")).drop("__new")


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score, rank): the k most similar vectors of each query, ties by vec_id.

    A task scores its vectors against all queries of a block, some rows and queries at a time, and passes on its own k
    best, so what is shuffled is k rows for each query and task. One scan takes queries of topk.QUERY_BYTES; more are
    taken in further scans. Null ids, and vectors of another length than the queries have, are left out.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    first = queries.where("embedding is not null").select(F.size("embedding").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    d, out = first["d"] if first else 0, None
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") == d))
    for ids, q in topk.query_blocks(queries, d):
        found = topk.scored(rows, ids, q, k)
        out = found if out is None else out.unionByName(found)
    return topk.ranked(out if out is not None else vectors.sparkSession.createDataFrame([], topk.SCHEMA), k)


def coordination(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the documents with the most distinct terms of each query, ties by doc_id."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\r\x0b\f]+"), lambda w: w != "")
    asked = queries.select("query_id", F.explode(F.array_distinct(words)).alias("term"))
    said = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("term"))
    scored = said.join(asked, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def holding(docs: DataFrame, queries: DataFrame, words: int = 8, share: float = 0.5) -> DataFrame:
    """(query_id, doc_id) of documents that have at least this share of a query's distinct runs of so many words."""
    split = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\r\x0b\f]+"), lambda w: w != "")

    def runs(df: DataFrame, key: str) -> DataFrame:
        listed = df.select(key, split.alias("w")).where(F.size("w") >= words)
        at = listed.select(key, F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.md5(F.array_join(F.slice("w", i, words), " ").cast("binary"))).alias("runs"))
        return at.select(key, F.explode(F.array_distinct("runs")).alias("run"))

    asked = runs(queries, "query_id")
    size = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    met = runs(docs, "doc_id").join(asked, "run").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    return met.join(size, "query_id").where(F.col("m") >= share * F.col("n")).select("query_id", "doc_id")


def rank_fusion(lists: list[DataFrame], k: int = 10, c: int = 60) -> DataFrame:
    """(query_id, doc_id, score, rank) from lists of (query_id, doc_id, rank): the sum of 1 / (c + rank)."""
    every = lists[0].select("query_id", "doc_id", "rank")
    for one in lists[1:]:
        every = every.unionByName(one.select("query_id", "doc_id", "rank"))
    scored = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expand_queries(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """queries(query_id, text) with the synonyms(term, synonym) of their words added."""
    words = queries.select("query_id", "text", F.explode_outer(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("term"))
    found = words.join(synonyms, "term", "left").groupBy("query_id", "text").agg(F.array_sort(F.collect_set("synonym")).alias("more"))
    return found.select("query_id", F.concat_ws(" ", "text", F.array_join("more", " ")).alias("text"))


def retrieval_quality(found: DataFrame, relevant: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Per query: precision and recall of found(query_id, doc_id) against relevant(query_id, doc_id); repeated pairs count once.

    Queries of either side, and of queries(query_id) where it is given, all have a row. What finds nothing has precision
    0, what has nothing relevant recall 0.
    """
    pairs = [df.select("query_id", "doc_id").distinct() for df in (found, relevant)]
    both = pairs[0].withColumn("f", F.lit(1)).join(pairs[1].withColumn("r", F.lit(1)), ["query_id", "doc_id"], "full")
    if queries is not None:
        none = queries.select("query_id").distinct().select("query_id", F.lit(None).cast(both.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("int").alias("f"), F.lit(None).cast("int").alias("r"))
        both = both.unionByName(none)
    n = both.groupBy("query_id").agg(F.count("f").alias("returned"), F.count(F.col("f") + F.col("r")).alias("hits"), F.count("r").alias("relevant"))
    share = lambda of: F.when(F.col(of) > 0, F.col("hits") / F.col(of)).otherwise(0.0)
    return n.withColumn("precision", share("returned")).withColumn("recall", share("relevant"))
