"""A BM25 index: postings stored by term, with the largest weights of terms (of frequent ones in each block), and pruned top-k search.

A task counts the words of its documents; postings go through one shuffle and are stored in buckets of terms. Documents
belong to blocks of about BLOCK by the hash of their id. A search first scores the documents of each query's rarest words
in full, which gives a score that the k-th best reaches at least. Terms whose largest weights together stay below it are
not essential: a document with no other term can't be among the best. Only the lists of essential terms are read for
candidates; candidates whose partial score and the maxima of the other terms in their block stay below are dropped; the
rest get their full score. So a frequent word's list is opened only for the documents that may win. The result is exact.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.session import arrow_batches, cut, released

BLOCK, BUCKETS = 128, 16
#: Words of at least N / SHARE documents are frequent.
SHARE = 8
#: The rarest words of a query whose best documents, so many for each row of the result, give the first bound.
RAREST, SEEDS = 3, 4
#: Scores are compared at this many digits; bounds give way by SLACK.
DIGITS, SLACK = 9, 1e-6
#: Postings in one batch of a task's output.
POSTINGS = 20_000
_TABLE = str.maketrans(dict.fromkeys("\t\n\r\x0b\f", " "))
_WEIGHT = "tf * (1 + {k1}D) / (tf + {k1}D * (1 - {b}D + {b}D * len / {mean}D))"
SCHEMA = "term string, doc_id long, len int, tf int, block long, bucket int"


def build(docs: DataFrame, path: str, k1: float = 1.5, b: float = 0.75) -> None:
    """Store the postings of docs(doc_id, text) at path. Words are lower-cased and split at blanks; null texts are empty.

    Ids are keys: rows that repeat an id are read as further documents of that id, whose weights add up. Null ids are
    left out of the results but not of the statistics.
    """
    spark = docs.sparkSession
    arrow_batches(spark)

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [])

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["term", "doc_id", "len", "tf"])
            for c in out:
                c.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = Counter(text.translate(_TABLE).split(" "))
                got.pop("", None)
                size = got.total()
                got[""] = 1  # no word is empty: this one stands for the document
                for c, more in zip(out, (got.keys(), [doc] * len(got), [size] * len(got), got.values()), strict=True):
                    c.extend(more)
                if len(out[0]) >= POSTINGS:
                    yield given()
        yield given()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    blocks = max(1, rows.count() // BLOCK)
    postings = rows.mapInArrow(count, "term string, doc_id long, len int, tf int").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).withColumn("bucket", _bucket())
    # A bucket is dealt to several tasks by block, so that a frequent word's list is written by many.
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // BUCKETS)
    postings.repartition("bucket", F.pmod("block", F.lit(spread))).sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(SCHEMA).parquet(f"{path}/postings")
    n, mean = stored.where(_is("")).agg(F.count(F.lit(1)), F.avg("len")).first()
    mean = float(mean or 0.0) or 1.0
    weight = F.expr(_WEIGHT.format(k1=k1, b=b, mean=mean))
    words = stored.where("term <> '' and doc_id is not null")
    terms = cut(words.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"), F.max(weight).alias("most")), f"{path}/terms")
    # Frequent words, at most SHARE times as many as a document has on average, have maxima for each block, too.
    often = terms.where(F.col("df") * SHARE >= n).select("bucket", "term")
    cut(words.join(F.broadcast(often), ["bucket", "term"]).groupBy("bucket", "term", "block").agg(F.max(weight).alias("most")), f"{path}/maxima")
    spark.createDataFrame([(json.dumps({"n": n, "mean": mean, "k1": k1, "b": b}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_index")


def _bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _is(term: str):
    return (F.col("bucket") == F.pmod(F.xxhash64(F.lit(term)), F.lit(BUCKETS)).cast("int")) & (F.col("term") == term)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, scratch: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) for queries(query_id, text) from the index at path; ties by doc_id. Exact.

    scratch: a folder for what several steps read (by default below path): asked terms, first scores, candidates.
    """
    scratch = scratch or f"{path}/scratch"
    meta = json.loads(spark.read.text(f"{path}/_index").first()[0])
    postings = spark.read.schema(SCHEMA).parquet(f"{path}/postings").where("doc_id is not null").withColumn("w", F.expr(_WEIGHT.format(**meta)))
    key = ["bucket", "term"]
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\r\x0b\f]+"), lambda w: w != "")
    asked = queries.select("query_id", F.explode(words).alias("term")).distinct().withColumn("bucket", _bucket())
    idf = F.log(1 + (F.lit(float(meta["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    by_most = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
    known = asked.join(spark.read.parquet(f"{path}/terms").withColumn("idf", idf), key).select("query_id", *key, "df", "idf", (F.col("most") * F.col("idf")).alias("most"))
    # below: what a term and all terms of smaller maxima can give together
    known = cut(known.withColumn("place", F.row_number().over(by_most)).withColumn("below", F.sum("most").over(by_most.rowsBetween(0, Window.unboundedFollowing))), f"{scratch}/known")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")

    def partial(terms: DataFrame) -> DataFrame:
        """(query_id, doc_id, block, score) of all documents in the lists of terms."""
        hits = postings.join(terms.select("query_id", *key, "idf"), key)
        return hits.groupBy("query_id", "doc_id", "block").agg(F.sum(F.col("w") * F.col("idf")).alias("score"))

    def full(candidates: DataFrame, which: DataFrame) -> DataFrame:
        """candidates(query_id, doc_id, block, score) with the weights of the terms in which added: lists are opened for them only."""
        wanted = candidates.select("query_id", "doc_id").join(which.select("query_id", *key, "idf"), "query_id")
        more = postings.select(*key, "doc_id", "w").join(wanted, [*key, "doc_id"]).select("query_id", "doc_id", (F.col("w") * F.col("idf")).alias("score"))
        return candidates.select("query_id", "doc_id", "score").unionByName(more).groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), DIGITS).alias("score"))

    some = partial(known.where(F.col("place") <= RAREST)).withColumn("at", F.row_number().over(best)).where(F.col("at") <= SEEDS * k)
    first = full(some, known.where(F.col("place") > RAREST)).withColumn("rank", F.row_number().over(best))
    least = cut(first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")), f"{scratch}/least")
    told = known.join(least, "query_id", "left").withColumn("essential", F.col("least").isNull() | (F.col("below") + SLACK >= F.col("least")))
    rest = told.where("not essential").groupBy("query_id").agg(F.sum("most").alias("rest"))
    near = partial(told.where("essential")).join(least, "query_id", "left").join(rest, "query_id", "left")
    near = cut(near.where(F.col("least").isNull() | (F.col("score") + F.coalesce("rest", F.lit(0.0)) + SLACK >= F.col("least"))).drop("rest"), f"{scratch}/near")
    # The same with the maxima of each candidate's own block, for frequent terms; the others keep their own.
    weak = told.where("not essential")
    often = F.col("df") * SHARE >= F.lit(meta["n"])
    seldom = weak.where(~often).groupBy("query_id").agg(F.sum("most").alias("seldom"))
    blocks = near.select("query_id", "block").distinct().join(weak.where(often).select("query_id", *key, "idf"), "query_id")
    maxima = spark.read.parquet(f"{path}/maxima").select(*key, "block", "most").join(blocks, [*key, "block"])
    own = maxima.groupBy("query_id", "block").agg(F.sum(F.col("most") * F.col("idf")).alias("own"))
    bound = F.col("score") + F.coalesce("own", F.lit(0.0)) + F.coalesce("seldom", F.lit(0.0))
    left = near.join(own, ["query_id", "block"], "left").join(seldom, "query_id", "left").where(F.col("least").isNull() | (bound + SLACK >= F.col("least")))
    scored = full(cut(left, f"{scratch}/left"), told.where("not essential"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def expand(spark: SparkSession, path: str, queries: DataFrame, docs: int = 5, words: int = 5, scratch: str | None = None) -> DataFrame:
    """queries(query_id, text) with their first `words` new words from the `docs` best documents of each, by pseudo relevance feedback.

    A word's weight is the sum of its shares of these documents' words, times ln(N / df); ties by the word. Words of the
    query aren't added again. Queries that find nothing stay as they are; a null text is empty. Words come in
    alphabetical order.
    """
    scratch = scratch or f"{path}/feedback"
    n = json.loads(spark.read.text(f"{path}/_index").first()[0])["n"]
    asked = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    best = cut(search(spark, path, asked, docs, f"{scratch}/search").select("query_id", "doc_id"), f"{scratch}/best")
    held = spark.read.schema(SCHEMA).parquet(f"{path}/postings").where("term <> ''").join(best, "doc_id")
    share = held.groupBy("query_id", "term").agg(F.sum(F.col("tf") / F.col("len")).alias("share"))
    own = asked.select("query_id", F.explode(F.split(F.lower("text"), r"[ \t\n\r\x0b\f]+")).alias("term"))
    fresh = share.join(own, ["query_id", "term"], "left_anti").join(spark.read.parquet(f"{path}/terms").select("term", "df"), "term")
    weighed = fresh.withColumn("weight", F.round(F.col("share") * F.log(F.lit(float(n)) / F.col("df")), DIGITS))
    top = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    more = weighed.withColumn("place", F.row_number().over(top)).where(F.col("place") <= words).groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("more"))
    return asked.join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "text", F.array_join("more", " ")).alias("text"))


def pruned(spark: SparkSession, path: str, scratch: str | None = None) -> dict[str, int]:
    """Of the last search: postings of all asked terms, candidates of essential terms, and those scored in full."""
    scratch = scratch or f"{path}/scratch"
    every = spark.read.parquet(f"{scratch}/known").agg(F.sum("df")).first()[0] or 0
    return {"postings": every, "candidates": spark.read.parquet(f"{scratch}/near").count(), "scored": spark.read.parquet(f"{scratch}/left").count()}
