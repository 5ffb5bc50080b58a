"""Breadth-first link frontier: each round follows the links of the last one's pages that weren't visited."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import cut, shared_dir


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(url, depth) of all that seeds(url) reach over edges(src, dst), until a round finds no new one.

    A written table cuts each round's lineage; what was visited is read as one table, so plans don't grow with depth.
    """
    spark, base = edges.sparkSession, shared_dir(edges.sparkSession, "frontier")
    links = cut(edges.select("src", "dst").distinct(), f"{base}/edges")
    schema = "url string, depth int"

    def visited(depths: str = "*") -> DataFrame:
        return spark.read.schema(schema).parquet(f"{base}/visited/round={depths}")

    front, depth = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)), f"{base}/visited/round=0"), 0
    while not front.isEmpty():
        depth += 1
        found = links.join(front, links["src"] == front["url"], "left_semi").select(F.col("dst").alias("url")).distinct()
        front = cut(found.join(visited(), "url", "left_anti").withColumn("depth", F.lit(depth)), f"{base}/visited/round={depth}")
    return visited()


def _numbered(rows: DataFrame, order: tuple[str, ...], first: int, path: str) -> tuple[DataFrame, int]:
    """rows with `visit`, their place in this order from `first` on, and how many they are. Ranges are numbered apart and
    shifted by the sizes of those before, so no task sees all rows."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = cut(rows.repartitionByRange(max(2, parts), *order).withColumn("part", F.spark_partition_id()), path)
    shifts, total = [], first
    for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        shifts += [F.lit(r["part"]), F.lit(total)]
        total += r["n"]
    if not shifts:
        return dealt.withColumn("visit", F.lit(0).cast("long")).drop("part"), 0
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("visit", (F.element_at(F.create_map(*shifts), F.col("part")) + place).cast("long")).drop("part"), total - first


def crawl_order(links: DataFrame, seeds: DataFrame, follow: Callable[[Column], Column] | None = None, allowed: Callable[[DataFrame], DataFrame] | None = None, inline_pdfs: bool = False) -> DataFrame:
    """(url, depth, visit, fetched, inline) of a first-in-first-out crawl from seeds(url, position) over links(src, position, url).

    visit is the order in which urls are taken from the queue: seeds by position, then the links of each page in turn.
    A url counts once, where it comes first. follow(url) says which links are queued; allowed(urls) gives those that
    robots let be fetched: the others are visited, not fetched, and lead nowhere. With inline_pdfs, links that end in
    .pdf are fetched with the first page that has them, whatever follow says and whatever host they are on, and carry
    that page's visit; their own links aren't read. Pages without links end their branch. Null urls are left out.
    """
    spark, base = links.sparkSession, shared_dir(links.sparkSession, "crawl")
    is_pdf = F.lower(F.col("url")).endswith(".pdf")
    known = cut(links.where("src is not null and url is not null").groupBy("src", "url").agg(F.min("position").alias("position")), f"{base}/links")
    queued = known if follow is None else known.where(follow(F.col("url")))
    if inline_pdfs:
        queued = queued.where(~is_pdf)
    schema = "url string, depth int, visit long, fetched boolean"

    def visited() -> DataFrame:
        return spark.read.schema(schema).parquet(f"{base}/visited/round=*")

    found = seeds.where("url is not null").groupBy("url").agg(F.min("position").cast("long").alias("parent")).withColumn("position", F.lit(0))
    depth, total = 0, 0
    while True:
        front, n = _numbered(found, ("parent", "position", "url"), total, f"{base}/found{depth}")
        total += n
        may = allowed(front.select("url")).select("url").distinct().withColumn("fetched", F.lit(True)) if allowed else front.select("url", F.lit(True).alias("fetched"))
        front = cut(front.join(may, "url", "left").select("url", F.lit(depth).alias("depth"), "visit", F.coalesce("fetched", F.lit(False)).alias("fetched")), f"{base}/visited/round={depth}")
        if not n:
            break
        heads = front.where("fetched").select(F.col("url").alias("src"), F.col("visit").alias("parent"))
        first = queued.join(heads, "src").groupBy("url").agg(F.min(F.struct("parent", "position")).alias("f")).select("url", "f.parent", "f.position")
        found = first.join(visited(), "url", "left_anti")
        depth += 1
    rows = visited().withColumn("inline", F.lit(False))
    if inline_pdfs:
        pages = visited().where("fetched").select(F.col("url").alias("src"), "depth", "visit")
        pdfs = known.where(is_pdf).join(pages, "src").groupBy("url").agg(F.min(F.struct("visit", "position", "depth")).alias("f")).select("url", "f.depth", "f.visit", F.lit(True).alias("fetched"), F.lit(True).alias("inline"))
        rows = rows.unionByName(pdfs.join(visited(), "url", "left_anti"))
    return rows
