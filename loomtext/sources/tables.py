"""Sources: the landed tables, and a site configuration read from YAML or a mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SITE = T.StructType(
    [
        T.StructField("code", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("base_url", T.StringType()),
        T.StructField("start_urls", T.ArrayType(T.StringType())),
        T.StructField("allowed_domains", T.ArrayType(T.StringType())),
        T.StructField("content_types", T.ArrayType(T.StringType())),
        T.StructField("js_rendering", T.BooleanType()),
        T.StructField("crawl_delay", T.DoubleType()),
        T.StructField("estimated_pages", T.IntegerType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, config: dict[str, dict] | str) -> DataFrame:
    """One row for each source; config is the mapping or the path of a YAML file that holds it (also under "sources")."""
    if isinstance(config, str):
        import yaml

        with open(config, encoding="utf-8") as f:
            config = yaml.safe_load(f)
    config = config.get("sources", config)
    keys = SITE.fieldNames()[1:]
    rows = []
    for code, own in sorted(config.items()):
        row = {"code": code} | {k: own.get(k) for k in keys}
        row["crawl_delay"] = None if row["crawl_delay"] is None else float(row["crawl_delay"])
        rows.append(tuple(row[k] for k in SITE.fieldNames()))
    return spark.createDataFrame(rows, SITE)


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of stored objects, raw pages or PDFs."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
