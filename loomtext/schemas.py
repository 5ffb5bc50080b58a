"""Tables as explicit schemas, and the checks that stand in for keys and enumerations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "sources": "id string, name string, code string, base_url string, crawl_config string, is_active boolean, created_at timestamp, updated_at timestamp",
    "raw_documents": "id string, source_id string, url string, content_hash string, content_type string, title string, raw_html string, raw_text string, s3_html_key string, s3_pdf_key string, last_modified timestamp, crawled_at timestamp, status string, error_message string, metadata_json string",
    "processed_chunks": "id string, document_id string, chunk_text string, chunk_index int, total_chunks int, token_count int, heading_path array<struct<level:int,text:string>>, embedding_id string, embedding array<float>, metadata_json string, created_at timestamp",
    "crawl_jobs": "id string, source_id string, job_type string, status string, pages_found int, pages_new int, pages_changed int, pages_deleted int, pages_errored int, started_at timestamp, completed_at timestamp, error_message string, metadata_json string",
}
KEYS = {"sources": [("name",), ("code",)], "raw_documents": [("id",), ("source_id", "url")], "processed_chunks": [("id",)], "crawl_jobs": [("id",)]}
VALUES = {
    ("raw_documents", "status"): ("pending", "processed", "failed", "deleted"),
    ("crawl_jobs", "job_type"): ("full", "incremental"),
    ("crawl_jobs", "status"): ("running", "completed", "failed"),
}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(_DDL[name])


def create(spark: SparkSession, base: str) -> list[str]:
    """Make the tables below base that aren't there yet; their names."""
    jvm, made = spark.sparkContext._jvm, []
    for name in _DDL:
        p = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            spark.createDataFrame([], schema(name)).write.parquet(f"{base}/{name}")
            made.append(name)
    return made


def migrate(df: DataFrame, name: str) -> DataFrame:
    """An older table's rows in the present schema: new columns are null, types are cast, and columns that are gone go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])


def violations(df: DataFrame, name: str) -> DataFrame:
    """(rule, n): repeated keys and values outside an enumeration; no row if all is well."""
    out = None
    for key in KEYS[name]:
        bad = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unique " + ", ".join(key)).alias("rule"), "n")
        out = bad if out is None else out.unionByName(bad)
    for (table, column), allowed in VALUES.items():
        if table == name:
            bad = df.where(~F.col(column).isin(*allowed)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"value of {column}").alias("rule"), "n")
            out = out.unionByName(bad)
    return out.where("n > 0")


def _columns_up_to(version: int, name: str) -> list[str]:
    later = {c for v in VERSIONS[version:] for c in v.columns.get(name, ())}
    return [f for f in schema(name).fieldNames() if f not in later]


@dataclass(frozen=True)
class Version:
    """A step of the tables' history: columns that come with it, and keys that hold from it on, by table."""

    title: str
    columns: dict[str, tuple[str, ...]]
    keys: dict[str, tuple[str, ...]]


#: In order; version n is the state after the first n of them.
VERSIONS = (
    Version("the four tables", {}, {}),
    Version("one row for each page of a source, vectors in the table", {"processed_chunks": ("embedding",)}, {"raw_documents": ("source_id", "url")}),
)


def move(df: DataFrame, name: str, at: int, to: int) -> DataFrame:
    """A table's rows of version `at` in version `to`, step by step, up or down.

    Up: new columns are null, and before a key begins to hold, of rows that share it the last by crawled_at stays (then
    the largest hash and id). Rows with a null in the key are no duplicates of one another. Down: columns go, keys no
    longer hold. Columns are cast to the present types; others are dropped.
    """
    if not (0 < at <= len(VERSIONS) and 0 < to <= len(VERSIONS)):
        raise ValueError(f"versions are 1 to {len(VERSIONS)}")
    rows = migrate(df, name).select(*_columns_up_to(at, name))
    while at < to:
        at += 1
        for c in VERSIONS[at - 1].columns.get(name, ()):
            rows = rows.withColumn(c, F.lit(None).cast(schema(name)[c].dataType))
        if key := VERSIONS[at - 1].keys.get(name):
            whole = rows.where(" and ".join(f"{k} is not null" for k in key))
            last = F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct("crawled_at", "content_hash", "id"))
            one = whole.groupBy(*key).agg(last.alias("r")).select(*key, "r.*").select(*rows.columns)
            rows = one.unionByName(rows.where(" or ".join(f"{k} is null" for k in key)))
    return rows.select(*_columns_up_to(to, name))


def upgrade(spark: SparkSession, base: str, to: int = len(VERSIONS)) -> int:
    """Bring the tables below base to version `to`, up or down; the version they had. A version is a folder, and base/_version
    names the one that holds: it is written last, so a run that fails leaves the old tables as they are."""
    jvm = spark.sparkContext._jvm
    there = lambda p: (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(q)
    at = int(spark.read.text(f"{base}/_version").first()[0]) if there(f"{base}/_version") else 0
    if at == to:
        return at
    for name in _DDL:
        path = f"{base}/v{at}/{name}"
        old = spark.read.parquet(path) if at and there(path) else spark.createDataFrame([], schema(name))
        move(old, name, max(at, 1), to).write.mode("overwrite").parquet(f"{base}/v{to}/{name}")
    spark.createDataFrame([(str(to),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/_version")
    return at
