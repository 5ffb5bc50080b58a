"""Page extraction: each page is parsed once, in an Arrow batch, and gives one struct; everything after it is native."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomtext.functions import html as H
from loomtext.functions import native as N
from loomtext.session import arrow_batches
from loomtext.sources import rules as R

HEADINGS = "array<struct<level:int,text:string>>"
TABLES = "array<struct<headers:array<string>,rows:array<array<string>>,caption:string,page_number:int,source_tag:string>>"
EXTRACTED = f"title string, text string, headings {HEADINGS}, tables {TABLES}, word_count int, warnings array<string>, error string"
CRAWLED = "title string, text string, links array<string>, rate_tables array<struct<headers:array<string>,rows:array<array<string>>>>"


def map_rows(df: DataFrame, work: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """Rows to rows in Python, in Arrow batches of bounded size."""
    arrow_batches(df.sparkSession)
    kind = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for row in b.to_pylist() for r in work(row)]
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return df.mapInArrow(run, schema)


def _types(df: DataFrame, names: tuple[str, ...]) -> str:
    return "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in names)


def extract_pages(pages: DataFrame, selectors: dict[str, tuple[str, ...]] = R.CONTENT_SELECTORS, keep: tuple[str, ...] = ()) -> DataFrame:
    """pages(page_id, url, html, source) to page_id, url, source, the columns to keep and what was extracted; an empty page has an error."""

    def work(row: dict) -> Iterator[dict]:
        yield {"page_id": row["page_id"], "url": row["url"], "source": row["source"]} | {c: row[c] for c in keep} | H.extract(row["html"], row["source"] or "", selectors)

    return map_rows(pages.select("page_id", "url", "source", "html", *keep), work, f"page_id long, url string, source string{_types(pages, keep)}, {EXTRACTED}")


def crawl_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """pages(page_id, url, html) as the crawl stage reads them: title, main text, links as written, rate tables; and the columns to keep."""

    def work(row: dict) -> Iterator[dict]:
        yield {"page_id": row["page_id"], "url": row["url"]} | {c: row[c] for c in keep} | H.crawl_view(row["html"])

    return map_rows(pages.select("page_id", "url", "html", *keep), work, f"page_id long, url string{_types(pages, keep)}, {CRAWLED}")


def drop_thin(crawled: DataFrame, least: int = 100) -> DataFrame:
    """Pages whose main text has at least that many characters."""
    return crawled.where(F.char_length("text") >= least)


def page_links(crawled: DataFrame, allowed: DataFrame | None = None, visited: DataFrame | None = None) -> DataFrame:
    """(page_id, position, url) of each link, normalised, duplicates and order kept.

    allowed(domain): only links to these authorities; visited(url): none of these.
    """
    rows = crawled.select("page_id", F.col("url").alias("base"), F.posexplode("links").alias("position", "href"))
    rows = rows.select("page_id", "position", N.normalize_url(N.absolute_url("href", "base")).alias("url"))
    if allowed is not None:
        rows = rows.join(allowed.select("domain").distinct(), N.authority("url") == F.col("domain"), "left_semi")
    if visited is not None:
        rows = rows.join(visited.select("url").distinct(), "url", "left_anti")
    return rows.select("page_id", "position", "url")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls without those whose path begins with a disallowed prefix of their authority; no rule means allowed."""
    r = rules.where("prefix <> ''").select(F.col("authority").alias("__a"), F.col("prefix").alias("__p"))
    return urls.join(F.broadcast(r) if r.count() <= 100_000 else r, (N.authority("url") == F.col("__a")) & F.startswith(N.url_path("url"), F.col("__p")), "left_anti")


def landed(fetches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of fetches(url, status, html, ...): the pages, and errors(url, error) of those that failed.

    Status 403 and 404 are neither; no status, and any other of 400 or more, is an error after the last attempt.
    """
    bad = F.col("status").isNull() | (F.col("status") >= 400)
    failed = fetches.where(bad & ~F.coalesce(F.col("status").isin(403, 404), F.lit(False)))
    return fetches.where(~bad), failed.select("url", F.lit("max_retries_exceeded").alias("error"))


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """robots(authority, text) to (authority, rules array<struct<allow, prefix>>): those for this agent, in their order.

    A missing text has no rules. The files are small and there is one for each authority.
    """

    def work(row: dict) -> Iterator[dict]:
        p = RobotFileParser()
        p.parse((row["text"] or "").splitlines())
        entry = next((e for e in p.entries if e.applies_to(agent)), p.default_entry)
        rules = [{"allow": r.allowance, "prefix": r.path} for r in entry.rulelines] if entry else []
        yield {"authority": row["authority"], "rules": rules}

    return map_rows(robots.select("authority", "text"), work, "authority string, rules array<struct<allow:boolean,prefix:string>>")


def robots_allowed_by_text(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """urls that the robots file of their authority lets this agent fetch: the first rule decides whose prefix the path and query begin with; by default all."""
    rules = robots_rules(robots, agent)
    target = F.concat(F.when(N.url_path("url") == "", F.lit("/")).otherwise(N.url_path("url")), F.regexp_extract("url", r"(\?[^#]*)?(#.*)?$", 1))
    hit = F.filter("__rules", lambda r: (r["prefix"] == "*") | F.startswith(target, r["prefix"]))
    joined = urls.join(rules.select(F.col("authority").alias("__a"), F.col("rules").alias("__rules")), N.authority("url") == F.col("__a"), "left")
    return joined.where(F.coalesce(F.get(hit, F.lit(0))["allow"], F.lit(True))).select(*urls.columns)


def write_archive(objects: DataFrame, path: str) -> DataFrame:
    """Write objects(kind, source, day, key, content binary) below path and read them back; the same keys' older objects go.

    A table with one partition for each kind, source and day, in place of millions of small files: a key is read by its
    partition. A repeated run of a day replaces that day's partitions only.
    """
    rows = objects.select("kind", "source", F.date_format("day", "yyyy-MM-dd").alias("day"), "key", "content")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "source", "day").parquet(path)
    return objects.sparkSession.read.schema("key string, content binary, kind string, source string, day string").parquet(path)


def archive_key(kind: str, source: str, day: str, url: str) -> Column:
    """Where an object of this kind is archived: kind/source/yyyy-mm-dd/hash.suffix."""
    suffix = {"raw-html": ".html", "raw-pdf": ".pdf", "processed": ".txt"}[kind]
    return F.concat_ws("/", F.lit(kind), F.col(source), F.date_format(day, "yyyy-MM-dd"), F.concat(N.url_hash(url), F.lit(suffix)))


def choose_pdf_text(reads: DataFrame) -> DataFrame:
    """The decision between a primary and a fallback reading of PDFs.

    reads: url, primary_text, primary_title, primary_pages, primary_error, fallback_text, fallback_title,
    fallback_pages, fallback_error. Out: url, text, title, page_count, word_count, used_fallback, needs_ocr, warnings.
    """
    text = F.coalesce("primary_text", F.lit(""))
    failed = F.col("primary_error").isNotNull()
    used = failed | (N.strip(text) == "")
    better = used & F.col("fallback_error").isNull()
    has = lambda c: better & (N.strip(F.coalesce(c, F.lit(""))) != "")
    body = N.tidy(F.when(has("fallback_text"), F.col("fallback_text")).when(failed, F.lit("")).otherwise(text))
    title = F.when(has("fallback_title") & (F.col("fallback_title") != "Untitled"), F.col("fallback_title")).when(failed, F.lit("Untitled")).otherwise(F.coalesce("primary_title", F.lit("Untitled")))
    pages = F.when(better & (F.coalesce("fallback_pages", F.lit(0)) > 0), F.col("fallback_pages")).when(failed, F.lit(0)).otherwise(F.coalesce("primary_pages", F.lit(0)))
    n = N.word_count(body)
    warn = F.array_compact(
        F.array(
            F.when(failed, F.concat(F.lit("primary reader failed ("), F.col("primary_error"), F.lit("), using fallback"))),
            F.when(used & ~failed, F.lit("primary reader returned no text, using fallback")),
            F.when(used & F.col("fallback_error").isNotNull(), F.concat(F.lit("fallback reader also failed ("), F.col("fallback_error"), F.lit(")"))),
            F.when(n < R.SCANNED_WORDS, F.concat(F.lit("Scanned PDF detected (only "), n.cast("string"), F.lit(" words extracted) — flagged for OCR queue"))),
        )
    )
    return reads.select("url", body.alias("text"), title.alias("title"), pages.alias("page_count"), n.alias("word_count"), used.alias("used_fallback"), (n < R.SCANNED_WORDS).alias("needs_ocr"), warn.alias("warnings"))
