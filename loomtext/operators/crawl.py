"""What the crawl stage makes of a page: results with their source's metadata, and the PDFs that pages link to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import native as N
from loomtext.operators import extract
from loomtext.sources import rules as R


def source_metadata(source: str) -> Column:
    """The metadata of a page of this source, as JSON; columns url, title, text and rate_tables must be there."""
    low, path = F.lower(F.col("text")), N.url_path("url")
    base = {"source": F.lit(source), "path": path}
    own = {
        "hdb": lambda: {"section": N.path_section("url", "second"), "property_type": F.lit("hdb")},
        "ura": lambda: {"section": N.path_section("url", "second"), "property_type": F.lit("private")},
        "iras": lambda: {"section": N.path_section("url", "tax"), "property_type": F.lit("all"), "tax_types": N.tax_types("text"), "tables": F.col("rate_tables"), "has_rate_tables": F.size("rate_tables") > 0},
        "mas": lambda: {"section": F.lit("regulation"), "property_type": F.lit("all"), "topics": F.array_compact(F.transform(F.array(*map(F.lit, R.RELEVANCE_KEYWORDS)), lambda k: F.when(F.contains(low, k) | F.contains(F.lower(F.coalesce("title", F.lit(""))), k), k)))},
        "cpf": lambda: {"section": N.path_section("url", "last"), "property_types": N.home_property_types("text"), "citizenship_types": N.home_citizenship_types("text"), "topics": N.keywords(low, R.HOME_KEYWORDS)},
    }
    fields = base | (own[source]() if source in own else {"section": N.path_section("url", "second")})
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def crawl_results(pages: DataFrame, source: str) -> DataFrame:
    """pages(page_id, url, html) to (page_id, url, title, content_hash, url_hash, metadata): thin pages, and for one source irrelevant ones, are left out."""
    hashed = pages.withColumn("content_hash", N.content_hash("html")).withColumn("url_hash", N.url_hash("url"))
    seen = extract.drop_thin(extract.crawl_pages(hashed, ("content_hash", "url_hash")))
    if source == "mas":
        seen = seen.where(N.is_relevant("text", "title"))
    return seen.select("page_id", "url", "content_hash", "url_hash", "title", source_metadata(source).alias("metadata"))


def linked_pdfs(links: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(page_id, url, title) of the PDFs that links(page_id, url) lead to, once each, whatever their domain; seen(url) are left out."""
    pdfs = links.where(F.lower(N.url_path("url")).endswith(".pdf")).groupBy("url").agg(F.min("page_id").alias("page_id"))
    if seen is not None:
        pdfs = pdfs.join(seen.select("url").distinct(), "url", "left_anti")
    return pdfs.select("page_id", "url", N.pdf_title("url").alias("title"))
