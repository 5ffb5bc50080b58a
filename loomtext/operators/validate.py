"""Chunk validation: errors remove a chunk, warnings are kept with it; what stays is numbered anew. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import native as N
from loomtext.sources import rules as R

ISSUE = "struct<chunk_index:int,field:string,severity:string,message:string>"


def _issue(when: Column, field: str, severity: str, message: Column | str) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.col("chunk_index").cast("int").alias("chunk_index"), F.lit(field).alias("field"), F.lit(severity).alias("severity"), said.alias("message")))


def _number(c: str) -> Column:
    return F.col(c).cast("string")


def checked(chunks: DataFrame, least: int = R.LEAST_TOKENS, most: int = R.MOST_TOKENS, kinds: tuple[str, ...] = ("table", "text")) -> DataFrame:
    """chunks with `errors`, `warnings` (arrays of issues) and `keep`.

    chunks: doc_key, chunk_index, chunk_text, chunk_type, token_count, word_count, source_url, source_name,
    metadata map<string,string>, heading_path array<map<string,string>> or of structs. A duplicate is a text that an
    earlier chunk of the same document has which passed everything else.
    """
    text = F.coalesce("chunk_text", F.lit(""))
    bare = N.strip(text)
    blank, nul = bare == "", F.contains(text, F.lit("\u0000"))
    boiler = F.lit(False)
    for p in R.BOILERPLATE:
        boiler = boiler | bare.rlike("(?iU)" + p)
    kind_said = "[" + ", ".join(f"'{k}'" for k in sorted(kinds)) + "]"
    early = F.array_compact(F.array(_issue(blank, "chunk_text", "error", "chunk_text is empty or whitespace-only"), _issue(nul & ~blank, "chunk_text", "error", "chunk_text contains null bytes (possible binary corruption)")))
    late = F.array_compact(
        F.array(
            _issue(~F.col("chunk_type").isin(*kinds) | F.col("chunk_type").isNull(), "chunk_type", "error", F.concat(F.lit("chunk_type '"), F.coalesce("chunk_type", F.lit("None")), F.lit(f"' is not one of {kind_said}"))),
            _issue(F.col("token_count") < least, "chunk_text", "error", F.concat(F.lit("token count "), _number("token_count"), F.lit(f" is below minimum {least}"))),
            _issue(F.col("token_count") > most, "chunk_text", "error", F.concat(F.lit("token count "), _number("token_count"), F.lit(f" exceeds maximum {most}"))),
            _issue(boiler, "chunk_text", "error", "chunk contains only navigation or boilerplate content"),
        )
    )
    first = chunks.withColumn("errors", F.when(F.size(early) > 0, early).otherwise(late)).withColumn("hash", F.sha2(text.cast("binary"), 256))
    before = Window.partitionBy("doc_key", "hash").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.bool_or(F.size("errors") == 0).over(before), F.lit(False))
    # a text that only fails as a duplicate, and one that fails otherwise too: both have the issue
    marked = first.withColumn("dup", seen & (F.size(F.filter("errors", lambda e: e["message"].isin("chunk_text is empty or whitespace-only", "chunk_text contains null bytes (possible binary corruption)"))) == 0))
    dup = _issue(F.col("dup"), "chunk_text", "error", F.concat(F.lit("duplicate chunk (sha256="), F.substring("hash", 1, 12), F.lit("…)")))
    done = marked.withColumn("errors", F.array_compact(F.concat("errors", F.array(dup)))).withColumn("keep", F.size("errors") == 0)
    return done.withColumn("warnings", F.when(F.col("keep"), _warnings()).otherwise(F.array().cast(f"array<{ISSUE}>"))).drop("hash", "dup")


def _warnings() -> Column:
    text, n = N.strip("chunk_text"), N.word_count("chunk_text")
    missing = [_issue(~F.map_contains_key(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.lit(k)), "metadata", "warning", f"required metadata key '{k}' is missing") for k in sorted(R.REQUIRED_METADATA)]
    is_text = F.col("chunk_type") == "text"
    return F.array_compact(
        F.array(
            _issue(~F.col("word_count").eqNullSafe(n), "word_count", "warning", F.concat(F.lit("stored word_count "), F.coalesce(_number("word_count"), F.lit("None")), F.lit(" does not match actual "), n.cast("string"))),
            _issue(F.coalesce("source_url", F.lit("")) == "", "source_url", "warning", "source_url is empty"),
            _issue(F.coalesce("source_name", F.lit("")) == "", "source_name", "warning", "source_name is empty"),
            *missing,
            _issue(F.try_element_at("metadata", F.lit("source_agency")).eqNullSafe(F.lit("")), "metadata.source_agency", "warning", "metadata source_agency is an empty string"),
            _issue(F.exists(F.coalesce("heading_path", F.array().cast("array<struct<level:int,text:string>>")), lambda h: h["level"].isNull() | h["text"].isNull()), "heading_path", "warning", "heading_path entry is missing 'level' or 'text' key"),
            _issue(is_text & text.rlike("^[a-z]"), "chunk_text", "warning", "chunk starts with a lowercase letter — possible mid-sentence split"),
            _issue(is_text & ~text.rlike(r"""[.!?…"')\]]+\s*$"""), "chunk_text", "warning", "chunk does not end with terminal punctuation — possible mid-sentence split"),
        )
    )


def _listed(numbers: Column | str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda i: i.cast("string")), ", "), F.lit("]"))


def kept(checked_chunks: DataFrame) -> DataFrame:
    """Chunks without errors, numbered from 0 in each document; the number in their metadata stays as it was."""
    w = Window.partitionBy("doc_key").orderBy("chunk_index")
    good = checked_chunks.where("keep").withColumn("new_index", F.row_number().over(w) - 1)
    return good.withColumn("chunk_index", F.col("new_index").cast("int")).drop("new_index", "keep", "errors")


def summary(checked_chunks: DataFrame) -> DataFrame:
    """Per document: chunks in, kept, filtered, errors, warnings, whether none has an error, and the renumbering warning."""
    kept_at = F.array_sort(F.collect_list(F.when(F.col("keep"), F.col("chunk_index"))))
    out = checked_chunks.groupBy("doc_key").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if("keep").alias("valid"), F.count_if(~F.col("keep")).alias("filtered"),
        F.sum(F.size("errors")).alias("errors"), F.sum(F.size("warnings")).alias("warnings"), kept_at.alias("kept_at"),
    )
    expected = F.when(F.size("kept_at") > 0, F.transform(F.sequence(F.lit(0), F.size("kept_at") - 1), lambda i: i.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    moved = F.transform("kept_at", lambda i: i.cast("long")) != expected
    return out.select("doc_key", "chunks", "valid", "filtered", "errors", (F.col("warnings") + F.when(moved, 1).otherwise(0)).alias("warnings"), (F.col("errors") == 0).alias("is_valid"), moved.alias("renumbered"), F.when(moved, F.concat(F.lit("chunk_index not sequential after filtering; re-indexing from "), _listed("kept_at"), F.lit(" to "), _listed(expected))).alias("renumbering"))
