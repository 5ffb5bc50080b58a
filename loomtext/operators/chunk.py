"""Chunking: text in token-bounded overlapping pieces with heading paths, then one chunk for each table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomtext.functions import native as N
from loomtext.functions import tokens as K
from loomtext.operators.extract import HEADINGS, map_rows
from loomtext.session import arrow_batches
from loomtext.sources import rules as R

PIECES = f"doc_key string, chunk_index int, chunk_text string, start int, heading_path {HEADINGS}, word_count int, token_count int"


def _pieces(text: str | None, headings: list[dict] | None, size: int, overlap: int, count: Callable[[str], int]) -> Iterator[dict]:
    if not (text or "").strip():
        return
    pieces = K.split(text, size, overlap, count)
    starts = K.offsets(text, pieces)
    paths = K.heading_paths(text, headings or [], starts)
    for i, (p, s, path) in enumerate(zip(pieces, starts, paths, strict=True)):
        yield {"chunk_index": i, "chunk_text": p, "start": s, "heading_path": path, "word_count": len(p.split()), "token_count": count(p)}


def text_chunks(docs: DataFrame, size: int = R.CHUNK_TOKENS, overlap: int = R.CHUNK_OVERLAP, tokens: str = "bpe", ranks: str = "") -> DataFrame:
    """docs(doc_key, text, headings) to pieces of its text; blank texts give none. One pass, no shuffle."""

    def work(row: dict) -> Iterator[dict]:
        for piece in _pieces(row["text"], row["headings"], size, overlap, K.counter(tokens, ranks)):
            yield {"doc_key": row["doc_key"]} | piece

    return map_rows(docs.select("doc_key", "text", "headings"), work, PIECES)


def chunks(docs: DataFrame, size: int = R.CHUNK_TOKENS, overlap: int = R.CHUNK_OVERLAP, tokens: str = "bpe", ranks: str = "") -> DataFrame:
    """docs(doc_key, text, headings, tables, metadata, url, source, content_type) to chunks, texts before tables.

    Each document is read once: its chunks are made, numbered and given its metadata in the row that holds it. No shuffle.
    """
    marked = F.transform("tables", lambda t: F.struct(N.markdown(t["headers"], t["rows"], t["caption"]).alias("text"), t["caption"].alias("caption"), t["source_tag"].alias("tag")))
    rows = docs.select("doc_key", "text", "headings", F.filter(marked, lambda t: t["text"] != "").alias("tables"), "metadata", F.col("url").alias("source_url"), F.col("source").alias("source_name"), "content_type")
    own = ("metadata", "source_url", "source_name", "content_type")

    def work(row: dict) -> Iterator[dict]:
        count = K.counter(tokens, ranks)
        same = {"doc_key": row["doc_key"]}
        at = -1
        for p in _pieces(row["text"], row["headings"], size, overlap, count):
            at = p.pop("chunk_index")
            del p["start"]
            yield same | p | {"chunk_index": at, "chunk_type": "text", "table_caption": None, "table_source_tag": None}
        for i, t in enumerate(row["tables"] or [], at + 1):
            yield same | {"chunk_index": i, "chunk_text": t["text"], "chunk_type": "table", "heading_path": [], "word_count": len(t["text"].split()), "token_count": count(t["text"]), "table_caption": t["caption"], "table_source_tag": t["tag"]}

    made = f"doc_key string, chunk_index int, chunk_text string, chunk_type string, heading_path {HEADINGS}, word_count int, token_count int, table_caption string, table_source_tag string"
    kind = to_arrow_schema(T._parse_datatype_string(made))
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's own columns are repeated within Arrow: they aren't taken apart for each chunk."""
        for b in batches:
            out, of = [], []
            for i, row in enumerate(b.drop_columns(list(own)).to_pylist()):
                for piece in work(row):
                    out.append(piece)
                    of.append(i)
            at = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([*pa.RecordBatch.from_pylist(out, schema=kind).columns, *(b.column(c).take(at) for c in own)], [*kind.names, *own])

    return rows.mapInArrow(run, made + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in own))


def word_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """docs(doc_key, text) to windows of `size` words, each beginning size - overlap after the last; native."""
    step = size - overlap
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\x0b\f]+"), lambda w: w != "")
    rows = docs.select("doc_key", words.alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - size) / step).cast("int"))
    at = rows.select("doc_key", "words", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    piece = F.slice("words", F.col("chunk_index") * step + 1, size)
    return at.select("doc_key", "chunk_index", F.array_join(piece, " ").alias("chunk_text"), F.size(piece).alias("word_count"))
