"""Token counts of documents in flat token files that have no index.

A file is a run of little-endian u16 ids in which one reserved id ends each document; it is read as blocks of any
size. Each block is searched for the reserved id in one vectorised pass. A document that crosses blocks is stitched
by a prefix scan over the blocks of its file: a running sum of block sizes gives each separator its place in the file,
and the last separator before a block is where its first document begins. Only block summaries and separator
positions take part in the scan, never tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyarrow import NativeFile
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoding, read_ranks
from .runtime import arrow_batches, partitions, released, text_rows

BLOCK = "file_id long, block long, tokens binary, doc_ids array<long>"


def flat_blocks(docs: DataFrame, ranks_path: str, block_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as flat files, one for each input partition, in blocks of block_tokens ids (the last one shorter).

    Blocks end wherever they are full, also within documents. doc_ids is the manifest a writer would keep: the ids of
    the documents that end in the block, in order. A null or empty text has no token before its separator.
    """
    ranks, eod = read_ranks(ranks_path)
    arrow_batches(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, file_id = encoding(ranks), TaskContext.get().partitionId()
        rest, ended, block = np.zeros(0, "<u2"), [], 0  # ended: (end, doc_id) from the rest's start on

        def emit(part: np.ndarray, upto: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file_id]), pa.array([block]), pa.array([part.tobytes()], pa.binary()), pa.array([upto], pa.list_(pa.int64()))], ["file_id", "block", "tokens", "doc_ids"])

        for b in batches:
            parts, at = [rest], len(rest)
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*enc.encode_ordinary(text), eod], "<u2")
                parts.append(ids)
                at += len(ids)
                ended.append((at, doc))
            rest = np.concatenate(parts)
            while len(rest) >= block_tokens:
                k = sum(1 for e, _ in ended if e <= block_tokens) if len(ended) < 64 else int(np.searchsorted([e for e, _ in ended], block_tokens, "right"))
                yield emit(rest[:block_tokens], [d for _, d in ended[:k]])
                rest, ended, block = rest[block_tokens:], [(e - block_tokens, d) for e, d in ended[k:]], block + 1
        if len(rest):
            yield emit(rest, [d for _, d in ended])

    return text_rows(docs, id_col, text_col).mapInArrow(run, BLOCK)


def _open_file(path: str) -> NativeFile:
    """A file by its path as Spark names it, local or of a file system that pyarrow knows."""
    if path.startswith("file:"):
        return LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    fs, name = FileSystem.from_uri(path)
    return fs.open_input_file(name)


def file_blocks(spark: SparkSession, path: str, block_tokens: int = 1 << 20, open_file: Callable[[str], NativeFile] = _open_file) -> DataFrame:
    """The same blocks from existing .bin files of any size; file_id is a hash of the path.

    Each block is a byte range of its own, so the tasks share even one file and a task holds one block. Files without a
    whole token give none, and an odd last byte is no token. open_file: how executors open a path that Spark lists.
    """
    arrow_batches(spark)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, ranges in groupby(sorted(zip(*(c.to_pylist() for c in b.columns), strict=True)), key=itemgetter(0)):
                ranges = list(ranges)
                with open_file(ranges[0][0]) as f:
                    for _, fid, block, size in ranges:
                        f.seek(2 * block * block_tokens)
                        data = f.read(size)
                        if len(data) != size:
                            raise EOFError(f"{ranges[0][0]} got shorter while it was read")
                        yield pa.RecordBatch.from_arrays([pa.array([fid]), pa.array([block]), pa.array([data], pa.binary()), pa.array([[]], pa.list_(pa.int64()))], ["file_id", "block", "tokens", "doc_ids"])

    tokens, at = F.floor(F.col("length") / 2), F.col("block") * block_tokens
    files = spark.read.format("binaryFile").load(path).where("length >= 2").select("path", F.xxhash64("path").alias("file_id"), tokens.alias("tokens"))
    ranges = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block_tokens))))
    ranges = ranges.select("path", "file_id", "block", (F.least(F.lit(block_tokens), F.col("tokens") - at) * 2).alias("size"))
    return ranges.repartition(partitions(spark), "path", "block").mapInArrow(run, BLOCK)


def count_tokens(blocks: DataFrame, eod: int) -> DataFrame:
    """(file_id, position, start, n_tokens, doc_id): each separator ends one document; tokens without the separator.

    doc_id is from the manifest, null where there is none. Tokens after a file's last separator make a last row with
    ended false. Empty documents count 0. An empty table gives no rows.
    """
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.flatnonzero(np.frombuffer(x.as_buffer(), "<u2") == eod) for x in b.column(2)]
            sizes = [x.as_buffer().size // 2 for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64())), b.column(3)], ["file_id", "block", "n", "seps", "doc_ids"])

    scanned = blocks.mapInArrow(run, "file_id long, block long, n long, seps array<long>, doc_ids array<long>")
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file_id")
    placed = (
        scanned.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("last", F.when(F.size("seps") > 0, F.element_at("seps", -1) + F.col("base")))
        .withColumn("open", F.coalesce(F.max("last").over(before) + 1, F.lit(0)))
        .withColumn("seen", F.coalesce(F.sum(F.size("seps")).over(before), F.lit(0)))
        .withColumn("total", F.sum("n").over(every))
        .withColumn("final", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("block"))) == 1)
    )
    ends = F.transform("seps", lambda x: x + F.col("base"))
    starts = F.concat(F.array("open"), F.transform("seps", lambda x: x + F.col("base") + 1))
    tail = F.when(F.col("final"), F.col("total"))
    rows = placed.select("file_id", "seen", "doc_ids", starts.alias("starts"), F.concat(ends, F.array(tail)).alias("ends")).select("file_id", "seen", "doc_ids", "starts", "ends", F.size("ends").alias("many"), F.posexplode("ends").alias("i", "stop"))
    start = F.get("starts", F.col("i"))
    return (
        rows.select("file_id", (F.col("seen") + F.col("i")).alias("position"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("i") < F.col("many") - 1).alias("ended"), F.get("doc_ids", F.col("i")).alias("doc_id"))
        .where(F.col("ended") | (F.col("n_tokens") > 0))
    )
