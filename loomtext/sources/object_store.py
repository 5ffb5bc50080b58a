"""Keyed objects as a source and a sink of their own: many in a file, read in bounded parts, written all or not at all.

    objects.write.format("loomtext_objects").option("path", root).mode("append").save()
    spark.read.format("loomtext_objects").option("path", root).option("prefix", "raw-html/site").load()

Rows are (key string, content binary). A key is a path below the root: parts of letters, digits and ._-=, none of them . or ..
Rows that have a column version (string) as well are versions of their key: each is an object of its own, and only the same
version of the same key replaces it. Without that column, or where it is null, it's the version "". Readers get all versions;
.schema(VERSIONED) tells them apart.
A task writes its objects, each packed, one after the other into files of its own, with a list of each file's objects; they stay
there. The commit names the lists in a manifest, which is what readers go by. A failed job leaves no manifest, so none of its objects is seen; its folder is removed,
but for what tasks still write while they are being stopped.
Of one key and version the object of the last manifest counts; within one write the one of the last row's task and place does.
The driver holds lists' names, never objects' keys: a reading task takes a range of the keys' hashes out of all lists.
The root must be a folder that the driver and all executors share. Writes and reads use Hadoop's file systems through
pyarrow where one is named (hdfs://, s3://), else files.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "loomtext_objects"
SCHEMA, VERSIONED = "key string, content binary", "key string, version string, content binary"
#: Bytes of objects in one partition on average, and rows of one batch; objects in one partition on average.
PART_BYTES, BATCH_BYTES, PART_OBJECTS = 64 << 20, 8 << 20, 100_000
#: Objects of one list, and of its parts that are read or passed over by their hashes.
LIST_OBJECTS, GROUP_OBJECTS = 50_000, 2_000
_HASHES = 1 << 32
_KEY = re.compile(r"^(?!.*(^|/)\.{1,2}(/|$))[\w.=-]+(/[\w.=-]+)*$", re.A)
#: Bytes that are gathered before they are written.
WRITE_BYTES = 1 << 20
_MANIFESTS, _OBJECTS, _LIST, _PACKED, _CODEC = "_manifests", "_objects", "list", "packed", "zstd"
_LISTED = pa.schema({"hash": pa.int64(), "key": pa.string(), "version": pa.string(), "at": pa.int64(), "packed": pa.int64(), "size": pa.int64()})


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system and the folder of a root."""
    if re.match("^[a-z][a-z0-9+.-]*:/", root):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def _manifests(root: str) -> list[str]:
    store, base = _store(root)
    found = store.get_file_info(fs.FileSelector(f"{base}/{_MANIFESTS}", allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File)


def lists(root: str) -> list[tuple[str, int, int]]:
    """(folder below the root, objects, bytes) of all committed lists, in the order of their writes."""
    store, _ = _store(root)
    out: list[tuple[str, int, int]] = []
    for path in _manifests(root):
        with store.open_input_stream(path) as f:
            out += map(tuple, json.loads(f.read()))
    return out


def _hash(key: str, version: str) -> int:
    return zlib.crc32(f"{key}\0{version}".encode())


@dataclass
class Part(InputPartition):
    """The objects whose hash is at least first, and below end."""

    first: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    lists: list[tuple[str, int, int]]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: tuple[str, ...] = ("key", "content")):
        self.root, self.prefix, self.names = options["path"], options.get("prefix", ""), names
        self.lists = lists(self.root)  # what is read is what was committed when the read was planned

    def partitions(self) -> list[Part]:
        n = max(1, -(-sum(size for _, _, size in self.lists) // PART_BYTES), -(-sum(many for _, many, _ in self.lists) // PART_OBJECTS))
        ends = [_HASHES * i // n for i in range(n + 1)]
        return [Part(a, b) for a, b in zip(ends, ends[1:])]

    def _found(self, part: Part) -> dict[tuple[str, str], tuple[int, int, int, int]]:
        """(key, version) to (place among the lists, place in its file, bytes there, size), of the part's objects whose key begins with the prefix."""
        store, base = _store(self.root)
        out: dict[tuple[str, str], tuple[int, int, int, int]] = {}
        for i, (folder, _, _) in enumerate(self.lists):
            with store.open_input_file(f"{base}/{folder}/{_LIST}") as f, pq.ParquetFile(f) as held:
                spans = [held.metadata.row_group(g).column(0).statistics for g in range(held.num_row_groups)]
                got = held.read_row_groups([g for g, s in enumerate(spans) if s.max >= part.first and s.min < part.end])
            for h, key, version, *place in zip(*(c.to_pylist() for c in got.columns), strict=True):
                if part.first <= h < part.end and key.startswith(self.prefix):
                    out[key, version] = (i, *place)
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, base = _store(self.root)
        found = sorted((place, *k) for k, place in self._found(part).items())
        held, total = [], 0
        for i, group in groupby(found, lambda x: x[0][0]):
            with store.open_input_file(f"{base}/{self.lists[i][0]}/{_PACKED}") as f:
                for (_, at, packed, size), key, version in group:
                    f.seek(at)
                    held.append((key, version, pa.decompress(f.read(packed), size, _CODEC, asbytes=True) if size else b""))
                    total += size
                    if total >= BATCH_BYTES:
                        yield self._batch(held)
                        held, total = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, held: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
        keys, versions, contents = zip(*held, strict=True)
        columns = {"key": pa.array(keys), "version": pa.array(versions), "content": pa.array(contents, pa.binary())}
        return pa.RecordBatch.from_arrays([columns[c] for c in self.names], list(self.names))


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        """A task's objects, in files below folders that no other attempt uses, with their lists."""
        store, base = _store(self.root)
        own, out = f"{_OBJECTS}/{self.job}/{uuid.uuid4().hex}", []
        for row in rows:  # the first of each file
            folder = f"{own}-{len(out)}"
            store.create_dir(f"{base}/{folder}", recursive=True)
            held, at, total = [], 0, 0
            with store.open_output_stream(f"{base}/{folder}/{_PACKED}", buffer_size=WRITE_BYTES) as f:
                for r in chain([row], islice(rows, LIST_OBJECTS - 1)):
                    key, data = r["key"], bytes(r["content"] or b"")
                    version = (r["version"] or "") if "version" in r else ""
                    if key is None or not _KEY.match(key):
                        raise ValueError(f"not a key: {key!r}")
                    packed = pa.compress(data, _CODEC, asbytes=True) if data else b""
                    f.write(packed)
                    held.append((_hash(key, version), key, version, at, len(packed), len(data)))
                    at, total = at + len(packed), total + len(data)
            held.sort(key=lambda x: x[0])  # of one key and version, the order stays
            listing = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _LISTED.types, strict=True)], schema=_LISTED)
            with store.open_output_stream(f"{base}/{folder}/{_LIST}") as f:
                pq.write_table(listing, f, row_group_size=GROUP_OBJECTS, compression=_CODEC)
            out.append((folder, len(held), total))
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        """The objects become visible with the write's manifest."""
        store, base = _store(self.root)
        old, number = _manifests(self.root), 0
        if old:
            number = 1 + int(old[-1].rpartition("/")[2].split("-")[0])
        kept = [x for m in messages if m for x in m.lists]
        store.create_dir(f"{base}/{_MANIFESTS}", recursive=True)
        store.create_dir(f"{base}/{_OBJECTS}", recursive=True)
        name, made = f"{base}/{_MANIFESTS}/{number:012d}-{self.job}", f"{base}/{_OBJECTS}/manifest-{self.job}"
        with store.open_output_stream(made) as f:
            f.write(json.dumps(kept).encode())
        store.move(made, name)  # one step: the write is there, or it isn't
        if self.overwrite:
            for path in old:
                store.delete_file(path)
        self._clear({folder.rpartition("/")[2] for folder, _, _ in kept})

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(set())

    def _clear(self, kept: set[str]) -> None:
        """Remove the folders of attempts that don't count."""
        store, base = _store(self.root)
        top = f"{base}/{_OBJECTS}/{self.job}"
        for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            if f.base_name not in kept:
                store.delete_dir(f.path)
        if not kept and store.get_file_info(top).type == fs.FileType.Directory:
            store.delete_dir(top)


class Objects(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, tuple(schema.fieldNames()))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> str:
    """Make the format known to the session; its name."""
    spark.dataSource.register(Objects)
    return NAME
