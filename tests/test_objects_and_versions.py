"""Keyed objects: all of a write or none of it; tables moved between versions; object and site sources."""

import pickle

import pytest
from pyspark.sql import Row

from loomtext import schemas
from loomtext.sources import object_store, tables


def put(spark, root, rows, mode="append"):
    df = spark.createDataFrame(rows, object_store.SCHEMA).repartition(3)
    df.write.format(object_store.register(spark)).option("path", root).mode(mode).save()


def read(spark, root, prefix=""):
    got = spark.read.format(object_store.register(spark)).option("path", root).option("prefix", prefix).load()
    return sorted((r["key"], bytes(r["content"])) for r in got.collect())


def test_writes_are_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    assert read(spark, root) == []
    put(spark, root, [("a/b.html", b"one"), ("a/c.html", None), ("d", b"\0\xff")])
    assert read(spark, root) == [("a/b.html", b"one"), ("a/c.html", b""), ("d", b"\0\xff")]
    for bad in ("../x", "a//b", "", None, "/a", "a/./b"):
        with pytest.raises(Exception, match="not a key"):
            put(spark, root, [("new", b"x"), ("a/b.html", b"changed"), (bad, b"y")])
    assert read(spark, root) == [("a/b.html", b"one"), ("a/c.html", b""), ("d", b"\0\xff")]
    put(spark, root, [("a/b.html", b"two"), ("e=1/f", b"x")])
    assert read(spark, root, "a/") == [("a/b.html", b"two"), ("a/c.html", b"")] and len(read(spark, root)) == 4
    monkeypatch.setattr(object_store, "PART_BYTES", 2)
    assert len(object_store.Reader({"path": root}).partitions()) > 2 and len(read(spark, root)) == 4
    put(spark, root, [("z", b"only")], "overwrite")
    assert read(spark, root) == [("z", b"only")]
    put(spark, root, [], "append")
    assert read(spark, root) == [("z", b"only")]


def test_versions_of_a_key(spark, tmp_path):
    root = str(tmp_path / "store")

    def write(rows):
        df = spark.createDataFrame(rows, object_store.VERSIONED).repartition(3)
        df.write.format(object_store.register(spark)).option("path", root).mode("append").save()

    write([("a", "1", b"one"), ("a", "2", b"two"), ("b", None, b"x")])
    write([("a", "2", b"again")])
    assert read(spark, root) == [("a", b"again"), ("a", b"one"), ("b", b"x")]
    got = spark.read.format(object_store.register(spark)).schema(object_store.VERSIONED).option("path", root).load()
    assert sorted((r["key"], r["version"], bytes(r["content"])) for r in got.collect()) == [("a", "1", b"one"), ("a", "2", b"again"), ("b", "", b"x")]
    put(spark, root, [("b", b"y")])
    assert read(spark, root, "b") == [("b", b"y")]


def test_pages_of_one_url(spark, tmp_path, same):
    """Pages may share a url and so a key: each is kept, as in the SQL, whichever of them is written again."""
    import duckdb

    from loomtext import oracle, queries

    page = "concat('<html><head><title>t</title></head><body><article><p>', id, '</p></article></body></html>')"
    spark.range(12).selectExpr("id AS page_id", "concat('http://h.example/', id div 4) AS url", f"{page} AS html").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same(queries.queries()["object_store_pages"](spark, str(tmp_path)), con.sql(oracle.oracle_sql()["object_store_pages"]))


def test_the_driver_holds_no_keys(tmp_path, monkeypatch):
    def write(root, rows, mark):
        w = object_store.Writer({"path": root}, False)
        message = w.write(Row(key=f"k/{i}", content=b"%s%d" % (mark, i)) for i in rows)
        w.commit([message, None])
        return message

    held = []
    for n in (10, 5000):
        root = str(tmp_path / str(n))
        message = write(root, range(n), b"a")
        held.append(len(pickle.dumps((message, object_store.Reader({"path": root}).partitions()))))
    assert held[1] < held[0] + 100
    for name, many in (("LIST_OBJECTS", 700), ("GROUP_OBJECTS", 50), ("PART_OBJECTS", 900)):
        monkeypatch.setattr(object_store, name, many)
    write(root, [*range(1000, 3000), *range(2990, 3000)], b"b")
    reader = object_store.Reader({"path": root})
    parts = reader.partitions()
    assert len(reader.lists) == 4 and len(parts) == 8
    got = [(r["key"], r["content"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(got) == sorted((f"k/{i}", b"%s%d" % (b"b" if 1000 <= i < 3000 else b"a", i)) for i in range(5000))


def test_landed_files_and_sites(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-")
    (tmp_path / "y.html").write_bytes(b"<p>")
    assert sorted((r.path.rpartition("/")[2], bytes(r.content)) for r in tables.objects(spark, str(tmp_path)).collect()) == [("x.pdf", b"%PDF-"), ("y.html", b"<p>")]
    got = tables.sites(spark, {"sources": {"b": {"name": "B", "crawl_delay": 2, "allowed_domains": ["x.example"], "unknown": 1}, "a": {}}}).collect()
    assert [(r.code, r.name, r.crawl_delay, r.allowed_domains) for r in got] == [("a", None, None, None), ("b", "B", 2.0, ["x.example"])]


def test_versions_up_and_down(spark):
    at = "cast({} as timestamp)"
    rows = [("1", "s", "u", "h1", 1), ("2", "s", "u", "h2", 2), ("3", "s", "u", "h3", 2), ("4", "s", "v", "h", 1), ("5", "s", None, "h", 1), ("6", "s", None, "h", 1), ("7", "t", "u", "h", 1)]
    old = spark.createDataFrame(rows, "id string, source_id string, url string, content_hash string, at long").selectExpr("*", at.format("at") + " AS crawled_at", "'x' AS extra")
    up = schemas.move(old, "raw_documents", 1, 2)
    assert sorted(r.id for r in up.collect()) == ["3", "4", "5", "6", "7"] and up.columns == schemas.schema("raw_documents").fieldNames()
    assert schemas.move(up, "raw_documents", 2, 1).count() == 5 and schemas.move(old, "raw_documents", 1, 1).count() == 7
    chunks = spark.createDataFrame([("1", 3)], "id string, chunk_index int")
    up = schemas.move(chunks, "processed_chunks", 1, 2)
    assert "embedding" in up.columns and up.first().embedding is None
    assert "embedding" not in schemas.move(up, "processed_chunks", 2, 1).columns
    with pytest.raises(ValueError):
        schemas.move(chunks, "processed_chunks", 1, 3)


def test_a_store_of_versions(spark, tmp_path):
    base = str(tmp_path)
    assert schemas.upgrade(spark, base, 1) == 0 and "embedding" not in spark.read.parquet(f"{base}/v1/processed_chunks").columns
    assert schemas.upgrade(spark, base) == 1 and "embedding" in spark.read.parquet(f"{base}/v2/processed_chunks").columns
    assert schemas.upgrade(spark, base) == 2 and schemas.upgrade(spark, base, 1) == 2


def test_feedback_words(spark, tmp_path):
    from loomtext.operators import text_index

    docs = spark.createDataFrame([(1, "cat purr purr milk"), (2, "cat purr milk the"), (3, "dog bark the"), (4, "the the"), (5, None)], "doc_id int, text string")
    text_index.build(docs, str(tmp_path))
    asked = spark.createDataFrame([(1, "Cat"), (2, "nothing"), (3, None)], "query_id int, text string")
    got = {r.query_id: r.text for r in text_index.expand(spark, str(tmp_path), asked, 2, 2).collect()}
    assert got == {1: "Cat milk purr", 2: "nothing", 3: ""}
