"""Upserts, settings, embedding calls and PDFs on small cases."""

import zlib

import pytest

from loomtext.operators import vectors
from loomtext.sources import pdf, settings


def test_repeated_new_vectors_make_one_row(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "namespace string, vector_id string, embedding array<float>")
    got = vectors.upsert_vectors(rows(("a", "1", [1.0]), ("a", "2", [1.0])), rows(("a", "1", [2.0]), ("a", "1", [3.0])))
    assert sorted((r.vector_id, r.embedding) for r in got.collect()) == [("1", [3.0]), ("2", [1.0])]


def test_ensure_index_once(spark, tmp_path):
    assert vectors.ensure_index(spark, f"{tmp_path}/index", 8) and not vectors.ensure_index(spark, f"{tmp_path}/index", 8)


def test_calls_are_repeated(spark):
    fails = lambda texts, dim: (_ for _ in ()).throw(OSError("down"))
    docs = spark.createDataFrame([("a", "x y"), ("b", None), ("c", "z")], "id string, chunk_text string")
    with pytest.raises(Exception, match="down"):
        vectors.embed(docs, fails, 4, wait=0.01).collect()
    got = {r.id: r for r in vectors.embed(docs.coalesce(1), dim=4).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].tokens == 1 and list(got["b"].embedding) == [0.0] * 4


def test_settings(tmp_path):
    f = tmp_path / "env"
    f.write_text("CRAWL_DELAY=3.5\n# NOTHING=1\nlog_level='DEBUG'\n")
    got = settings.load({"Crawl_Respect_Robots_Txt": "off", "log_level": "WARN"}, str(f))
    assert (got.crawl_delay, got.log_level, got.crawl_respect_robots_txt, got.crawl_max_retries) == (3.5, "WARN", False, 3)
    with pytest.raises(ValueError):
        settings.load({"crawl_respect_robots_txt": "perhaps"}, None)


def test_deflated_pdf():
    body = zlib.compress(rb"BT (a\(b\)) Tj T* <63640a> Tj (\101\\) ' ET")
    data = b"%PDF-1.7\n1 0 obj <</Type /Page /Contents [2 0 R]>> endobj 2 0 obj <</Filter /FlateDecode /Length 9>>\nstream\n" + body + b"\nendstream endobj"
    assert pdf.read_pdf(data) == ("a(b)\ncd\nA\\", "Untitled", 1)
    with pytest.raises(ValueError):
        pdf.read_pdf(b"GIF89a")


def test_create_and_migrate(spark, tmp_path):
    from loomtext import schemas

    assert set(schemas.create(spark, str(tmp_path))) == set(schemas.KEYS) and schemas.create(spark, str(tmp_path)) == []
    assert schemas.migrate(spark.createDataFrame([("7",)], "code string"), "sources").columns == schemas.schema("sources").fieldNames()


def test_many_dropped_siblings_are_no_square():
    import time

    from loomtext.functions import html as H

    start = time.time()
    assert H.extract("<body>" + "<nav>x</nav>" * 60_000 + "<p>kept</p></body>")["text"] == "kept"
    assert time.time() - start < 10
