"""Plans: how often tables are read and Python is called."""

import pytest
from loomtext.plans import document_pipeline
from loomtext.queries import _pages, queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_page_is_parsed_once(spark, sf):
    rows = document_pipeline.to_rows(document_pipeline.process(_pages(spark, sf), None))
    assert plan(rows).count("MapInArrow") == 2 and plan(rows).count("Exchange") == 1 and plan(rows).count("FileScan") == 1
    assert plan(document_pipeline.vectors_of(rows)).count("MapInArrow") == 3


def test_pages_are_read_once(spark, sf):
    for name in ("page_word_stats", "crawl_results_tax"):
        assert plan(queries()[name](spark, sf)).count("FileScan") == 1


def test_each_rule_is_one_pattern(spark, sf):
    assert plan(queries()["tag_topics"](spark, sf)).count("RLIKE") == 12  # the literal cases are folded


def test_numbers_follow_text_and_tables(spark):
    html = "<title>T</title><main>" + "<p>word one two.</p>" * 30 + "<table><tr><th>H</th></tr><tr><td>v</td></tr></table></main>"
    pages = spark.createDataFrame([(1, "u", "hdb", html)], "page_id long, url string, source string, html string")
    got = document_pipeline.process(pages, None, "words", 40, 5, 1, 600).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and got[-1].chunk_type == "table" and got[0].chunk_type == "text"
    assert got[0].document_metadata.source_agency == "HDB" and all(r.source_url == "u" for r in got)


def test_urls_are_computed_once(spark, sf):
    """A link's URL is bound to a name before it is taken apart, so that it isn't copied into each of its parts."""
    got = plan(queries()["page_links"](spark, sf))
    assert got.count("RLIKE") <= 5 and got.count("regexp_extract") <= 8 and got.count("aggregate(") <= 1 and len(got) < 12_000


@pytest.mark.parametrize("name", ["pdf_text", "html_tables", "rate_tables"])
def test_short_rows_are_dealt_to_many_tasks(name, spark, sf):
    """A small table whose rows take long is not read and worked on in one task."""
    from loomtext.queries import queries

    assert "REPARTITION_BY_NUM" in queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_written_files_share_batches(spark):
    """Many small files make one Arrow batch, not one each."""
    import pyarrow as pa

    from loomtext.sources import pdf_write

    class Rows:
        sparkSession = spark  # noqa: N815

        def mapInArrow(self, run, schema):  # noqa: N802
            return list(run(iter([pa.RecordBatch.from_pylist([{"url": str(i)} for i in range(50)])])))

    got = pdf_write._written(Rows(), lambda row: row["url"].encode())
    assert len(got) == 1 and got[0].column(1).to_pylist()[49] == b"49"


def test_a_documents_own_columns_are_not_taken_apart(spark, monkeypatch):
    """Metadata go round Python's dictionaries: a batch's rows are read without them."""
    import pyarrow as pa

    from loomtext.operators import chunk

    given = []

    class Rows:
        def __init__(self, df):
            self.df, self.sparkSession, self.schema = df, df.sparkSession, df.schema

        def select(self, *cols):
            return Rows(self.df.select(*cols))

        def mapInArrow(self, run, schema):  # noqa: N802
            batch = self.df.toArrow().combine_chunks().to_batches()[0]
            monkeypatch.setattr(chunk, "_pieces", lambda text, *_: given.append(text) or iter([{"chunk_index": i, "chunk_text": w, "start": 0, "heading_path": [], "word_count": 1, "token_count": 1} for i, w in enumerate(text.split())]))
            return pa.Table.from_batches(list(run(iter([batch])))).to_pylist()

    kind = "doc_key string, text string, headings array<struct<level:int,text:string>>, tables array<struct<headers:array<string>,rows:array<array<string>>,caption:string,page_number:int,source_tag:string>>, metadata struct<a:string>, url string, source string, content_type string"
    rows = spark.createDataFrame([("1", "p q", [], [], ("m",), "u", "s", "html"), ("2", "", [], [], ("n",), "v", "s", "html"), ("3", "r", [], [], None, None, "t", "html")], kind)
    got = chunk.chunks(Rows(rows), tokens="words")
    assert [(r["doc_key"], r["chunk_text"], r["metadata"], r["source_url"], r["source_name"]) for r in got] == [("1", "p", {"a": "m"}, "u", "s"), ("1", "q", {"a": "m"}, "u", "s"), ("3", "r", None, None, "t")]
