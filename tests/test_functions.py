"""Plain-Python parts against small cases and properties."""

import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.functions import html as H
from loomtext.functions import tokens as K
from loomtext.oracle import HTML_ROWS


def test_html_cases():
    got = {i: H.extract(h, s) for i, s, h in HTML_ROWS}
    assert (got[1]["title"], got[1]["text"]) == ("A", "Part\none\nx\ny\nz")
    assert got[1]["headings"] == [{"level": 2, "text": "Partone"}]  # pieces of a heading run together
    assert got[2]["title"] == "Only heading" and got[2]["text"] == "some text"
    assert got[3]["title"] == "Named" and got[4]["title"] == "Given" and got[4]["text"] == "in"
    assert got[5]["text"] == "kept"  # noise is a substring of class, id or role
    assert got[6]["text"] == "chosen" and got[7]["text"] == "chosen"
    assert got[8]["warnings"] == ["No content text found after extraction"] and got[8]["title"] == "Untitled"
    assert got[9]["error"] == "html input is empty"
    assert got[10]["text"] == "a&b <c> open\ntwo"


def test_unbalanced_markup():
    assert H.parse("<div><b>x</div>y</b></i>").pieces() == ["x", "y"]
    assert [e.tag for e in H.parse("<p>a<br>b<p>c").walk()] == ["p", "br", "p"]


def test_crawl_view():
    v = H.crawl_view("<html><head><title></title></head><body><a href='/x'>l</a><div class='my-nav'>n</div><p>t</p></body></html>")
    assert v["title"] == "" and v["text"] == "l\nt" and v["links"] == ["/x"]


def test_paths_reset_deeper_levels():
    text = "A\nx\nB\ny\nC\nz\nD\nw"
    heads = [{"level": 1, "text": "A"}, {"level": 2, "text": "B"}, {"level": 3, "text": "C"}, {"level": 2, "text": "D"}, {"level": 1, "text": "missing"}]
    paths = K.heading_paths(text, heads, [0, text.index("y"), text.index("z"), text.index("w")])
    assert [[h["text"] for h in p] for p in paths] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(3, 20), st.integers(0, 2))
def test_split_covers_all_words(text, size, overlap):
    pieces = K.split(text, size, overlap, len)
    assert all(p and p == p.strip() for p in pieces)
    assert set(text.split()) >= {w for p in pieces for w in p.split()} or any(len(w) + 2 >= size for w in text.split())  # a part counts with its separator
    assert "".join(sorted(set("".join(text.split())))) == "".join(sorted(set("".join("".join(pieces).split()))))
    assert all(o <= len(text) for o in K.offsets(text, pieces))


def test_split_overlaps():
    words = " ".join(f"w{i}" for i in range(100))
    pieces = K.split(words, 10, 3, lambda s: len(s.split()))
    assert all(len(p.split()) <= 10 for p in pieces)
    assert all(set(a.split()) & set(b.split()) for a, b in zip(pieces, pieces[1:], strict=False))


def test_embed_batches(spark):
    from loomtext.operators.vectors import embed_batches

    tokens = [5, 5, 11, 1, 1, 1, 9, 2, 30, 1]
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate(tokens)], "doc_key string, chunk_index int, token_count int")
    got = [r.batch for r in embed_batches(df, max_tokens=12, max_items=3).orderBy("chunk_index").collect()]
    want, batch, items, total = [], 0, 0, 0
    for n in tokens:
        if items and (total + n > 12 or items >= 3):
            batch, items, total = batch + 1, 0, 0
        items, total = items + 1, total + n
        want.append(batch)
    assert got == want


def test_streaming_once(spark, tmp_path):
    from loomtext.streaming.incremental import event_counts, first_seen, pages_stream, run_incremental

    day = datetime.datetime(2024, 1, 1)
    rows = [(1, "u1", "<p>a</p>", "s", day), (2, "u1", "<p>a</p>", "s", day), (3, "u2", "<p>b</p>", "s", day)]
    spark.createDataFrame(rows, "page_id long, url string, html string, source string, crawled_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = first_seen(pages_stream(spark, str(tmp_path / "in")))
    run_incremental(stream, lambda b: b.select("url", "content_hash"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    assert event_counts(events).isStreaming


def test_strip_takes_what_the_pattern_takes(spark):
    from pyspark.sql import functions as F

    from loomtext.functions import native as N

    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000), 0x1F600]]
    rows = spark.createDataFrame([(f"{c} a{c}b \n{c}",) for c in every] + [("",), (None,), (" 　\n",)], "t string")
    old = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    tidied = old(F.regexp_replace(F.regexp_replace("t", r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    assert rows.where(~N.strip("t").eqNullSafe(old(F.col("t"))) | ~N.tidy("t").eqNullSafe(tidied)).count() == 0
    plan = rows.select(N.strip("t"))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan


def test_labels_fold_a_text_once_and_find_what_the_patterns_find(spark):
    from pyspark.sql import functions as F

    from loomtext.functions import native as N
    from loomtext.sources import rules as R

    assert N._marks_of(r"loan[-\s]to[-\s]value") == ["loan", "to", "value"] and N._marks_of(r"singapore\s+(?:permanent\s+resident|PR)") == ["singapore"]
    assert N._marks_of("colou?rs*") == ["colo", "rs"] and N._marks_of("a|b") == []
    said = ["", "loan-to-value", "value to loan", "NON-REſIDENT", "non resident", "Houſing  grant", "KLTV LTV", "current", "Rent.", "buyer’s stamp duty", "sıngapore PR", "İndustrial", "EC second", "landed residential", "private property", "cooling measures"]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    for rules in (R.PROPERTY_RULES, R.CITIZENSHIP_RULES, R.TOPIC_RULES):
        plain = F.array_compact(F.array(*[F.when(F.col("t").rlike(N.pattern(a)), F.lit(label)) for label, a in sorted(rules)]))
        got = rows.select("t", N.labels(F.col("t"), rules).alias("got"), plain.alias("want"))
        assert got.where("not got <=> want").collect() == []
        shown = got.select("got")._jdf.queryExecution().executedPlan().toString()
        assert shown.count("lower(") == 1
