"""The BM25 index against a plain version; words that all documents have; awkward rows."""

import math
import random
import re
from collections import Counter

from loomtext.operators import text_index


def split(text):
    return [w for w in re.split("[ \t\n\r\x0b\f]+", (text or "").lower()) if w]


def plain(docs, queries, k, k1=1.5, b=0.75):
    held = [(d, Counter(split(t))) for d, t in docs]
    n, mean = len(held), sum(c.total() for _, c in held) / len(held)
    df = Counter(w for d, c in held for w in c if d is not None)
    out = []
    for q, text in queries:
        found = []
        for d, c in held:
            s = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * c.total() / mean)) for w in set(split(text)) if w in c]
            if s and d is not None:
                found.append((-round(sum(s), 9), d))
        out += [(q, d, round(-s, 6), r) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def run(spark, path, docs, queries, k):
    a, q = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "1 AS tf", "'x' AS term").repartition(4), spark.createDataFrame(queries, "query_id int, text string")
    text_index.build(a, path)
    return sorted((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in text_index.search(spark, path, q, k).collect())


def test_equals_plain(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 5)
    rng = random.Random(4)
    word = lambda: f"w{min(int(rng.expovariate(0.05)), 150)}"
    docs = [(i, " ".join(["the", *(word() for _ in range(rng.randrange(40)))])) for i in range(250)] + [(900, None), (901, " \t\n"), (902, "The THE\x0bthe ä Ä"), (None, "the w1 w2"), (903, "w5 " * 3000)]
    queries = [(i, " ".join(["The", *(word() for _ in range(rng.randrange(8)))])) for i in range(20)] + [(50, "the"), (51, None), (52, "nothing of this"), (53, "Ä the\tthe")]
    for k in (1, 10):
        assert run(spark, f"{tmp_path}/{k}", docs, queries, k) == plain(docs, queries, k)


def test_a_word_of_all_documents_is_read_for_few(spark, tmp_path):
    docs = [(i, "common " * (1 + i % 3) + f"filler{i % 50} " + ("rare rare" if i % 100 == 0 else "")) for i in range(2000)]
    queries = [(1, "rare common")]
    assert run(spark, str(tmp_path), docs, queries, 5) == plain(docs, queries, 5)
    got = text_index.pruned(spark, str(tmp_path))
    assert got["postings"] == 2020 and got["candidates"] <= 20 and got["scored"] <= 20


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    text_index.build(empty, f"{tmp_path}/a")
    assert text_index.search(spark, f"{tmp_path}/a", spark.createDataFrame([(1, "x")], "query_id int, text string")).collect() == []
    text_index.build(spark.createDataFrame([(1, "x")], "doc_id int, text string"), f"{tmp_path}/b")
    assert text_index.search(spark, f"{tmp_path}/b", empty.withColumnRenamed("doc_id", "query_id")).collect() == []
