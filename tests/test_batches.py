"""Greedy batches against the loop they stand for, in pieces far smaller than a group; retrieval quality of all queries."""

import random

from loomtext.operators import vectors
from loomtext.operators.batches import greedy_batches


def plain(rows, max_tokens, max_items):
    groups = {}
    for g, o, n in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, n or 0, o))
    out = []
    for g, items in groups.items():
        batch = held = count = 0
        for _, _, n, o in sorted(items, key=lambda x: x[:3]):
            if count and (held + n > max_tokens or count >= max_items):
                batch, held, count = batch + 1, 0, 0
            held, count = held + n, count + 1
            out.append((g, o, n, batch))
    return sorted(out, key=repr)


def test_pieces_of_a_group(spark):
    rng = random.Random(6)
    rows = [("hot", i, rng.choice([0, 1, 3, 9, 40, 200])) for i in range(700)] + [(f"g{i % 40}", i, rng.randrange(60)) for i in range(200)]
    rows += [(None, 1, 5), (None, 2, 90), (None, None, 7), ("hot", 5, 3), ("hot", 5, 3), ("", 1, None), ("one", 1, 10_000)]
    df = spark.createDataFrame(rows, "g string, o long, n long").selectExpr("*", "g AS batch").repartition(5)
    for max_tokens, max_items, piece in ((100, 5, 7), (100, 20, 1), (37, 1, 4), (100_000, 2000, 50), (90, 6, 50_000)):
        got = sorted(map(tuple, greedy_batches(df, max_tokens, max_items, piece).collect()), key=repr)
        assert got == plain(rows, max_tokens, max_items), (max_tokens, max_items, piece)
    assert greedy_batches(df.limit(0), 10, 3).collect() == []


def test_quality_keeps_every_query(spark):
    pairs = lambda *x: spark.createDataFrame(list(x), "query_id int, doc_id int")
    found, relevant = pairs((1, 10), (2, 11), (4, 1), (4, 2), (4, 2)), pairs((1, 10), (3, 12), (4, 2), (4, 3), (4, 4))
    got = {r.query_id: tuple(r)[1:] for r in vectors.retrieval_quality(found, relevant, spark.createDataFrame([(5,), (1,)], "query_id int")).collect()}
    assert got == {1: (1, 1, 1, 1.0, 1.0), 2: (1, 0, 0, 0.0, 0.0), 3: (0, 0, 1, 0.0, 0.0), 4: (2, 1, 3, 0.5, 1 / 3), 5: (0, 0, 0, 0.0, 0.0)}
    assert vectors.retrieval_quality(found.limit(0), relevant.limit(0)).collect() == []
