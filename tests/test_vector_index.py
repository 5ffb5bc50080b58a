"""The index against all cosines: same rows, fewer cells; recall of the approximate search; hot and awkward vectors."""

import numpy as np
import pytest

from loomtext.operators import topk, vector_index, vectors


def plain(rows, asked, k):
    ids, v = np.array([r[0] for r in rows]), topk.unit(np.array([r[1] for r in rows], np.float32).astype(float))
    out = []
    for q, x in asked:
        s = np.round(v @ topk.unit(np.array([x], np.float32).astype(float))[0], topk.DIGITS)
        out += [(q, int(ids[i]), p) for p, i in enumerate(np.lexsort((ids, -s))[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(size=16) * 0.15).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(1500)]  # a third of all are one vector
    return rows


def frames(spark, rows, asked):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id % 2 AS odd", "'x' AS score").repartition(6)
    return v, spark.createDataFrame(asked, "query_id long, embedding array<float>")


def found(df):
    return sorted((r.query_id, r.vec_id, r["rank"]) for r in df.collect())


def test_exact_search_reads_fewer_cells(spark, clustered, tmp_path):
    asked = clustered[:40] + [(9000, clustered[7][1])]
    v, q = frames(spark, clustered, asked)
    n = vector_index.build(v, str(tmp_path), 40)
    want = plain(clustered, asked, 7)
    for one in asked[0], asked[7]:
        read = []
        got = found(vector_index.search(spark, str(tmp_path), q.where(f"query_id = {one[0]}"), 7, read=read))
        assert got == [w for w in want if w[0] == one[0]] and sum(read) < n / 2
    assert found(vector_index.search(spark, str(tmp_path), q, 7)) == want == found(vectors.cosine_topk(v, q, 7))


def test_approximate_search(spark, clustered, tmp_path):
    asked = clustered[::60]
    v, q = frames(spark, clustered, asked)
    vector_index.build(v, str(tmp_path), 40, keep=("odd",))
    want, got = set(plain(clustered, asked, 10)), set(found(vector_index.search(spark, str(tmp_path), q, 10, probes=2)))
    assert len({w[:2] for w in want} & {g[:2] for g in got}) >= 0.9 * len(want)
    some = [r for r in clustered if r[0] % 2]
    assert found(vector_index.search(spark, str(tmp_path), q, 10, condition="odd = 1")) == plain(some, asked, 10)


def test_blocks_of_queries_and_small_tiles(spark, clustered, monkeypatch, tmp_path):
    monkeypatch.setattr(topk, "QUERY_BYTES", 16 * 8 * 9)
    asked = clustered[:30]
    v, q = frames(spark, clustered, asked)
    assert found(vectors.cosine_topk(v, q, 3)) == plain(clustered, asked, 3)
    best = topk.Best(2, 3)
    for own, s in (([5, 4], [[1, 0], [1, 1]]), ([3, 1, 2, 9], [[1, 0], [1, 2], [0, 1], [1, 1]])):
        best.add(np.array([0, 1]), np.array(own), np.array(s, float))
    assert best.ids.tolist() == [[1, 3, 4], [1, 2, 4]]


def test_awkward_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0, 2.0]), (5, []), (6, [-1.0, 0.0]), (1, [1.0, 0.0])]
    v, q = frames(spark, rows, [(1, [2.0, 0.0]), (2, None), (None, [1.0, 0.0])])
    want = [(1, 1, 1), (1, 1, 2), (1, 3, 3), (1, 6, 4)]
    assert found(vectors.cosine_topk(v, q, 9)) == want
    vector_index.build(v, f"{tmp_path}/a")
    assert found(vector_index.search(spark, f"{tmp_path}/a", q, 9)) == want
    assert vector_index.build(v.limit(0), f"{tmp_path}/b") == 0
    assert vector_index.search(spark, f"{tmp_path}/b", q, 9).collect() == [] == vectors.cosine_topk(v.limit(0), q).collect() == vectors.cosine_topk(v, q.limit(0)).collect()
