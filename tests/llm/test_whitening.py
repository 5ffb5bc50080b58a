"""op11 against a plain covariance and the library's eigenvectors; awkward vectors."""

import math
from decimal import Decimal

import numpy as np
import pytest

from loomtext.llm import queries as Q
from loomtext.llm import whitening as W


def plain(vectors, k=8):
    """{(place, component): (n, deviation, |whitened|, explained)} by definition."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(c) - s / n for c, s in zip(r, sums, strict=True)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, r in enumerate(x):
        for c in range(min(k, len(r))):
            out[i, c + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)), abs(centred[i] @ axes[:, c]) / math.sqrt(values[c]), values[c] / values.sum())
    return out


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null").orderBy("vec_id").collect()
    rows = [r for r in rows if all(c is not None and math.isfinite(c) for c in r.embedding)]
    want = plain([r.embedding for r in rows])
    got = {(r.vec_id, r.component): r for r in Q.op11_whitening(spark, sf).collect()}
    assert len(got) == len(want) == 8 * len(rows)
    for (i, c), (n, deviation, size, share) in want.items():
        r = got[rows[i].vec_id, c]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(size, abs=1e-8) and r.explained == pytest.approx(share, rel=1e-9) and r.identity_error < 1e-9


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_symmetric_qr(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d))
    for m in (a + a.T, np.eye(d), np.zeros((d, d)), np.outer(a[0], a[0]), np.diag(np.arange(d))):
        values, rows = W.symmetric_qr(m)
        assert np.allclose(rows @ rows.T, np.eye(d), atol=1e-13) and np.allclose(rows.T * values @ rows, m, atol=1e-12 * max(1, np.abs(m).max()) * d)
        assert (np.diff(values) <= 0).all()


def test_moments_merge_in_any_cut():
    x = np.random.default_rng(0).normal(size=(301, 5)) + 1e5
    want = np.cov(x.T, bias=True)
    for cuts in ([301], [1, 300], [100, 0, 1, 200], [1] * 301):
        total, at = W.Moments.none(5), 0
        for i, c in enumerate(cuts):
            part = W.Moments.none(5)
            for piece in np.array_split(x[at : at + c], 3):
                if len(piece):
                    part.update(piece)
            if i % 2:
                part.merge(total)
                total = part
            else:
                total.merge(part)
            at += c
        assert np.allclose(total.covariance(), want, rtol=1e-9, atol=1e-9) and total.n == 301


def test_many_partitions_merge_in_levels(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 3)
    rng = np.random.default_rng(4)
    vectors = [[float(c) for c in rng.normal(size=4)] for _ in range(60)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(31)
    want = plain([[float(np.float32(c)) for c in v] for v in vectors])
    got = {(r.vec_id, r.component): r for r in W.whiten(df).collect()}
    assert set(got) == set(want)
    for key, (n, deviation, size, share) in want.items():
        assert (got[key].n, got[key].deviation) == (n, Decimal(deviation)) and abs(got[key].whitened) == pytest.approx(size, abs=1e-9) and got[key].explained == pytest.approx(share)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [0.0, 5.0], None), (4, None, "b"), (5, [1.0, None], "b"), (6, [nan, 1.0], "b"), (7, [inf, 1.0], "b"), (8, [], "b"), (9, [1.0, 2.0, 3.0], "b"), (10, [1e17, 0.0], "b"), (11, [3.0, -1.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    got = W.whiten(df).collect()
    assert sorted(((r.vec_id is None, r.vec_id, r.component) for r in got), key=repr) == sorted([(False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (True, None, 1), (True, None, 2), (False, 11, 1), (False, 11, 2)], key=repr)
    assert {r.n for r in got} == {4} and all(r.identity_error < 1e-9 for r in got)
    assert W.whiten(df.limit(0)).collect() == [] and W.whiten(df.where("vec_id = 4")).collect() == []
    one = W.whiten(df.where("vec_id = 1")).collect()  # two equal vectors: no variance at all
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(2, 0, 0.0, 0.0, 1.0)] * 4
    wide = W.whiten(spark.createDataFrame([(1, [1e12]), (2, [-3e12]), (3, [8e14])], "vec_id int, embedding array<double>")).collect()
    x = [math.floor(1024 * v) + 100000 for v in (1e12, -3e12, 8e14)]
    want = [(3 * a - sum(x)) ** 2 for a in x]
    assert [int(r.deviation) for r in sorted(wide)] == want
