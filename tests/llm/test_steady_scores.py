"""Scores that don't depend on the layout of files, and probabilities that hold on rows no label was learnt from."""

import numpy as np

from loomtext.llm import queries as Q
from loomtext.llm import toxicity as T
from loomtext.llm.quality import quality_scores


def test_quality_is_the_same_on_any_layout(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = lambda df: sorted((r.doc_id, r.score, r.predicted) for r in df.collect())
    assert rows(quality_scores(docs, labels)) == rows(quality_scores(docs.repartition(7), labels.repartition(3)))


def test_reliability_on_held_out_rows(spark):
    """In each band of probability that has 30 labelled held-out rows, their share of label 1 is within 0.1 of the mean."""
    d = "/root/testdata/sf0.1"
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null").collect()}
    got = Q.op7_toxicity(spark, d).where("held_out").select("doc_id", "probability").collect()
    p, y = np.array([(r.probability, known[r.doc_id]) for r in got if r.doc_id in known]).T
    bands = [(p >= a) & (p < a + 0.2 + (a == 0.8)) for a in (0, 0.2, 0.4, 0.6, 0.8)]
    assert sum(b.sum() >= 30 for b in bands) >= 3
    for b in bands:
        assert b.sum() < 30 or abs(p[b].mean() - y[b].mean()) < 0.1


def test_isotonic():
    x, y = np.array([0.1, 0.2, 0.3, 0.4, 0.9]), np.array([0, 1, 0, 1, 1])
    at, value = T.isotonic(x, y, np.ones(5))
    assert np.allclose(at, [0.1, 0.25, 0.65]) and (np.diff(value) >= 0).all()
    assert np.allclose(value, [(0 + 0.6) / 2, (1 + 0.6) / 3, (2 + 0.6) / 3])
