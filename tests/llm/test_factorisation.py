"""The factorisation machine's linear-time score against all pairs written out."""

import numpy as np
import pyarrow as pa

from loomtext.llm import quality as Q


def test_score_equals_all_pairs():
    texts = pa.array(["One two three, two.", "", None, "x" * 200, "THE END 1 2 3\nthe end", "a b c d e f g"])
    rng = np.random.default_rng(4)
    k = len(Q.STATS)
    width = (1 << Q.BITS) + k + k * Q.BINS
    doc, word, stats = Q.features(texts)
    m = Q.Machine(0.3, rng.normal(0, 0.3, width), rng.normal(0, 0.3, (width, Q.RANK)), stats.mean(axis=0), stats.std(axis=0) + 1e-6, np.sort(rng.random((k, Q.BINS - 1)), axis=1))
    d, i, x = m.design(doc, word, stats)
    got = m.score(doc, word, stats)
    for n in range(len(texts)):
        f, v = i[d == n], x[d == n].astype(float)
        y = m.bias + sum(m.linear[a] * p for a, p in zip(f, v))
        y += sum(m.factors[f[a]] @ m.factors[f[b]] * v[a] * v[b] for a in range(len(f)) for b in range(a + 1, len(f)))
        assert abs(got[n] - 1 / (1 + np.exp(-np.clip(y, -30, 30)))) < 1e-5


def test_features_of_single_texts_and_batches_agree():
    texts = ["One two three, two.", "", "x" * 300, "THE END 1 2 3\nthe end", " ", "é ü\n\n"]
    _, _, every = Q.features(pa.array(texts))
    for t, row in zip(texts, every):
        assert np.array_equal(Q.features(pa.array([t]))[2][0], row)
        assert row[0] == sum(c.isascii() and c.isupper() for c in t) / max(len(t.encode()), 1)
