"""op13 beside its SQL (test_llm_queries): a plain version on small texts, small ranges, awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np

from loomtext.llm import search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n, size = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, want in asked.items():
        scores = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n // size if size else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in want if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def test_small_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "ENTRIES", 40)
    monkeypatch.setattr(S, "BLOCK_BYTES", 300)
    rng = random.Random(5)
    pool = ["alpha", "Beta", "ÄRGER", "ärger", "x1", "9", "the", "the", "of", "zeta", "日本"]
    make = lambda n: "".join(rng.choice(pool) + rng.choice([" ", "-", "\n", "_", ". "]) for _ in range(n))
    docs = [(i, make(rng.randrange(0, 60))) for i in range(300)] + [(7, "alpha beta"), (7, "alpha beta"), (None, "zeta zeta"), (900, None), (901, ""), (902, "--- __"), (903, "zeta " * 4000)]
    items = [(i, make(rng.randrange(0, 9))) for i in range(25)] + [(3, "zeta"), (None, "alpha"), (None, "9"), (77, None), (78, "unknownterm"), (79, "Zeta zeta ZETA")]
    a = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "'z' AS score", "1 AS item_id").repartition(5)
    b = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "0 AS rank")
    for k in (1, 10):
        assert sorted(map(tuple, S.search(a, b, k).collect()), key=repr) == plain(docs, items, k)
    assert S.search(a.limit(0), b).collect() == [] and S.search(a, b.limit(0)).collect() == []


def test_radix_order():
    rng = np.random.default_rng(1)
    for top in (1, 1 << 16, 1 << 17, 1 << 40, (1 << 64) - 1):
        keys = rng.integers(0, top, 5000, dtype=np.uint64, endpoint=True)
        assert (S.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    got = S.summed(np.array([5, 1, 5, 1, 9], np.uint64), np.array([1, 2, 3, 4, 5]))
    assert got[0].tolist() == [1, 5, 9] and got[1].tolist() == [6, 4, 5]
    assert len(S.radix_order(np.zeros(0, np.uint64))) == 0


def test_large_lengths_dont_overflow():
    assert S.lengths(np.array([10**9]), 10**11, 10**12).tolist() == [10 + 90 * 10**9 * 10**11 // 10**12]
