"""Paths by one sweep, and by windows, against the definition; kept counts of tokens."""

import random
import time

from loomtext.functions import tokens as K
from loomtext.operators import asof


def plain(placed, s):
    path = {}
    for at, level, said in sorted(placed, key=lambda x: x[0]):
        if at <= s:
            path = {k: v for k, v in path.items() if k < level} | {level: said}
    return [(k, path[k]) for k in sorted(path)]


def test_sweep_and_windows(spark):
    rng = random.Random(8)
    places, headings, want = [], [], {}
    for doc in range(30):
        placed = sorted((p, rng.randrange(1, 7), f"h{i}") for i, p in enumerate(rng.sample(range(200), rng.randrange(0, 25))))
        starts = [rng.randrange(-5, 210) for _ in range(20)]
        places += [(doc, s) for s in starts]
        headings += [(doc, *p) for p in placed]
        want |= {(doc, s): plain(placed, s) for s in starts}
        text = list("." * 210)
        for at, _, _ in placed:
            text[at] = chr(0x4E00 + at)
        got = K.heading_paths("".join(text), [{"level": v, "text": text[at]} for at, v, _ in placed], starts)
        assert [[h["level"] for h in g] for g in got] == [[k for k, _ in want[doc, s]] for s in starts]
    headings += [(0, None, 1, "no place"), (0, 3, None, "no level")]
    a, b = spark.createDataFrame(places, "doc_key int, start int"), spark.createDataFrame(headings, "doc_key int, at int, level int, text string")
    found = asof.heading_paths(a, b).collect()
    assert sorted((r.doc_key, r.start) for r in found) == sorted(places)
    assert all([tuple(h) for h in r.path] == want[r.doc_key, r.start] for r in found)


def test_many_headings_take_linear_time():
    n = 20_000
    text = "".join(f"h{i:06d} and text. " for i in range(n))
    start = time.time()
    got = K.heading_paths(text, [{"level": i % 5 + 1, "text": f"h{i:06d}"} for i in range(n)], [*range(0, len(text), 20), len(text)])
    assert time.time() - start < 10 and len(got[-1]) == (n - 1) % 5 + 1


def test_kept_counts_are_the_same(monkeypatch):
    monkeypatch.setattr(K, "KEPT", 5)
    kept = K.counter.__wrapped__("bpe")
    monkeypatch.setattr(K, "SHORT", -1)
    plain_count = K.counter.__wrapped__("bpe")
    words = [f" w{i % 9}{'x' * (i % 7)}" for i in range(200)] + ["", " ", "\n\n", "é" * 60]
    assert [kept(w) for w in words] == [plain_count(w) for w in words]
