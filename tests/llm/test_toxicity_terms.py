"""Toxicity is searched over all terms of the labelled sample, not over some that speak for label 1."""

import random
import zlib

import numpy as np
import pyarrow as pa

from loomtext.llm import toxicity as T


def test_rare_wording_finds_its_neighbours(spark):
    """Each toxic wording occurs in two examples only, so no lexicon of frequent label-1 terms has it."""
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    word = lambda g, j: zlib.crc32(f"{g}/{j}".encode()).to_bytes(4, "big").hex()
    said = lambda g: " ".join(word(g, j) for j in range(8))
    rows = [(i, said(n // 2), n // 2 % 2) for n, i in enumerate(free)]
    rows += [(i, said(n % (len(free) // 2)), n % (len(free) // 2) % 2) for n, i in enumerate(held)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i in set(free)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for i, t, y in rows:
        assert got[i].predicted == y
        assert all(texts[e] == t for e in got[i].evidence[:2])


def test_search_equals_all_cosines(monkeypatch):
    monkeypatch.setattr(T, "COLUMNS", 40)
    rng = random.Random(3)
    words = [f"w{i}x{i * i % 97}" for i in range(900)]
    texts = [" ".join(words[min(int(rng.expovariate(0.02)), 899)] for _ in range(rng.randint(1, 60))) for _ in range(700)]
    texts += texts[:20]
    column = pa.array(texts)
    vocab = T.Vocabulary(np.unique(np.concatenate([h for _, h in T.terms_of(column)])))
    doc, term, times = vocab.counts(column)
    assert times.sum() == sum(len(h) for _, h in T.terms_of(column))
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    index = T.Examples(vocab, np.random.default_rng(2).uniform(1, 6, len(vocab.hashes)))
    index.build([(i, i % 2, term[a:b], times[a:b]) for i, (a, b) in enumerate(zip(at[:600], at[1:601], strict=True))])
    dense = np.zeros((len(texts), len(vocab.hashes)))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        dense[i, term[a:b]] = index.vectors(term[a:b], times[a:b])
    cosines = dense @ dense[index.ids].T
    got = index.scores(at, term, times)
    number = np.bincount(index.labels)
    for i, (score, evidence) in enumerate(got):
        top = np.lexsort((np.arange(600), -np.round(cosines[i], 12)))[: T.NEAREST]
        top = top[cosines[i][top] > 0]
        assert evidence == index.ids[top].tolist()
        pull = cosines[i][top] ** 2 / number[index.labels[top]]
        assert abs(score - pull @ index.labels[top] / pull.sum()) < 1e-9


def test_bytes_of_a_batch_are_weighed_once(monkeypatch):
    from loomtext.llm import words

    column = pa.array([f"Some words, of which {'longer' * i} ones have affixes." for i in range(30)])
    each = [h for _, h in T.terms_of(column)]
    calls = []
    own = words.powers
    monkeypatch.setattr(words, "powers", lambda base, n: calls.append(base) or own(base, n))
    assert all((a == b).all() for a, b in zip(each, (h for _, h in T.terms_of(column)), strict=True))
    assert calls.count(words._P) == 1


def test_search_without_bounds_finds_the_same(monkeypatch):
    """Where bounds spare few blocks, the documents that follow are searched without them."""
    rng = np.random.default_rng(4)
    vocab = T.Vocabulary(rng.integers(1, 2**63, 50, dtype=np.uint64))
    examples = [(i, i % 2, np.sort(rng.choice(50, 12, replace=False)), rng.integers(1, 4, 12)) for i in range(2000)]
    first, term = np.arange(0, 12 * 601, 12), np.concatenate([e[2] for e in examples[:600]])
    times = np.concatenate([e[3] for e in examples[:600]])
    got = []
    for whole in (0, 5):
        monkeypatch.setattr(T, "WHOLE", whole)
        index = T.Examples(vocab, rng.uniform(1, 5, 50) if not got else index.idf)
        index.build(examples)
        got.append(index.scores(first, term, times))
        assert (index.whole > 0) == (whole > 0)
    assert got[0] == got[1]
    dense = np.zeros((2000, 50))
    for i, e in enumerate(examples):
        dense[i, e[2]] = index.vectors(e[2], e[3])
    for i in range(0, 600, 40):
        cosines = dense[index.ids] @ dense[i]
        assert got[0][i][1] == index.ids[np.lexsort((np.arange(2000), -np.round(cosines, 12)))[: T.NEAREST]].tolist()
