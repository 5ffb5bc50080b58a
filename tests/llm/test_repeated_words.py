"""Decontamination of items whose shingles repeat: fingerprints of multisets, and no lost link."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from loomtext.llm import decontaminate as D
from loomtext.llm.words import rolling, words_of


def shingles(text, k=5):
    return rolling(words_of(pa.array([text])).hashes, k)


def test_numbers_count_in_windows():
    h = np.random.default_rng(1).integers(0, 4, 60).astype(np.uint64)
    for size in (1, 3, 7, 60):
        come, go = D.numbers(h, size)
        for p in range(len(h)):
            assert come[p] == list(h[max(0, p - size + 1) : p + 1]).count(h[p])
            assert go[p] == list(h[p : p + size]).count(h[p])


def test_running_sums_equal_multisets():
    rng = random.Random(5)
    h = shingles(" ".join(rng.choice("ab") for _ in range(120)))
    size = 40
    come, go = D.numbers(h, size)
    enter, leave = (np.concatenate([np.zeros((1, D.BITS), int), np.cumsum(D._signs(D.elements(h, x)), axis=0, dtype=int)]) for x in (come, go))
    for s in range(len(h) - size + 1):
        part = h[s : s + size]
        own = D._signs(D.elements(part, D.numbers(part, size)[0])).sum(axis=0, dtype=int)
        assert (enter[s + size] - leave[s] == own).all()


def test_repeated_word_is_not_missed():
    """An item of 180 distinct words and one word 20 times in a row; a document with another word in that place."""
    rng, missed, near = random.Random(9), 0, 0
    for _ in range(60):
        words = [f"w{rng.randrange(10**9)}" for _ in range(180)]
        at = rng.choice((0, 180))
        item, text = (" ".join([*words[:at], *[x] * 20, *words[at:]]) for x in (f"x{rng.randrange(10**9)}", f"y{rng.randrange(10**9)}"))
        a, b = shingles(item), shingles(text)
        if D.weighted_jaccard(Counter(a.tolist()), Counter(b.tolist())) >= 0.8:
            near += 1
            index = D.Index([(1, item)], 5)
            missed += not D._matches(index.groups[0], b, 0.8)
    assert near >= 50 and missed == 0
