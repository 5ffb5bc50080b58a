"""Words that sums would confuse, and lists of alike sets longer than a task holds."""

import brute
import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import jaccard_join as J
from loomtext.llm.words import second_hashes, words_of


def test_long_words_do_not_collide():
    for n in (10, 11, 12):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))
        w = words_of(pa.array([a + " " + a.translate({97: 98, 98: 97}) + " " + a.upper()]))
        for h in (w.hashes, second_hashes(w)):
            assert h[0] != h[1] and h[0] == h[2]
    assert (words_of(pa.array(["x yy"])).hashes != second_hashes(words_of(pa.array(["x yy"])))).all()


def test_one_long_list_takes_few_rounds(spark, monkeypatch):
    """Near copies of one text, more than a task holds: their list is named once, and left out as one component then."""
    monkeypatch.setattr(J, "HELD", 20)
    monkeypatch.setattr(J, "WHOLE", 10)
    monkeypatch.setattr(J, "PAIRS_EACH", 1)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:119], f"own{i}"])) for i in range(150)] + [(500 + i, " ".join(f"z{i}q{j}" for j in range(30))) for i in range(10)]
    rounds = []
    plain = J._name_pairs
    monkeypatch.setattr(J, "_name_pairs", lambda t, pivots: rounds.append(pivots) or plain(t, pivots))
    got = J.alike(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute.alike(rows, 85, 4))
    assert len(rounds) <= 3


def test_long_lists_of_several_components(spark, monkeypatch):
    """Groups that share most shingles with one another but don't link, in lists longer than a task holds."""
    monkeypatch.setattr(J, "HELD", 15)
    monkeypatch.setattr(J, "WHOLE", 10)
    monkeypatch.setattr(J, "PAIRS_EACH", 1)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in rng.integers(0, 80, int(rng.integers(1, 5))):
            w[j] = f"g{int(rng.integers(0, 3))}"
        rows.append((i, " ".join(w)))
    got = J.alike(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute.alike(rows, 85, 4))


@pytest.mark.parametrize("whole", [1000, 4096])
def test_pivots_give_pairs_out_in_bounded_parts(whole, monkeypatch):
    """3,000 members of 3,000 components, none ruled out: with 300 pivots 0.9 million pairs, never held together."""
    monkeypatch.setattr(J, "WHOLE", whole)
    m = 3000
    rng = np.random.default_rng(0)
    cls = np.sort(rng.integers(1, 1 << 60, m))
    zero = np.zeros(m, np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(zero + 5), pa.array(zero + 40), pa.array(cls), pa.array(cls), pa.array(zero)], ["key", "n", "cls", "comp", "place"])
    most, pairs, rest = 0, set(), 0
    for out in J._name_pairs(85, 300)(iter([batch])):
        most = max(most, out.num_rows)
        both = out.column(5).to_numpy(zero_copy_only=False)
        pairs |= set(zip(out.column(0).to_numpy()[both].tolist(), out.column(1).to_numpy()[both].tolist(), strict=True))
        rest += int((~both).sum())
    assert most <= J.GIVEN + 32 * m and rest == m - 300
    assert len(pairs) == 300 * (m - 300) + 300 * 299 // 2


def test_parities_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    d = np.sort(rng.integers(0, 50, 4000))
    h = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    whole = J._parities(d, h, 50).to_pylist()
    monkeypatch.setattr(J, "COUNTED", 7)
    assert J._parities(d, h, 50).to_pylist() == whole


def test_pivots_name_few_pairs_with_a_component():
    """Thirty sets that a large component doesn't take in: not a pair with each of its members in a round, but all in the end."""
    n, alone = 1000, 30
    comp = np.r_[np.zeros(n, np.int64), np.arange(n, n + alone)]
    left, named, first, pivots = np.arange(n + alone), set(), None, 8
    while len(left):
        cols = [np.zeros(len(left), np.int64), np.full(len(left), 100), left, comp[left], np.zeros(len(left), np.int64)]
        got = pa.Table.from_batches(J._name_pairs(80, pivots)(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "n", "cls", "comp", "place"])]))).to_pydict()
        pairs = {(u, v) for u, v, p in zip(got["u"], got["cls"], got["pair"], strict=True) if p}
        first = first or len(pairs)
        named |= pairs
        left = np.array(sorted(v for v, p in zip(got["cls"], got["pair"], strict=True) if not p), np.int64)
        pivots *= 8
    assert first < n
    assert named == {(u, v) for v in range(n, n + alone) for u in range(v)}
