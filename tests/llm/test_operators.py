"""Each operator against its plain version, and on awkward tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pytest

SCHEMA = "doc_id long, text string"
CLASH = "doc_id long, text string, digest string, kept string, file string, row int, key int, n int, cls int, bucket int, blob string, label int, score double, __hit int, __dropped int, __file int, __row int, lang string"


def awkward(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Él", "ÀB", "x,"]
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(None, "null id"), (1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a B"), (5, "a B"), (6, "a b \x00 c"), (7, "x" * 5000), (8, " ".join(rng.choice(words) for _ in range(3000)))]
    for i in range(9, 60):
        w = [rng.choice(words) for _ in range(rng.randint(1, 25))]
        rows.append((i, " ".join(w)))
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "z"
            rows.append((100 + i, " ".join(w)))
        if i % 7 == 0:
            rows.append((200 + i, rows[-1][1]))
        if i % 5 == 0:
            rows.append((300 + i, " ".join(w) + " " + passage + " tail " + str(i)))
    rows.append((400, passage + " " + passage))
    rows.append((None, passage))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = awkward()
    return rows, spark.createDataFrame([r + (f"d{i}", None, "f", 1, 2, 3, 4, 5, "b", 6, 0.5, 7, 8, 9, 10, "en") for i, r in enumerate(rows)], CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(rows):
    return sorted(rows, key=repr)


def close(a, b):
    return all(x == y if not isinstance(y, float) else abs(x - y) <= 1e-7 * max(1, abs(y)) for x, y in zip(a, b, strict=True))


def test_katz(table, empty, spark, tmp_path):
    from loomtext.llm.katz import read_bigrams, read_weights, score, score_texts
    from loomtext.llm.runtime import crc_mod

    rows, df = table
    path = str(tmp_path / "model")
    got = order(map(tuple, score_texts(df, model_to=path).collect()))
    want = order(brute.katz(rows))
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    assert len(got) == len(want) and all(close(a, b) for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True))
    weights, pairs = read_weights(spark, path), read_bigrams(spark, path)
    assert weights.count() > 0 and weights.where("weight <= 0").count() == 0
    sums = pairs.groupBy("history").agg({"count": "sum"}).join(weights, "history")
    assert sums.count() == weights.count() and sums.where("`sum(count)` <> count").count() == 0
    again = sorted(map(tuple, score(df, path, crc_mod("doc_id", 7) == 2).collect()), key=key)
    assert all(close(a, b) for a, b in zip(again, sorted(want, key=key), strict=True))
    new = score(spark.createDataFrame([(1, "never seen"), (2, None)], SCHEMA), path).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in new) == [(1, 3, 1), (2, 1, 1)]
    assert score_texts(empty).count() == 0 and score(empty, path).count() == 0
    none = {r.doc_id: r for r in score_texts(df.where("doc_id < 3"), df.doc_id > 0).collect()}
    assert len(none) == 2 and all(r.n_known == r.train_tokens == r.score == 0 for r in none.values())


def test_good_turing_falls_back():
    from loomtext.llm.katz import good_turing

    assert good_turing([0] * 7).tolist() == [-0.5, 0.5, 1.5, 2.5, 3.5, 4.5]
    star = good_turing([0, 1000, 300, 150, 90, 60, 45])
    assert all(0 < star[r] < r for r in range(1, 6))


def test_decontaminate(table, empty, spark):
    from loomtext.llm.decontaminate import contaminated, decontaminate_stage

    rng = random.Random(4)
    items = [(i, " ".join(f"i{rng.randrange(400)}" for _ in range(rng.randint(1, 45)))) for i in range(30)] + [(50, None), (51, ""), (52, "a b")]
    rows = list(table[0])
    for i, text in items[:30]:
        w = text.split()
        if len(w) > 8:
            w[rng.randrange(len(w))] = "changed" if i % 2 else w[0]
        rows.append((1000 + i, " ".join(["lead"] * 7 + w + ["tail"] * 9)))
        rows.append((2000 + i, " ".join(w[: max(1, len(w) - 2)])))
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(docs, bench).collect()}
    want = brute.similar_windows(rows, items)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    left = {r.doc_id for r in decontaminate_stage(docs, bench).select("doc_id").collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in want if d is not None}
    assert contaminated(empty, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate_stage(table[1], bench).columns == table[1].columns


def test_token_counts(table, empty, spark, tmp_path):
    from loomtext.llm.bpe import encoding, read_ranks
    from loomtext.llm.token_counts import count_tokens, file_blocks, flat_blocks

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    data, eod = read_ranks(path)
    enc = encoding(data)
    rows, df = table
    for size in (7, 1 << 16):
        got = order((r.doc_id, r.n_tokens) for r in count_tokens(flat_blocks(df, path, size), eod).collect())
        assert got == order((d, len(enc.encode_ordinary(t or ""))) for d, t in rows)
    assert count_tokens(flat_blocks(empty, path), eod).count() == 0
    flat = np.array([1, 2, eod, eod, 3, eod, 4, 5, 6], "<u2")
    (tmp_path / "a.bin").write_bytes(flat.tobytes())
    for size in (1, 2, 4, 100):
        got = [(r.start, r.n_tokens, r.ended) for r in count_tokens(file_blocks(spark, str(tmp_path), size), eod).orderBy("position").collect()]
        assert got == [(0, 2, True), (3, 0, True), (4, 1, True), (6, 3, False)]


def test_substring_dedup(table, empty):
    from loomtext.llm.substring_dedup import remove_repeats

    rows, df = table
    got = order((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in remove_repeats(df).collect())
    want = order(brute.repeats(rows))
    assert got == want and any(w[2] for w in want)
    assert remove_repeats(empty).count() == 0


def test_substring_dedup_shuffled_ids(spark, monkeypatch):
    from loomtext.llm import substring_dedup as S

    monkeypatch.setattr(S, "BROADCAST_IDS", 0)  # as for more ids than may be broadcast
    rng = random.Random(8)
    base = [f"v{rng.randrange(1000)}" for _ in range(200)]
    rows = [(i, " ".join(["a" + str(i)] * rng.randint(0, 30) + base[a : a + rng.randint(20, 120)] + ["b" + str(i)] * 40)) for i, a in enumerate(rng.randrange(150) for _ in range(80))]
    got = order((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in S.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == order(brute.repeats(rows))


def test_chat(spark):
    from loomtext.llm.bpe import encoding, read_ranks
    from loomtext.llm.chat import assemble, digests, escape, format_turns, read_back, unescape

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    data, n = read_ranks(path)
    enc = encoding(data)
    texts = ["", "<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "a\nb", "é🎉", "<", "|"]
    assert all(unescape(escape(t)) == t and "<|" not in escape(t) for t in texts)
    turns = [(role, t) for role in ("user", "assistant", "a\nb\\<|") for t in texts]
    ids, mask, at = assemble(turns, enc, n + 1, n + 2)
    back = [x for i, j in zip(at[:-1], at[1:], strict=True) for x in read_back(ids[i:j], mask[i:j], enc, n + 1, n + 2)]
    assert [(r, t) for r, t, _, _ in back] == turns
    assert [x for _, _, x, _ in back] == [t if r == "assistant" else "" for r, t in turns]
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (None, None, None, None), (2, 0, "assistant", "<|"), (1, 1, "assistant", "a")]
    got = {r.conv_id: r for r in digests(format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), path), path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\na\nassistant\na\nassistant\nb\n") and got[1].loss_sha256 == sha("aab") and got[1].n_turns == 4
    assert got[None].turns_sha256 == sha("\n\n") and got[2].loss_chars == 2
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digests(format_turns(none, path), path).count() == 0


def test_pieces(table, empty):
    import sentencepiece

    from loomtext.llm.pieces import PieceModel, encode_documents

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    model = PieceModel(open(path, "rb").read(), max_words=50, max_pairs=50)
    rng = random.Random(2)
    texts = ["".join(rng.choice(" abcdeinrst▁éß日\n\t🎉<>0xs/") for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["▁▁ x", "<s></s><0x0A>", "ab" * 900, "  ", "\x00"]
    for t in texts:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(model.encode(t), "<u4").tolist() == ids
        assert model.decode(model.encode(t)) == sp.decode(ids)
    for _ in range(300):
        ids = [rng.randrange(0, 400) if rng.random() < 0.7 else rng.randrange(32000) for _ in range(rng.randint(0, 9))]
        assert model.decode(np.array(ids, "<u4")) == sp.decode(ids)
    rows, df = table
    got = order((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in encode_documents(df, path).collect())
    assert got == order((d, sp.encode(t or "", add_bos=True, add_eos=True), sp.decode(sp.encode(t or "", add_bos=True, add_eos=True))) for d, t in rows)
    assert encode_documents(empty, path).count() == 0


def test_exact_dedup(table, empty, spark):
    from pyspark.sql import functions as F

    from loomtext.llm.exact_dedup import dedup_stage, exact_dedup

    rows, df = table
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)  # noqa: E731  so that texts clash
    for digest in (None, weak):
        out = exact_dedup(df) if digest is None else exact_dedup(df, digest=digest)
        got = out.collect()
        assert order((r.doc_id, r.keep_id, r.group_size) for r in got) == order((d, best[t or ""], len(groups[t or ""])) for d, t in rows)
        assert sum(r.kept for r in got) == len(groups)
    assert {r.text_sha256 for r in exact_dedup(df).collect()} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    stage = dedup_stage(df)
    assert stage.columns == df.columns and order((r.doc_id, r.text or "") for r in stage.collect()) == order((d, t) for t, d in best.items())
    assert exact_dedup(empty).count() == 0 and dedup_stage(empty).count() == 0


def test_exact_dedup_goes_on(spark, tmp_path):
    """A stream that is continued with new files updates its entries."""
    from loomtext.llm.exact_dedup import keyed_state

    schema = "digest string, doc_id long, file string, row long"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: {r.digest: (r.keep_id, r.group_size) for r in keyed_state(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck")).collect()}
    add([("a", 1, "f", 0), ("b", 5, "f", 1)])
    assert read() == {"a": (1, 1), "b": (5, 1)}
    add([("a", 9, "g", 0), ("c", None, "g", 1)])
    assert read() == {"a": (9, 2), "b": (5, 1), "c": (None, 1)}


@pytest.mark.parametrize("t,k", [(85, 4), (80, 5)])
def test_alike(t, k, table, empty, spark):
    from loomtext.llm.jaccard_join import alike

    rows, df = table
    got = order(map(tuple, alike(df, t, k).collect()))
    assert got == order(brute.alike(rows, t, k))
    assert alike(empty).count() == 0


def test_alike_many_near_copies(spark, monkeypatch):
    from loomtext.llm import jaccard_join as J

    monkeypatch.setattr(J, "FEW_LINKS", 10)  # as for more links than one task may hold
    monkeypatch.setattr(J, "HELD", 60)
    rng = random.Random(3)
    base = [f"h{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = order(map(tuple, J.alike(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == order(brute.alike(rows))


def test_boundary_takes_the_cheaper_side():
    from loomtext.llm.jaccard_join import boundary, needed, subset_sizes

    assert boundary({}, 85) >= 0 and needed(100, 100, 85) == 92
    assert all(100 * c >= 85 * (a + b - c) for n in range(1, 20) for a, b, c in subset_sizes(n, 20, 85))


def test_near_dedup_stage(table):
    from loomtext.llm.jaccard_join import near_dedup_stage

    rows, df = table
    want = order((d, t) for (d, t), (_, _, c) in zip(rows, brute.alike(rows, 80, 5), strict=True) if d is None or c == d or c is None)
    out = near_dedup_stage(df)
    assert out.columns == df.columns and order((r.doc_id, r.text) for r in out.collect()) == want


def test_similar_examples_are_exact(spark):
    from loomtext.llm.toxicity import Examples, Vocabulary

    rng = np.random.default_rng(1)
    vocab = Vocabulary(rng.integers(1, 2**63, 40, dtype=np.uint64))
    index = Examples(vocab, rng.uniform(1, 5, 40))
    examples = []
    for i in range(500):
        t = np.unique(rng.integers(0, 40, rng.integers(1, 6)))
        examples.append((i, int(rng.random() < 0.3), t, rng.integers(1, 4, len(t))))
    index.build(examples)
    dense = np.zeros((500, 40))
    place = {int(d): i for i, d in enumerate(index.ids)}
    for i, _, t, c in examples:
        dense[place[i], t] = index.vectors(t, c)
    for i, _, t, c in examples[:60]:
        near, cosine = index.nearest(t, index.vectors(t, c))
        full = dense @ dense[place[i]]
        top = np.lexsort((np.arange(500), -np.round(full, 12)))[: len(near)]
        assert near.tolist() == top.tolist() and np.allclose(cosine, full[near])


@pytest.mark.parametrize("name,label", [("op2_quality", "quality"), ("op7_toxicity", "toxic")])
def test_held_out_accuracy(name, label, spark):
    from loomtext.llm.queries import queries

    d = "/root/testdata/sf0.01"
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in queries()[name](spark, d).collect() if r.held_out and r.doc_id in known]
    assert len(got) > 50 and np.mean([r.predicted == known[r.doc_id] for r in got]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_classifiers_on_awkward_tables(table, empty, spark):
    from loomtext.llm.quality import quality_scores, quality_stage
    from loomtext.llm.toxicity import toxicity

    rows, df = table
    labels = spark.createDataFrame([(d, int(d % 2), int(d % 5 == 0)) for d, _ in rows if d is not None] + [(None, 1, 1), (4, None, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        for f in (quality_scores, toxicity):
            got = f(df, some).collect()
            assert order(r.doc_id for r in got) == order(d for d, _ in rows) and all(0 <= r.score <= 1 for r in got)
            assert f(empty, some).count() == 0
    assert quality_stage(df, labels).columns == df.columns
    assert quality_stage(empty, labels).count() == 0
