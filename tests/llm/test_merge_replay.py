"""op12 against the library; ranks in any order; texts cut into parts and blocks."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from loomtext.llm import merge_replay as M
from loomtext.llm import queries as Q

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return M.ranks_of(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def test_query(spark, sf, library):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d, t in docs:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    assert sorted(map(tuple, Q.op12_byte_bpe(spark, sf).collect())) == sorted(want)


def encoded(ranks, texts):
    block = M.Block(ranks)
    for i, t in enumerate(texts):
        block.add(i, t)
    return [np.frombuffer(x, "<u4").tolist() for b in block.give() for x in b.column(1).to_pylist()]


def test_any_character(ranks, library):
    text = "".join(f"x{chr(c)}{chr(c)} {chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 97 == 0))
    texts = [text[i : i + 5000] for i in range(0, len(text), 5000)] + ["", " ", "\n\n  a", "aaaaaaa", "<|endoftext|>", "a" * 3001, "'s've'LL", "\0" * 50]
    got = encoded(ranks, texts)
    assert got == library.encode_ordinary_batch(texts)
    assert [ranks.decode(np.array(g, "<u4")) for g in got] == [t.encode() for t in texts]


def test_small_blocks_and_parts(ranks, library, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 50)
    monkeypatch.setattr(M, "BLOCK_CHARS", 3000)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word", " ", "  ", "\n", "don't", "é", "12", "…", "zqx", "_" * 9]) for _ in range(rng.randrange(600))) for _ in range(40)]
    assert encoded(ranks, texts) == library.encode_ordinary_batch(texts)
    pattern = regex.compile(P.PATTERN)
    for part in (1, 2, 5, 17):
        for t in texts[:12]:
            assert [m for got in M.matches(pattern, t, part) for m in got] == pattern.findall(t)


def test_ranks_in_any_order():
    """Ranks that no training gives: merges make pairs of lower ranks, and places overlap."""
    rng = random.Random(11)
    for _ in range(150):
        tokens = {bytes([i]) for i in range(256)}
        while len(tokens) < 256 + 25:
            tokens.add(bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))))
        order = sorted(tokens)
        rng.shuffle(order)
        file = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(order))
        ranks = M.Ranks(file)
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(40)]
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
        assert encoded(ranks, words) == [library.encode_ordinary(w) for w in words]


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "a b", 3), (2, "a b", 4), (2, "a b", 5)], "doc_id int, text string, ids int")
    got = M.encode_documents(df, PATH).collect()
    assert sorted(((r.doc_id, len(r.ids), bytes(r.decoded)) for r in got), key=repr) == sorted([(1, 0, b""), (1, 0, b""), (None, 8, b"a b"), (2, 8, b"a b"), (2, 8, b"a b")], key=repr)
    assert M.encode_documents(df.limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        M.Ranks(base64.b64encode(b"a") + b" 0")
