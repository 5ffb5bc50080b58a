"""Registered queries: those with SQL against it, the pipeline against its plain version."""

import brute
import pytest

from loomtext.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(name, spark, sf, duck, same):
    same(Q.queries()[name](spark, sf), duck.sql(Q.oracle_sql()[name]))


def test_contract_columns(spark, sf):
    want = {
        "op1_katz": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op5_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op8_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op10_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    }
    for name, columns in want.items():
        assert Q.queries()[name](spark, sf).columns[: len(columns)] == columns


def test_pipeline(spark, sf):
    """Every stage's decisions, on what the stage before it kept."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    steps = []
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        steps.append((name, docs, out))
        if i < len(P.STAGES) - 1:
            assert out.columns == names
            docs = P.cut(out, f"{P.shared_dir(spark)}/{name}")
            steps[-1] = (name, steps[-1][1], docs)
    good, unique, apart, clean, tokens = ({"in": rows(a), "out": b} for _, a, b in steps)
    assert 0.5 * len(good["in"]) < good["out"].count() <= len(good["in"])
    best = {}
    for d, t in unique["in"].items():
        best[t] = max(best.get(t, -1), d)
    assert rows(unique["out"]) == {d: t for t, d in best.items()}
    groups = brute.alike(list(apart["in"].items()), 80, 5)
    assert set(rows(apart["out"])) == {d for d, _, c in groups if c == d}
    leaks = {d for d, _ in brute.similar_windows(list(clean["in"].items()), bench)}
    assert set(rows(clean["out"])) == set(clean["in"]) - leaks
    assert {r.doc_id for r in tokens["out"].collect()} == set(tokens["in"])
