"""Small results are written to few files, however many partitions a shuffle has."""

import random

from loomtext.llm import jaccard_join
from loomtext.session import cut


def test_few_rows_share_files(spark, tmp_path):
    df = spark.range(25_000).repartition(40)
    cut(df, str(tmp_path / "all"))
    assert cut(df, str(tmp_path / "few"), 25_000).count() == 25_000
    assert len(list((tmp_path / "all").glob("part-*"))) == 40
    assert len(list((tmp_path / "few").glob("part-*"))) == 3


def test_near_duplicates_write_few_files(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = []
    for g in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(4 * g + c, " ".join([*words[: 60 - c], *[f"x{g}"] * c])) for c in range(4)]
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(jaccard_join, "shared_dir", lambda _: str(tmp_path / "cuts"))
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        kept = sorted(r.doc_id for r in jaccard_join.near_dedup_stage(docs).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert kept == [4 * g for g in range(300)]
    assert len(list((tmp_path / "cuts").rglob("part-*"))) < 4 * 48
