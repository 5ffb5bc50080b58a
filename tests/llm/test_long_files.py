"""Flat token files beyond 2 GB, and awkward ones, read by byte ranges."""

import numpy as np
from loomtext.llm.token_counts import count_tokens, file_blocks

EOD = 7


def test_a_file_beyond_2_gb(spark, tmp_path):
    ends, size = [0, 5, (1 << 20) - 1, 1 << 20, (1 << 30) + 12_345], (1 << 30) + 50_000
    with open(tmp_path / "long.bin", "wb") as f:  # holes read as the id 0
        for e in ends:
            f.seek(2 * e)
            f.write(np.array([EOD], "<u2").tobytes())
        f.truncate(2 * size)
    got = sorted((r.position, r.start, r.n_tokens, r.ended) for r in count_tokens(file_blocks(spark, f"{tmp_path}/long.bin"), EOD).collect())
    starts = [0, *(e + 1 for e in ends)]
    assert got == [(i, a, b - a, b != size) for i, (a, b) in enumerate(zip(starts, [*ends, size], strict=True))]


def test_awkward_files(spark, tmp_path):
    for name, ids, extra in (("none", [], b""), ("byte", [], b"x"), ("odd", [1, EOD, 2], b"x"), ("a b", [EOD, EOD], b"")):
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes() + extra)
    got = sorted((r.start, r.n_tokens, r.ended) for r in count_tokens(file_blocks(spark, f"{tmp_path}/*.bin", 2), EOD).collect())
    assert got == [(0, 0, True), (0, 1, True), (1, 0, True), (2, 1, False)]
