"""A byte-level BPE encoding built from a rank file, once in each worker process."""

from __future__ import annotations

import base64
import hashlib

_encodings: dict[str, object] = {}


def encoding(ranks_file: bytes):
    """A tiktoken Encoding without special tokens: any string in a text is ordinary text."""
    key = hashlib.sha256(ranks_file).hexdigest()
    if key not in _encodings:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def read_ranks(path: str) -> tuple[bytes, int]:
    """The file's bytes, which travel with the tasks, and the number of its ids."""
    with open(path, "rb") as f:
        data = f.read()
    return data, sum(1 for x in data.splitlines() if x.strip())
