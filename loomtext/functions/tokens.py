"""Token counters, the recursive splitter and heading paths: plain Python that runs inside Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache


#: Counts of texts up to so many characters are kept, so many of them (some 100 bytes each).
SHORT, KEPT = 40, 200_000


@lru_cache(maxsize=4)
def counter(mode: str = "words", path: str = "") -> Callable[[str], int]:
    """words: runs of non-space; bpe: ids of a rank file, loaded once in each worker."""
    if mode == "words":
        return lambda s: len(s.split())
    if mode != "bpe":
        raise ValueError(f"unknown token mode: {mode}")
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, int] = {}

    def count(s: str) -> int:
        """Short texts, which are mostly single words with their blank, are counted once and kept."""
        if len(s) > SHORT:
            return len(enc.encode_ordinary(s))
        n = known.get(s)
        if n is None:
            if len(known) >= KEPT:
                known.clear()
            n = known[s] = len(enc.encode_ordinary(s))
        return n

    return count


SEPARATORS = ("\n\n", "\n", " ", "")


def _parts(text: str, sep: str) -> list[str]:
    if not sep:
        return list(text)
    first, *rest = text.split(sep)
    return [p for p in [first, *(sep + r for r in rest)] if p]


def split(text: str, size: int, overlap: int, count: Callable[[str], int], separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most about `size` tokens that share up to `overlap`, cut at the coarsest separator that occurs."""
    k = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer, out, fitting = separators[k + 1 :], [], []
    for part in _parts(text, separators[k]):
        n = count(part)
        if n < size:
            fitting.append((part, n))
            continue
        out += _packed(fitting, size, overlap)
        fitting = []
        out += split(part, size, overlap, count, finer) if finer else [part]
    return out + _packed(fitting, size, overlap)


def _packed(parts: list[tuple[str, int]], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    lo, total = 0, 0  # parts[lo:i] are in the open piece
    for i, (_, n) in enumerate(parts):
        if total + n > size and i > lo:
            if piece := "".join(p for p, _ in parts[lo:i]).strip():
                out.append(piece)
            while total > overlap or total + n > size and total > 0:
                total -= parts[lo][1]
                lo += 1
        total += n
    if piece := "".join(p for p, _ in parts[lo:]).strip():
        out.append(piece)
    return out


def offsets(text: str, pieces: list[str]) -> list[int]:
    """Where each piece begins: searched from just after the last one's start, then from the top, else there."""
    out, cursor = [], 0
    for p in pieces:
        at = text.find(p, cursor)
        if at < 0:
            at = text.find(p)
        if at < 0:
            at = cursor
        out.append(at)
        cursor = max(cursor, at + 1)
    return out


def heading_paths(text: str, headings: list[dict], starts: list[int]) -> list[list[dict]]:
    """For each start the headings in force, by rising level; a heading ends those of its and deeper levels before it.

    One sweep over headings and starts by place, with the path as a stack.
    """
    placed, cursor = [], 0
    for h in headings:
        at = text.find(h["text"], cursor)
        if at < 0:
            at = text.find(h["text"])
        if at >= 0:
            placed.append((at, h["level"], h["text"]))
            cursor = max(cursor, at + len(h["text"]))
    placed.sort(key=lambda x: x[0])
    out: list[list[dict]] = [[] for _ in starts]
    path: list[dict] = []
    i = 0
    for k in sorted(range(len(starts)), key=starts.__getitem__):
        while i < len(placed) and placed[i][0] <= starts[k]:
            _, level, said = placed[i]
            while path and path[-1]["level"] >= level:
                path.pop()
            path.append({"level": level, "text": said})
            i += 1
        out[k] = list(path)
    return out
