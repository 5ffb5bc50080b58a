"""Byte-level BPE encoding and decoding: merge replay over all distinct words of a block of documents.

A task cuts its texts by the pattern, numbers the distinct matches ("words") of a block, and spells those that are no
token themselves as bytes, one behind the other. An inverted index maps each token pair, by the rank of what it merges
to, to the places where it stands. All merges are applied in rank order, each at all its places at once; only the pairs
with the touched neighbours are looked up anew and added to the index. The ids of a document are those of its words.

Why this equals merging each word by itself, lowest rank first and the leftmost of equals: words don't touch, so only
the order within a word counts. Ranks rise; places of one rank that overlap (as in "aaa") are taken alternately from the
left. Where a merge makes a pair of a lower rank than its own, which ranks from training don't but any file may, the
word is set aside and merged alone, step by step.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .runtime import arrow_batches, released, text_rows

#: A block ends at so many characters of text or distinct words, whatever comes first. Neither changes a result.
BLOCK_CHARS, BLOCK_WORDS = 32 << 20, 400_000
#: Characters cut into matches at once, and of finished documents given out at once.
PART_CHARS, OUT_CHARS = 1 << 20, 2 << 20
#: No alternative of the pattern looks further than this many characters beyond its end.
LOOK_AHEAD = 4


class Ranks:
    """A rank file's tokens, and the pairs that merge to each of them."""

    def __init__(self, ranks_file: bytes):
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        if len({bytes([i]) for i in range(256)} - rank.keys()) or len(set(rank.values())) < len(rank):
            raise ValueError("a rank file has all 256 bytes, and each rank once")
        self.rank = rank
        self.token = [b""] * (1 + max(rank.values()))
        for t, r in rank.items():
            self.token[r] = t
        self.size = len(self.token)
        self.bytes = np.array([rank[bytes([i])] for i in range(256)], np.int64)
        made = [(rank[t[:i]] * (self.size + 1) + rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
        made.sort()
        self.keys = np.array([k for k, _ in made] or [-1], np.int64)
        self.made = np.array([r for _, r in made] or [-1], np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        """The rank of each two tokens together; -1 for none. Token number `size` stands between words."""
        k = a * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.made[at], -1)

    def alone(self, word: bytes) -> list[int]:
        """The definition: merge the leftmost of the lowest pairs until there is none."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            r, i = min((self.rank.get(parts[i] + parts[i + 1], self.size), i) for i in range(len(parts) - 1))
            if r == self.size:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids[first[i]:first[i + 1]] are those of word i."""
        own = np.fromiter((self.rank.get(w, -1) for w in words), np.int64, len(words))
        rest = np.flatnonzero(own < 0)
        ids, counts = self.replay([words[i] for i in rest.tolist()])
        n = np.ones(len(words), np.int64)
        n[rest] = counts
        first = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(int(first[-1]), np.int64)
        single = np.ones(len(out), bool)
        single[spans(first[rest], counts)] = False
        out[~single], out[single] = ids, own[own >= 0]
        return out.astype("<u4"), first

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one behind the other, and their number in each."""
        none = self.size
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        heads = np.concatenate([[0], np.cumsum(lengths + 1)])  # each word's separator
        total = int(heads[-1]) + 1
        token = np.full(total, none, np.int64)
        inner = np.ones(total, bool)
        inner[heads] = False
        token[inner] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        pair = np.append(self.merged(token[:-1], token[1:]), -1)
        # The index: the places of each rank from the start, by one sort; later ones in lists.
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        edges = np.searchsorted(pair[at], np.arange(self.size + 1)).tolist()
        more: dict[int, list[np.ndarray]] = {}
        waiting = bytearray(self.size)
        for r in np.unique(pair[at]).tolist():
            waiting[r] = 1
        aside: set[int] = set()

        def set_aside(places: np.ndarray) -> None:
            aside.update((np.searchsorted(heads, places, "right") - 1).tolist())

        r = waiting.find(1)
        while r >= 0:
            x = at[edges[r] : edges[r + 1]]
            if r in more:
                x = np.unique(np.concatenate([x, *more.pop(r)]))
            x = x[pair[x] == r]
            y = after[x]
            if len(x) > 1 and (y[:-1] == x[1:]).any():
                x = _alternate(x, y)
                y = after[x]
            if len(x):
                z, w = after[y], before[x]
                if len(x) > 1 and (touching := z[:-1] == x[1:]).any():  # the right neighbour, before it merges as well
                    mid = self.merged(np.full(int(touching.sum()), r), token[x[1:][touching]])
                    if (low := (mid >= 0) & (mid < r)).any():
                        set_aside(x[:-1][touching][low])
                token[x], token[y] = r, -1
                pair[y] = -1
                after[x], before[z] = z, x
                one = np.full(len(x), r)
                found = self.merged(np.concatenate([token[w], one]), np.concatenate([one, token[z]]))
                pair[w], pair[x] = found[: len(x)], found[len(x) :]
                keep = found >= 0
                found, places = found[keep], np.concatenate([w, x])[keep]
                if len(found):
                    order = np.argsort(found, kind="stable")
                    found, places = found[order], places[order]
                    if found[0] < r:
                        set_aside(places[found < r])
                    cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(found)]
                    for i, f in enumerate(found[cuts[:-1]].tolist()):
                        waiting[f] = 1
                        more.setdefault(f, []).append(places[cuts[i] : cuts[i + 1]])
            r = waiting.find(1, r + 1)
        live = (token >= 0) & (token < none)
        counts = np.add.reduceat(live, heads[:-1]) if len(words) else np.zeros(0, np.int64)
        ids = token[live]
        if aside:
            first = np.concatenate([[0], np.cumsum(counts)])
            parts = [np.array(self.alone(words[i]), np.int64) if i in aside else ids[first[i] : first[i + 1]] for i in range(len(words))]
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, counts.astype(np.int64)

    def decode(self, ids: np.ndarray | bytes) -> bytes:
        """The bytes of ids."""
        listed = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        return b"".join(map(self.token.__getitem__, listed.tolist()))


def _alternate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of places whose pairs overlap in a run, the first, the third and so on."""
    new = np.concatenate([[True], y[:-1] != x[1:]])
    starts = np.flatnonzero(new)
    return x[(np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))) % 2 == 0]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. (lengths[0] of them), starts[1], .."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def matches(pattern: regex.Pattern, text: str, part: int = PART_CHARS) -> Iterator[list[str]]:
    """The pattern's matches, part by part. A match that ends well before the part's end is the same in the whole text."""
    at, n, size = 0, len(text), part
    while at < n:
        end = min(n, at + size)
        got = pattern.findall(text, at, end)
        if end < n:
            last = at + sum(map(len, got))
            while got and last > end - LOOK_AHEAD:
                last -= len(got.pop())
            if not got:  # one match longer than the part
                size *= 2
                continue
            at, size = last, part
        else:
            at = n
        yield got


class _Numbers(dict):
    """A word's number in the block; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Block:
    """Texts cut into words of one table, until they are resolved to ids."""

    def __init__(self, ranks: Ranks):
        self.ranks, self.pattern = ranks, regex.compile(public_tokenizers.PATTERN)
        self.done: list[list] = []  # (doc_id, arrays of ids)
        self.clear()

    def clear(self) -> None:
        self.numbers, self.pieces, self.owners, self.chars = _Numbers(), [], [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        self.done.append([doc_id, []])
        for got in matches(self.pattern, text):
            self.pieces.append(np.fromiter(map(self.numbers.__getitem__, got), np.int32, len(got)))
            self.owners.append(self.done[-1][1])
            self.chars += min(len(text), PART_CHARS)
            if self.full():
                self.resolve()

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.numbers) >= BLOCK_WORDS

    def resolve(self) -> None:
        ids, first = self.ranks.encode_words([w.encode() for w in self.numbers])
        counts = np.diff(first)
        for own, piece in zip(self.owners, self.pieces, strict=True):
            own.append(ids[spans(first[piece], counts[piece])])
        self.clear()

    def give(self) -> Iterator[pa.RecordBatch]:
        """All documents that were added, resolved."""
        self.resolve()
        held: list[tuple] = []
        size = 0
        for doc_id, parts in self.done:
            ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
            held.append((doc_id, ids.tobytes(), self.ranks.decode(ids)))
            size += len(held[-1][2])
            if size >= OUT_CHARS:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)
        self.done = []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, codes, texts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.binary()), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])


_known: dict[str, Ranks] = {}


def ranks_of(ranks_file: bytes) -> Ranks:
    """One for each worker process and file."""
    key = hashlib.sha256(ranks_file).hexdigest()
    if key not in _known:
        _known[key] = Ranks(ranks_file)
    return _known[key]


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded binary): every whole text encoded, ids as little-endian unsigned 32-bit integers, and
    decoded again. No shuffle: a task holds a block of its own documents as numbers of words.

    A null or empty text has no ids. Repeated rows and null ids give one row each; an empty table gives none; columns
    other than the two are ignored. Texts of any length pass in parts, so the table of words stays bounded. Special
    tokens are ordinary text. The rank file's bytes travel with the tasks (about 0.8 MB).
    """
    with open(ranks_path, "rb") as f:
        ranks_file = f.read()
    arrow_batches(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(ranks_of(ranks_file))
        held = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                block.add(doc_id, text)
                held += len(text) + 64
                if held >= BLOCK_CHARS or block.full():
                    yield from block.give()
                    held = 0
        yield from block.give()

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded binary")
