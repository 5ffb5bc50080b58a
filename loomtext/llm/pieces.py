"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A merge-type model joins adjacent symbols, best score first, leftmost first among equals. A sequence of pieces is
the result for a text exactly if each two neighbours, joined and merged anew, fall apart into the same two pieces:
up to the first merge across a border, what lies between borders evolves as it would alone. So the encoder tries the
longest piece (all matches come from one Aho-Corasick pass), checks it against the piece before it by merging the
two anew (kept in a table), falls back to shorter pieces, and steps back where none fits; a bitfield of positions
that failed keeps it from trying one twice. No piece of such a model holds a space mark after another character
(checked when the model is loaded), so the result for a text is that of its words, and words are kept in a table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import arrow_batches, released, text_rows

MARK = "▁"


class PieceModel:
    """Encoder and decoder for the bytes of a merge-type .model file with identity normalisation.

    max_words, max_pairs: entries of the two tables, some 230 bytes each; a full one starts anew (of the words, one full
    table is kept besides), so memory is bounded.
    """

    def __init__(self, proto: bytes, max_words: int = 150_000, max_pairs: int = 200_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(proto)
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only merge-type models with identity normalisation are supported")
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.prefix = " " if spec.add_dummy_prefix else ""
        self.text = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.bos, self.eos = (next((i for i, p in enumerate(model.pieces) if p.piece == x), None) for x in ("<s>", "</s>"))
        self.byte_ids = np.zeros(len(self.text), bool)
        self.byte_ids[list(self.bytes.values())] = True
        shown = {2: lambda p: " ⁇ ".encode(), 3: lambda p: b"", 6: lambda p: bytes([int(p.piece[3:-1], 16)])}
        self.shown = [shown.get(p.type, lambda p: p.piece.replace(MARK, " ").encode())(p) for p in model.pieces]
        self.control = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for piece in self.ids:
            if len(piece) > 1:
                self.automaton.add_word(piece)
        self.automaton.make_automaton()
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.split = (lambda s: [s]) if inner else re.compile(" *[^ ]+| +").findall
        self.max_words, self.max_pairs = max_words, max_pairs
        self.id_bytes = {p: np.array([i], "<u4").tobytes() for p, i in self.ids.items()}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def forget(self) -> None:
        """Empty the tables."""
        self.words, self.older, self.pairs = {}, {}, {}

    def merge(self, s: str) -> list[str]:
        """The definition, step by step: join the best adjacent pair until none is a piece."""
        sym, left, right = list(s), list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(sym) and (x := sym[a] + sym[b]) in self.score:
                heapq.heappush(heap, (-self.score[x], a, b, x))

        for i in range(len(s) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, x = heapq.heappop(heap)
            if not sym[a] or not sym[b] or sym[a] + sym[b] != x or right[a] != b:
                continue
            sym[a], sym[b] = x, ""
            right[a] = right[b]
            if right[b] < len(sym):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [x for x in sym if x]

    def fits(self, a: str, b: str) -> bool:
        """Whether b can follow a (a may be empty): merging both anew gives both back."""
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            got = self.pairs[key] = self.merge(a + b) == ([a, b] if a else [b])
        return got

    def encode_word(self, s: str) -> list[str]:
        """The pieces of a word, whose spaces are written as space marks."""
        n = len(s)
        at = [[1] for _ in range(n)]  # a character may always stand alone; longer matches come in rising order
        for end, length in self.automaton.iter(s):
            at[end + 1 - length].append(length)
        failed = bytearray(n + 1)
        out: list[str] = []
        tried: list[int] = []
        pairs, fits = self.pairs, self.fits
        pos, k, last, found = 0, len(at[0]) - 1, "", at[0]
        while True:
            while k >= 0:
                end = pos + found[k]
                if not failed[end]:
                    piece = s[pos:end]
                    ok = pairs.get((last, piece))
                    if ok or ok is None and fits(last, piece):
                        break
                k -= 1
            if k >= 0:
                out.append(piece)
                if end == n:
                    return out
                tried.append(k)
                pos, last, found = end, piece, at[end]
                k = len(found) - 1
            else:
                failed[pos] = 1
                pos -= len(out.pop())
                last = out[-1] if out else ""
                found, k = at[pos], tried.pop() - 1

    def word_ids(self, s: str) -> bytes:
        pieces = self.encode_word(s.replace(" ", MARK))
        try:
            return b"".join([self.id_bytes[p] for p in pieces])
        except KeyError:
            return b"".join([self.id_bytes.get(p) or self.spelled(p) for p in pieces])

    def spelled(self, character: str) -> bytes:
        """The ids of a character that is no piece: its bytes, or the unknown id in a model without bytes."""
        return np.array([self.bytes[b] for b in character.encode()] if self.bytes else [self.unk], "<u4").tobytes()

    def encode(self, text: str, ends: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; ends: with the begin and end ids."""
        parts = []
        get = self.words.get
        for w in self.split((self.prefix + text).replace(MARK, " ")) if text else ():
            ids = get(w)
            if ids is None:
                ids = self.older.get(w) or self.word_ids(w)
                if len(w) <= 64:
                    if len(self.words) >= self.max_words:
                        self.words, self.older = {}, self.words
                        get = self.words.get
                    self.words[w] = ids
            parts.append(ids)
        body = b"".join(parts)
        return np.array([self.bos], "<u4").tobytes() + body + np.array([self.eos], "<u4").tobytes() if ends else body

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text of ids, as the library gives it: each byte that is not part of a character becomes U+FFFD."""
        a = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids, np.int64)
        listed = a.tolist()
        try:  # bytes of a whole character are contiguous, and a piece never begins within one
            text = b"".join(map(self.shown.__getitem__, listed)).decode()
        except UnicodeDecodeError:
            cuts = np.flatnonzero(np.diff(self.byte_ids[a].astype(np.int8))) + 1
            text = "".join(_characters(b"".join(map(self.shown.__getitem__, part.tolist()))) for part in np.split(a, cuts))
        first = next((i for i in listed if i not in self.control), None)
        return text[1:] if self.prefix and first is not None and self.text[first].startswith(MARK) else text


def _characters(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                except UnicodeDecodeError:
                    continue
                i += n
                break
            else:
                out.append("�")
                i += 1
        return "".join(out)


_models: dict[str, PieceModel] = {}


def piece_model(proto: bytes) -> PieceModel:
    """One model for each worker process and model file."""
    key = hashlib.sha256(proto).hexdigest()
    if key not in _models:
        _models[key] = PieceModel(proto)
    return _models[key]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded): every text encoded with begin and end ids, and decoded again. No shuffle.

    A null or empty text has only the two end ids and decodes to the empty text. Repeated rows and null ids give
    one row each; columns other than the two are ignored. The model's bytes travel with the tasks (about 0.5 MB).
    """
    with open(model_path, "rb") as f:
        proto = f.read()
    arrow_batches(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(proto)
        for b in batches:
            ids = [model.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([model.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])
        model.forget()  # a reused worker has its memory for other tasks

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")
