"""Chat formatting by token-level assembly.

Each turn becomes START role-segment content-segment END newline. Role and content are encoded separately and the
reserved ids, which no text can encode to, are spliced between them, so a border never falls inside a token. The loss
mask is the running sum of +1 where an assistant's content begins and -1 where it ends. Control strings in a text are
escaped: "<", any number of backslashes and "|" get one backslash more, which unescaping takes away again. In a role,
backslashes and newlines are escaped too, because a newline ends it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoding, read_ranks
from .runtime import arrow_batches, partitions, released

START, END = "<|im_start|>", "<|im_end|>"
_GUARD, _GUARDED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _GUARD.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _GUARDED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(turns: list[tuple[str, str]], enc, start: int, end: int, trained: str = "assistant") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and loss mask of all turns, one after another, and the turns' borders in them."""
    newline = enc.encode_ordinary("\n")
    flat: list[int] = []
    marks: list[tuple[int, int]] = []
    borders = [0]
    for role, text in turns:
        flat.append(start)
        flat += enc.encode_ordinary(escape_role(role) + "\n")
        a = len(flat)
        flat += enc.encode_ordinary(escape(text))
        if role == trained:
            marks.append((a, len(flat)))
        flat.append(end)
        flat += newline
        borders.append(len(flat))
    steps = np.zeros(len(flat) + 1, np.int32)
    for a, b in marks:
        steps[a] += 1
        steps[b] -= 1
    return np.array(flat, "<u4"), np.cumsum(steps)[:-1].astype(np.uint8), np.array(borders)


def read_back(ids: np.ndarray, mask: np.ndarray, enc, start: int, end: int) -> Iterator[tuple[str, str, str, int]]:
    """Of each formatted turn: role, text, the text under the loss mask, characters of the formatted turn."""
    for a in np.flatnonzero(ids == start):
        b = a + int(np.flatnonzero(ids[a:] == end)[0])
        stop = b + 1
        while stop < len(ids) and ids[stop] != start:
            stop += 1
        shown = enc.decode_bytes(ids[a + 1 : b].tolist()).decode()
        role, _, text = shown.partition("\n")
        learnt = unescape(enc.decode_bytes(ids[a:stop][mask[a:stop] == 1].tolist()).decode())
        size = len(START) + len(shown) + len(END) + len(enc.decode_bytes(ids[b + 1 : stop].tolist()).decode())
        yield unescape_role(role), unescape(text), learnt, size


def format_turns(conversations: DataFrame, ranks_path: str) -> DataFrame:
    """(conv_id, turn, role, text, ids binary, mask binary): each row's formatted turn; u32 little-endian ids, u8 mask.

    Null roles and texts are empty; other columns are ignored. Rows stay where they are: no shuffle. The ids from the
    rank file's size on are reserved: that number itself for end of text, the next two for START and END.
    """
    ranks, n = read_ranks(ranks_path)
    arrow_batches(conversations.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for b in batches:
            ids, mask, at = assemble(list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)), enc, n + 1, n + 2)
            cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, cut(ids), cut(mask)], ["conv_id", "turn", "role", "text", "ids", "mask"])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary, mask binary")


def digests(formatted: DataFrame, ranks_path: str) -> DataFrame:
    """Per conversation, read back from the formatted turns: the number of turns and digests of texts and loss texts.

    Turns go by (turn, role, text), nulls first, so ties and repeated rows have one order. A digest is sequential in
    a conversation's turns, which therefore meet in one task, but they pass through it one by one: what is held is one
    turn and two hash states. A null conv_id is a conversation of its own.
    """
    spark = formatted.sparkSession
    ranks, n = read_ranks(ranks_path)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state, done = None, []

        def close() -> None:
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
            done.clear()
            return batch

        for b in batches:
            for conv, ids, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, learnt, size in read_back(np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8), enc, n + 1, n + 2):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                    state[5] += size
            if len(done) > 1000:
                yield out()
        close()
        yield out()

    ordered = formatted.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "mask")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
