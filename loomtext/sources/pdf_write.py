"""Texts and tables as PDFs: a sink for extracted documents, and what the readers are tried on.

Every character is a two-byte code with a ToUnicode map, so any text can be written. Version 1.4 has a cross-reference
table, 1.5 object streams and a cross-reference stream with a predictor. Objects lie in the file in reverse order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import BATCH_BYTES, arrow_batches

#: Points: line height, size of type, lines of a page, words of a line.
LEADING, SIZE, LINES, WORDS = 14, 10, 50, 12


class _Codes(dict):
    """Character number to a character that stands for its code; codes of surrogates are passed over."""

    def __missing__(self, c: int) -> str:
        n = len(self) + 1
        self[c] = got = chr(n if n < 0xD800 else n + 0x800)
        return got

    def listed(self) -> list[tuple[int, str]]:
        return [(ord(code), chr(c)) for c, code in self.items()]


def _hex(text: str, codes: _Codes) -> bytes:
    return b"<" + text.translate(codes).encode("utf-16-be").hex().encode() + b">"


def write_pdf(pages: list[bytes], codes: _Codes, title: str, version: str = "1.4", tree: bool = True) -> bytes:
    """A file of pages' contents; tree: False leaves the page tree out and the cross references wrong, as damage does."""
    n = len(pages)
    shown = [b"<%04x> <%s>" % (i, c.encode("utf-16-be").hex().encode()) for i, c in codes.listed()]
    maps = b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(part), b"\n".join(part)) for part in (shown[a : a + 100] for a in range(0, len(shown), 100)))
    to_unicode = b"/CIDInit /ProcSet findresource begin\n1 begincodespacerange <0000> <ffff> endcodespacerange\n" + maps + b"end"
    plain = {
        1: b"<</Type /Catalog" + (b" /Pages 2 0 R" if tree else b"") + b">>",
        2: b"<</Type /Pages /Count %d /Resources <</Font <</F 4 0 R>>>> /Kids [%s]>>" % (n, b" ".join(b"%d 0 R" % (7 + 2 * i) for i in range(n))),
        3: b"<</Title <feff%s>>>" % title.encode("utf-16-be").hex().encode(),
        4: b"<</Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 6 0 R /DescendantFonts [5 0 R]>>",
        5: b"<</Type /Font /Subtype /CIDFontType2 /DW 500>>",
    }
    streams = {6: to_unicode}
    for i, content in enumerate(pages):
        plain[7 + 2 * i] = b"<</Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R>>" % (8 + 2 * i)
        streams[8 + 2 * i] = content
    out, at = bytearray(b"%PDF-" + version.encode() + b"\n%\xe2\xe3\xcf\xd3\n"), {}

    def put(number: int, body: bytes) -> None:
        at[number] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    def stream(body: bytes, more: bytes = b"") -> bytes:
        packed = zlib.compress(body, 1)
        return b"<</Length %d /Filter /FlateDecode%s>>\nstream\n%s\nendstream" % (len(packed), more, packed)

    last = 7 + 2 * n
    for number in sorted(streams, reverse=True):
        put(number, stream(streams[number]))
    if version == "1.4":
        for number in sorted(plain, reverse=True):
            put(number, plain[number])
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % last + b"".join(b"%010d 00000 n \n" % at[i] for i in range(1, last))
        out += b"trailer\n<</Size %d /Root 1 0 R /Info 3 0 R>>\n" % last
    else:
        heads, bodies, place = [], b"", {}
        for k, number in enumerate(sorted(plain, reverse=True)):
            heads.append(b"%d %d" % (number, len(bodies)))
            bodies += plain[number] + b"\n"
            place[number] = k
        head = b" ".join(heads) + b"\n"
        put(last, stream(head + bodies, b" /Type /ObjStm /N %d /First %d" % (len(plain), len(head))))
        start = len(out)
        rows = [b"\0" * 7] + [bytes([2]) + last.to_bytes(4) + place[i].to_bytes(2) if i in place else bytes([1]) + at[i].to_bytes(4) + b"\0\0" for i in range(1, last + 1)] + [bytes([1]) + start.to_bytes(4) + b"\0\0"]
        above, table = bytes(7), b""
        for r in rows:
            table += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, above, strict=True))
            above = r
        put(last + 1, stream(table, b" /Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Info 3 0 R /DecodeParms <</Predictor 12 /Columns 7>>" % (last + 2)))
    out += b"startxref\n%d\n%%%%EOF" % (start if tree else 1)
    return bytes(out)


def _hexes(texts: list[str], codes: _Codes) -> list[bytes]:
    """_hex of each, the codes looked up for all together."""
    every = "".join(texts).translate(codes).encode("utf-16-be").hex().encode()
    if len(every) != 4 * sum(map(len, texts)):  # more characters than codes of two bytes
        return [_hex(t, codes) for t in texts]
    ends = [4 * n for n in accumulate(map(len, texts))]
    return [b"<%b>" % every[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def text_page(lines: list[str], codes: _Codes, shuffled: bool = False) -> bytes:
    """Lines down the page, each where it belongs; shuffled: drawn in another order."""
    order = sorted(range(len(lines)), key=lambda i: (i * 7 % 11, i)) if shuffled else range(len(lines))
    said = _hexes(lines, codes)
    return b"\n".join([b"BT /F %d Tf 1 0 0 1 40 %d Tm %b Tj ET" % (SIZE, 750 - LEADING * i, said[i]) for i in order])


def table_page(rows: list[list[str]], codes: _Codes, width: int = 120, height: int = 20) -> bytes:
    """A ruled grid with one line of text in each cell."""
    columns, top = max(map(len, rows)), 760
    bottom, right = top - height * len(rows), 30 + width * columns
    out = [b"0.5 w"]
    out += [b"%d %d m %d %d l S" % (30 + width * c, top, 30 + width * c, bottom) for c in range(columns + 1)]
    out += [b"30 %d %d 0.4 re f" % (top - height * r, right - 30) for r in range(len(rows) + 1)]
    for r, row in enumerate(rows):
        out += [b"BT /F %d Tf %d %d Td %s Tj ET" % (SIZE, 34 + width * c, top - height * (r + 1) + 6, _hex(cell, codes)) for c, cell in enumerate(row) if cell]
    return b"\n".join(out)


def _lines(words: pa.ListArray) -> list[list[str]]:
    """Lists of words as lists of lines of WORDS words; the words are joined within Arrow."""
    ends = words.offsets.to_numpy()
    counts = -(-np.diff(ends) // WORDS)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(ends[:-1], counts) + WORDS * (np.arange(counts.sum()) - first)
    of_lines = pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]), pa.int32()), words.values)
    said, stops = pc.binary_join(of_lines, " ").to_pylist(), np.cumsum(counts).tolist()
    return [said[b - n : b] for b, n in zip(stops, counts.tolist(), strict=True)]


def _text_lines(text: str | None) -> list[str]:
    """A text's words, as white space of ASCII parts them, as lines of WORDS words."""
    words = (text or "").encode().split()
    return [b" ".join(words[i : i + WORDS]).decode() for i in range(0, len(words), WORDS)]


def _written(rows: DataFrame, render, lines_of: str | None = None) -> DataFrame:
    """rows(url, ..) to (url, content) by render(row) in Arrow batches; the words of column lines_of become lines."""
    arrow_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        urls, files, held = [], [], 0

        def written() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(files, pa.binary())], ["url", "content"])
            urls.clear()
            files.clear()
            return made

        for b in batches:
            listed = b.to_pylist() if lines_of is None else b.drop_columns([lines_of]).to_pylist()
            if lines_of is not None:
                words = b.column(lines_of)
                every = map(_text_lines, words.to_pylist()) if pa.types.is_string(words.type) else _lines(words.fill_null([]))
                for row, lines in zip(listed, every, strict=True):
                    row[lines_of] = lines
            for row in listed:
                urls.append(row["url"])
                files.append(render(row))
                held += len(files[-1])
                if held >= BATCH_BYTES:
                    yield written()
                    held = 0
        yield written()

    return rows.mapInArrow(run, "url string, content binary")


def write_texts(rows: DataFrame) -> DataFrame:
    """rows(url, title, words, version, shuffled, tree) to PDFs (url, content) of lines of WORDS words.

    words is an array, or a text whose words are parted by white space of ASCII, which is split within the task.
    """

    def render(row: dict) -> bytes:
        lines, codes = row["words"], _Codes()
        pages = [text_page(lines[i : i + LINES], codes, row["shuffled"]) for i in range(0, len(lines), LINES)] or [b""]
        return write_pdf(pages, codes, row["title"] or "", row["version"], row["tree"])

    return _written(rows.select("url", "title", "words", "version", "shuffled", "tree"), render, "words")


def write_tables(rows: DataFrame) -> DataFrame:
    """rows(url, tables array<array<array<string>>>, version) to PDFs (url, content) with each table on a page of its own."""

    def render(row: dict) -> bytes:
        codes = _Codes()
        return write_pdf([table_page(t, codes) for t in row["tables"]], codes, row["url"], row["version"])

    return _written(rows.select(F.col("url").cast("string").alias("url"), "tables", "version"), render)
