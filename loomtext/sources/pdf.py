"""PDFs as rows: a task reads a file's objects into marks, Spark lays them out as lines, pages and table grids.

Text stays in its file's row, so that laying it out needs no shuffle; marks of tables are rows of their own.

Two readings, as choose_pdf_text() wants them. The primary one follows the cross references and the page tree and
orders text by its place on the page: lines from the top, runs from the left. It fails on damaged files. The fallback
scans for objects, skips what it can't read, takes pages by number where the tree is broken, and keeps the order in
which text is drawn. Images aren't read: a page of them has no text and so goes to the OCR queue.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import native as N
from loomtext.session import arrow_batches
from loomtext.sources import pdf_objects as P

#: Runs of one line differ by no more points in height; edges this near to one another are one grid line.
LINE, SNAP = 3.0, 3.0
#: Marks in one batch of a task's output.
MARKS = 20_000
_FIELDS = [("url", pa.string()), ("kind", pa.string()), ("page", pa.int32()), ("seq", pa.int32()), ("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64()), ("size", pa.float64()), ("text", pa.string())]
#: A run by what orders it: height from the top, place along the line, number; then its end, size and text.
_RUN = pa.struct([("y", pa.float64()), ("x0", pa.float64()), ("seq", pa.int32()), ("x1", pa.float64()), ("size", pa.float64()), ("text", pa.string())])
_SUMMARY = [("primary_title", pa.string()), ("primary_pages", pa.int32()), ("primary_error", pa.string()), ("fallback_text", pa.string()), ("fallback_title", pa.string()), ("fallback_pages", pa.int32()), ("fallback_error", pa.string())]
_SQL = {pa.string(): "string", pa.int32(): "int", pa.float64(): "double"}


def read_pdf(data: bytes, scanned: P.File | None = None) -> tuple[str, str, int]:
    """The fallback reading: (text in the order it is drawn, title, number of pages); a ValueError for what is no PDF or encrypted.

    scanned: the file, if it has been read by a scan already.
    """
    try:
        file = scanned or P.File(data, scan=True)
    except P.DAMAGE as e:
        raise ValueError(str(e)) from e
    pages, texts = 0, []
    try:
        listed = list(file.pages())
    except P.DAMAGE:
        listed = list(file.loose_pages())
    for page in listed:
        pages += 1
        marks = P.Marks(file)
        try:
            marks.page(page)
        except P.DAMAGE:
            pass  # what was drawn before the damage stays
        texts.append(_drawn(marks.texts))
    return "\n\n".join(t for t in texts if t), file.title() or "Untitled", pages


def _drawn(texts: list[tuple]) -> str:
    """Runs as drawn: another height, or a step back, begins a line; a gap is a blank."""
    out: list[str] = []
    last = None
    for x0, y, x1, size, text, _ in texts:
        if last is not None:
            new = abs(y - last[1]) > LINE or x0 < last[2] - P.GAP * size
            out.append("\n" if new else " " if x0 - last[2] > P.GAP * size else "")
        out.append(text)
        last = (x0, y, x1)
    return re.sub(r"\s*\n\s*", "\n", "".join(out)).strip()


def _pages(file: P.File) -> Iterator[P.Marks]:
    for page in file.pages():
        marks = P.Marks(file)
        marks.page(page)
        yield marks


def marks(objects: DataFrame) -> DataFrame:
    """objects(url, content) to rows of kind text or edge by the primary reading; files that it fails on have none."""
    arrow_batches(objects.sparkSession)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for url, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for n, page in enumerate(_pages(P.File(data or b"")), 1):
                        rows += [(url, "text", n, i, x0, y, x1, y, size, text) for i, (x0, y, x1, size, text, _) in enumerate(page.texts) if text.strip()]
                        rows += [(url, "edge", n, i, *e, None, None) for i, e in enumerate(page.edges)]
                except P.DAMAGE:
                    continue
                out += rows
                while len(out) >= MARKS:
                    yield batch(out[:MARKS])
                    out = out[MARKS:]
        yield batch(out)

    return objects.select(F.col("url").cast("string").alias("url"), F.col("content").cast("binary").alias("content")).mapInArrow(run, ", ".join(f"{n} {_SQL[k]}" for n, k in _FIELDS))


class _Runs:
    """A batch of files' runs as columns: those of _RUN, where pages and files end, and what sums a file up."""

    def __init__(self):
        self.urls, self.of_file, self.of_page, self.sums = [], [0], [0], []
        self.columns: list[list] = [[] for _ in range(_RUN.num_fields)]

    def add(self, url: str | None, data: bytes) -> None:
        file, error, pages, title = None, None, [], None
        again: tuple = (None,) * 4
        try:
            file = P.File(data)
            pages = [[(-y, x0, i, x1, size, text) for i, (x0, y, x1, size, text, _) in enumerate(page.texts) if text.strip()] for page in _pages(file)]
            title = file.title() or "Untitled"
        except P.DAMAGE as e:  # a damaged file is a row's error, not the job's
            error, pages = type(e).__name__, []
        if not any(pages):
            try:
                again = (*read_pdf(data, file if file and file.scanned else None), None)
            except P.DAMAGE as e:
                again = (None, None, None, type(e).__name__)
        for page in pages:
            for column, values in zip(self.columns, zip(*page, strict=True), strict=False):
                column += values
            self.of_page.append(len(self.columns[0]))
        self.of_file.append(len(self.of_page) - 1)
        self.urls.append(url)
        self.sums.append((title, None if error else len(pages), error, *again))

    def batch(self) -> pa.RecordBatch:
        runs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, _RUN, strict=True)], fields=list(_RUN))
        pages = pa.ListArray.from_arrays(pa.array(self.of_page, pa.int32()), runs)
        files = pa.ListArray.from_arrays(pa.array(self.of_file, pa.int32()), pages)
        sums = zip(*self.sums, strict=True) if self.sums else [()] * len(_SUMMARY)
        return pa.RecordBatch.from_arrays([pa.array(self.urls, pa.string()), files, *(pa.array(c, k) for c, (_, k) in zip(sums, _SUMMARY, strict=True))], ["url", "pages", *(n for n, _ in _SUMMARY)])


def _runs(objects: DataFrame) -> DataFrame:
    """objects(url, content) to url, pages array<array<run>> by the primary reading, and what sums the file up.

    A file that the primary reading fails on, or finds no text in, has the fallback's answer in its summary.
    """
    arrow_batches(objects.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Runs()
        for b in batches:
            for url, data in zip(b.column(0), b.column(1), strict=True):
                out.add(url.as_py(), data.as_py() or b"")
                if len(out.columns[0]) >= MARKS or len(out.urls) >= MARKS:
                    yield out.batch()
                    out = _Runs()
        yield out.batch()

    fields = ", ".join(f"{f.name}:{_SQL[f.type]}" for f in _RUN)
    return objects.select(F.col("url").cast("string").alias("url"), F.col("content").cast("binary").alias("content")).mapInArrow(run, f"url string, pages array<array<struct<{fields}>>>, " + ", ".join(f"{n} {_SQL[k]}" for n, k in _SUMMARY))


def _line(runs: Column) -> Column:
    """The text of a line's runs, from the left."""
    along = F.array_sort(F.transform(runs, lambda r: F.struct(r["x0"].alias("x0"), r["seq"].alias("seq"), r["x1"].alias("x1"), r["size"].alias("size"), r["text"].alias("text"))))
    gap = lambda rs, r, i: (i > 0) & (r["x0"] - F.get(rs, i - 1)["x1"] > P.GAP * r["size"])
    joined = N.once(along, lambda rs: F.array_join(F.transform(rs, lambda r, i: F.when(gap(rs, r, i), F.concat(F.lit(" "), r["text"])).otherwise(r["text"])), ""))
    return N.strip(F.when(F.size(runs) == 1, F.get(runs, F.lit(0))["text"]).otherwise(joined))


def _page_text(runs: Column) -> Column:
    """A page's runs as text: lines from the top, runs from the left; a run that lies lower than the one before begins a line."""

    def laid_out(rs: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(rs) - 1), lambda i: (i == 0) | (F.get(rs, i)["y"] - F.get(rs, i - 1)["y"] > LINE))
        return N.once(begins, lambda at: F.transform(at, lambda a, k: _line(F.slice(rs, a + 1, F.coalesce(F.get(at, k + 1), F.size(rs)) - a))))

    return F.when(F.size(runs) == 0, F.lit("")).otherwise(F.array_join(F.filter(N.once(F.array_sort(runs), laid_out), lambda t: t != ""), "\n"))


def lines(runs: DataFrame, keys: list[str], carry: dict[str, Column] | None = None) -> DataFrame:
    """runs(keys, seq, x0, y0, x1, size, text) to one row for each key: its text by place, lines from the top, runs from the left.

    carry: aggregates of each key's rows that go along. Rows without a place only count for these.
    """
    carry = carry or {}
    down = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("y0"), "x0", "seq")
    lower = F.coalesce((F.lag("y0").over(down) - F.col("y0") > LINE).cast("int"), F.lit(0))
    placed = runs.withColumn("lower", lower).withColumn("line", F.sum("lower").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*keys, "line").orderBy("x0", "seq")
    gap = F.coalesce(F.col("x0") - F.lag("x1").over(along) > P.GAP * F.col("size"), F.lit(False))
    spaced = placed.withColumn("text", F.when(gap, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    one = spaced.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("x0", "seq", "text")))).alias("runs"), *(c.alias(n) for n, c in carry.items()))
    said = one.withColumn("text", N.strip(F.array_join(F.transform("runs", lambda r: r["text"]), "")))
    return said.groupBy(*keys).agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), lambda t: t != ""), "\n").alias("text"), *(F.max(n).alias(n) for n in carry))


def read_pdfs(objects: DataFrame) -> DataFrame:
    """objects(url, content) to what choose_pdf_text() takes: each reading's text, title, pages and error.

    Pages are joined by an empty line, blank ones left out. Nulls are files that are no PDF. One row for each object, no
    shuffle: a url that repeats has several.
    """
    text = F.array_join(F.filter(F.transform("pages", _page_text), lambda t: t != ""), "\n\n")
    return _runs(objects).select("url", F.when(F.col("primary_error").isNull(), text).alias("primary_text"), *(n for n, _ in _SUMMARY))


def _islands(edges: DataFrame, keys: list[str], lo: str, hi: str, name: str) -> DataFrame:
    """edges with the number of the run of touching intervals lo..hi that each belongs to within its keys."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    new = F.coalesce((F.col(lo) > F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1)) + SNAP).cast("int"), F.lit(0))
    return edges.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def _snapped(positions: Column) -> Column:
    """Rising positions without those near to the one before."""
    far = lambda kept, x: (F.size(kept) == 0) | (x - F.element_at(kept, -1) > SNAP)
    return F.aggregate(F.array_sort(positions), F.array().cast("array<double>"), lambda kept, x: F.when(F.size(kept) == 0, F.array(x)).when(far(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def read_tables(objects: DataFrame) -> DataFrame:
    """objects(url, content) to (url, page_number, position, headers, rows): the ruled tables of each page, from the top.

    Edges that touch one another, by overlapping extents down and across the page, make a table; its upright and level
    edges are the grid's columns and rows. A cell has the runs whose middle lies in it. Tables with no filled cell are
    left out, as are damaged files; a table of a single row has no headers.
    """
    rows = marks(objects)
    page = ["url", "page"]
    e = rows.where("kind = 'edge'").select(*page, "x0", "y0", "x1", "y1")
    e = _islands(e, page, "y0", "y1", "a")
    e = _islands(e, [*page, "a"], "x0", "x1", "b")
    e = _islands(e, [*page, "a", "b"], "y0", "y1", "c")
    upright, level = F.col("x1") - F.col("x0") < 0.5, F.col("y1") - F.col("y0") < 0.5
    grids = e.groupBy(*page, "a", "b", "c").agg(_snapped(F.collect_set(F.when(upright, F.col("x0")))).alias("xs"), _snapped(F.collect_set(F.when(level, F.col("y0")))).alias("ys")).where("size(xs) > 1 and size(ys) > 1")
    # A page's grids meet its runs as one array, so a run is one row throughout.
    of_page = grids.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct((-F.element_at("ys", -1)).alias("top"), F.element_at("xs", 1).alias("left"), "xs", "ys"))).alias("grids"))
    x, y = (F.col("x0") + F.col("x1")) / 2, F.col("y0") + F.col("size") / 4
    holds = lambda g: (F.element_at(g["xs"], 1) <= x) & (x <= F.element_at(g["xs"], -1)) & (F.element_at(g["ys"], 1) <= y) & (y <= F.element_at(g["ys"], -1))
    at = F.array_position(F.transform("grids", holds), True)
    runs = rows.where("kind = 'text'").join(of_page, page).withColumn("table", at.cast("int")).where("table > 0").withColumn("g", F.element_at("grids", F.col("table"))).drop("grids")
    last = lambda n: F.greatest(n, F.lit(0))
    runs = runs.withColumn("row", last(F.size(F.filter("g.ys", lambda v: v > y)) - 1)).withColumn("column", last(F.size(F.filter("g.xs", lambda v: v <= x)) - 1))
    cells = lines(runs, [*page, "table", "row", "column"], {"g": F.first("g")})
    filled = cells.groupBy(*page, "table").agg(F.max("g").alias("g"), F.map_from_entries(F.collect_list(F.struct(F.struct("row", "column"), "text"))).alias("cells"))
    numbers = lambda edges: F.sequence(F.lit(0), F.size(edges) - 2)
    raw = filled.withColumn("raw", F.transform(numbers(F.col("g.ys")), lambda r: F.transform(numbers(F.col("g.xs")), lambda c: F.try_element_at("cells", F.struct(r.alias("row"), c.alias("column"))))))
    clean = raw.withColumn("t", N.clean_pdf_table("raw")).where("t is not null")
    return clean.select("url", F.col("page").alias("page_number"), (F.col("table") - 1).alias("position"), "t.headers", "t.rows")
