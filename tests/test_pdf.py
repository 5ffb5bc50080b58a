"""PDF objects, the two readings and ruled tables; damage."""

import zlib

import pytest

from loomtext.operators import extract
from loomtext.sources import pdf, pdf_write
from loomtext.sources import pdf_objects as P


def words_pdf(lines, **how):
    codes = pdf_write._Codes()
    return pdf_write.write_pdf([pdf_write.text_page(page, codes, how.pop("shuffled", False)) for page in lines], codes, "T", **how)


def read(spark, *files):
    rows = spark.createDataFrame([(str(i), f) for i, f in enumerate(files)], "url string, content binary")
    return {r.url: r for r in pdf.read_pdfs(rows).collect()}


@pytest.mark.parametrize("version", ["1.4", "1.5"])
def test_pages_come_in_the_order_of_the_tree(spark, version):
    pages = [[f"page {p} line {i} é 日本 😀" for i in range(14)] for p in range(3)]
    file = words_pdf(pages, version=version)
    assert file.index(b"\n9 0 obj") < file.index(b"\n7 0 obj") if version == "1.4" else b"/ObjStm" in file
    got = read(spark, file, words_pdf(pages, version=version, shuffled=True), words_pdf(pages, version=version, tree=False))
    want = "\n\n".join("\n".join(p) for p in pages)
    assert (got["0"].primary_text, got["0"].primary_pages, got["0"].fallback_text) == (want, 3, None)
    assert got["1"].primary_text == want  # drawn out of order, read by place
    assert got["2"].primary_error and got["2"].primary_text is None and got["2"].fallback_text == want and got["2"].fallback_pages == 3


def test_no_files_and_empty_ones(spark):
    got = read(spark, None, b"", b"GIF89a", words_pdf([[]]), words_pdf([["x"]])[:200])
    assert all(got[i].primary_error and got[i].fallback_error == "ValueError" for i in "012")
    assert (got["3"].primary_text, got["3"].primary_pages, got["3"].fallback_text) == ("", 1, "")
    assert extract.choose_pdf_text(pdf.read_pdfs(spark.createDataFrame([], "url string, content binary"))).collect() == []


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_predictors(kind):
    rows = [bytes((i * 31 + j * j) & 255 for j in range(9)) for i in range(5)]
    above, data = bytes(9), b""
    for r in rows:
        line = bytearray()
        for j, x in enumerate(r):
            left, up, corner = r[j - 3] if j > 2 else 0, above[j], above[j - 3] if j > 2 else 0
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda v: (abs(p - v), (left, up, corner).index(v)))
            line.append((x - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
        data, above = data + bytes([kind]) + line, r
    assert P._unpredicted(data, {"Predictor": 15, "Columns": 3, "Colors": 3}) == b"".join(rows)
    flat = bytes([1, 2, 3, 1, 1, 1])
    assert P._unpredicted(flat, {"Predictor": 2, "Columns": 2, "Colors": 3}) == bytes([1, 2, 3, 2, 3, 4])


def test_values():
    assert P.read_value(b"<< /A#20b [1 -.5 (a\\(b\\)\\101\\\n) <4a4> true null 3 0 R] >>", 0)[0] == {"A b": [1, -0.5, b"a(b)A", b"J@", True, None, 3]}
    assert isinstance(P.read_value(b"3 0 R", 0)[0], P.Ref) and isinstance(P.read_value(b"Tj", 0)[0], P.Word)
    for bad in (b"(a", b"[1", b"<< 1 2 >>"):
        with pytest.raises(ValueError):
            P.read_value(bad, 0)


def plain_pdf(content, resources=b"", extra=b""):
    return b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n3 0 obj <</Type /Page /Contents 4 0 R /Resources <<" + resources + b">>>> endobj\n4 0 obj <</Length %d>>\nstream\n" % len(content) + content + b"\nendstream endobj\n" + extra


def test_fonts_forms_and_matrices(spark):
    cmap = b"1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfrange <41> <43> <0391> endbfrange 1 beginbfrange <44> <45> [<00660069> <0058>] endbfrange"
    font = b"5 0 obj <</Type /Font /Subtype /Type1 /ToUnicode 6 0 R /FirstChar 65 /Widths [1000 1000 1000 1000 1000]>> endobj\n6 0 obj <</Length %d>>\nstream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    named = b"7 0 obj <</Type /Font /Subtype /Type1 /Encoding <</Differences [65 /uni20AC /x]>>>> endobj\n"
    form = b"8 0 obj <</Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 -50] /Length 39>>\nstream\nBT /G 10 Tf 72 700 Td (AB plain) Tj ET\nendstream endobj\n"
    body = b"q 2 0 0 2 0 0 cm BT /F 5 Tf 36 350 Td (ABC) Tj 1 0 0 1 51.5 350 Tm (DE) Tj 30 0 Td (A) Tj ET Q /X Do BI /W 1 ID \x00(junk EI BT 72 600 Td [(to) -20 (gether) -600 (apart)] TJ ET"
    got = read(spark, plain_pdf(body, b"/Font <</F 5 0 R /G 7 0 R>> /XObject <</X 8 0 R>>", font + named + form))["0"]
    assert got.primary_text == "ΑΒΓfiX Α\n€x plain\ntogether apart"


def test_references_that_are_wrong_are_mended_by_a_scan(spark):
    good = words_pdf([["one"], ["two"]])
    at = good.rindex(b"startxref")
    assert read(spark, good[:at] + b"startxref\n7\n%%EOF")["0"].primary_text == "one\n\ntwo"
    broken = good.replace(b"/Filter /FlateDecode", b"/Filter /JBIG2Decode", 1)
    got = read(spark, broken)["0"]  # the second page's content, which is first in the file
    assert got.primary_error == "ValueError" and got.fallback_text == "one" and got.fallback_pages == 2
    loop = plain_pdf(b"BT (x) Tj ET").replace(b"/Kids [3 0 R]", b"/Kids [2 0 R 3 0 R]")
    assert read(spark, loop)["0"].fallback_text == "x"


def tables(spark, *files):
    rows = spark.createDataFrame([(str(i), f) for i, f in enumerate(files)], "url string, content binary")
    return sorted((r.url, r.page_number, r.position, r.headers, r.rows) for r in pdf.read_tables(rows).collect())


def test_tables_beside_and_below_one_another(spark):
    grid = lambda x, y, rows, cols: b" ".join(b"%d %d 50 20 re S" % (x + 50 * c, y - 20 * (r + 1)) for r in range(rows) for c in range(cols))
    put = lambda x, y, t: b"BT /F 8 Tf %d %d Td (%s) Tj ET" % (x, y, t)
    body = b" ".join([
        grid(50, 700, 2, 2), put(52, 685, b"a"), put(102, 685, b"b"), put(52, 665, b"1"), put(102, 665, b"2"),
        grid(300, 700, 3, 1), put(302, 685, b"h"), put(302, 665, b"x"), put(302, 645, b"y"),
        grid(50, 640, 1, 2), put(52, 625, b"only"), put(102, 630, b"two"), put(102, 621, b"lines"),
        grid(50, 400, 2, 2), put(200, 500, b"outside"), b"50 300 100 0.5 re f",
    ])
    got = tables(spark, plain_pdf(body), b"no file", zlib.compress(b"x"))
    assert got == [("0", 1, 0, ["a", "b"], [["1", "2"]]), ("0", 1, 1, ["h"], [["x"], ["y"]]), ("0", 1, 2, [], [["only", "two lines"]])]


def test_cells_without_text_and_several_pages(spark):
    codes = pdf_write._Codes()
    pages = [pdf_write.table_page([["h", "", "i"], ["", "v", ""]], codes), b"", pdf_write.table_page([["q"], ["w"], ["日本"]], codes)]
    got = tables(spark, pdf_write.write_pdf(pages, codes, "t", "1.5"))
    assert got == [("0", 1, 0, ["h", "", "i"], [["", "v", ""]]), ("0", 3, 0, ["q"], [["w"], ["日本"]])]


def test_text_is_laid_out_in_its_files_row(spark):
    rows = spark.createDataFrame([("a", "", ["x"], "1.4", False, True)], "url string, title string, words array<string>, version string, shuffled boolean, tree boolean")
    plan = pdf.read_pdfs(pdf_write.write_texts(rows))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Window" not in plan


def test_text_objects_read_together_are_read_as_one_by_one(spark):
    pairs = b"".join(b"<%04x> <%s> " % (code, to) for code, to in ((1, b"0041"), (2, b"65e5"), (3, b"d83dde00"), (4, b"00660069"), (0xD801, b"0042")))
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar %s endbfchar" % pairs
    several = b"5 0 obj <</Type /Font /Subtype /Type0 /ToUnicode 6 0 R /DescendantFonts [<</DW 500>>]>> endobj\n6 0 obj <</Length %d>>\nstream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    single = several.replace(b"<00660069>", b"<0066>    ")
    body = b"BT /F 10 Tf 1 0 0 1 40 700 Tm <000100020003> Tj ET\nBT 1 0 0 1 40 686 Tm <00 04d801> Tj ET\nBT /F 9 Tf 40 672 Td <000100> Tj ET BT 40 658 Td <0002zz0009> Tj ET\nBT 1 0 0 1 80 658 Tm (\x00\x01) Tj ET BT 2 0 0 2 40 630 Tm <> Tj ET 2 Ts BT 0 1 -1 0 40 600 Tm <0001> Tj ET q 2 0 0 2 0 0 cm BT 20 250 Td <00010001> Tj ET Q BT 20 400 Td <0002> Tj ET"
    for font in (several, single):
        files = [plain_pdf(body.replace(b"BT ", how), b"/Font <</F 5 0 R>>", font) for how in (b"BT ", b"BT %\n")]
        seen = []
        for f in files:
            file = P.File(f)
            marks = P.Marks(file)
            marks.page(next(file.pages()))
            seen.append(marks.texts)
        assert seen[0] == seen[1] and len(seen[0]) == 9
        assert read(spark, files[0])["0"].primary_text.split("\n")[0] == "A日😀"


def test_texts_and_lists_of_words_make_the_same_files(spark):
    texts = [None, "", " \t", "a", " ".join(map(str, range(700))), "é x\n日本 \x0b😀\x1f q"]
    kind = "url string, title string, words {}, version string, shuffled boolean, tree boolean"
    made = []
    for of, listed in (("string", texts), ("array<string>", [None if t is None else [w.decode() for w in t.encode().split()] for t in texts])):
        rows = spark.createDataFrame([(str(i), "t", w, "1.5", i % 2 == 0, True) for i, w in enumerate(listed)], kind.format(of))
        made.append(sorted((r.url, bytes(r.content)) for r in pdf_write.write_texts(rows).collect()))
    assert made[0] == made[1] and len(made[0]) == 6


def test_usual_values_are_read_as_others():
    for usual in (b"<</A 3 0 R/B -4 /C /D\n/E [1 +2\n-3] /F [7 0 R 9 0 R]/G []/H 1.5/I<</J 2>>>>", b"[ 1 2 3 ]", b"[1 0 R]", b"[1 2 R]", b"<</A /B>>"):
        apart = usual.replace(b"[", b"[%x\n").replace(b"/", b"%x\n/")
        assert P.read_value(usual, 0)[0] == P.read_value(apart, 0)[0]
    assert P.read_value(b"[7 0 R]", 0)[0] == [7] and isinstance(P.read_value(b"[7 0 R]", 0)[0][0], P.Ref)
