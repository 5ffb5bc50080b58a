"""Literal cases, and the SQL that registered queries are checked against.

The cases are SELECTs that both engines read alike. Boundaries of words are written out, because the other engine's \\b
knows ASCII only.
"""

from __future__ import annotations

from loomtext.sources import rules as R


def _values(names: str, rows: list[tuple]) -> str:
    def lit(x) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


HTML_ROWS = [
    (1, "", "<html><head><title> A </title></head><body><h1>B</h1><main><h2>Part <b>one</b></h2><p>x <i>y</i> z</p></main></body></html>"),
    (2, "", "<html><body><h1>Only heading</h1><article><p>some text</p></article></body></html>"),
    (3, "", "<html><head><meta name=og:title content=Named></head><body><p>t</p></body></html>"),
    (4, "", "<html><head><meta property=og:title content=Given></head><body><div role=main>in</div>out</body></html>"),
    (5, "", "<html><body><nav>n</nav><div class=blueprint>gone</div><div id=Sidebar>gone</div><div role=banner>gone</div><p>kept</p></body></html>"),
    (6, "hdb", "<html><body><article>later</article><main>m</main><div class=hdb-content>chosen</div></body></html>"),
    (7, "IRAS", "<html><body><main>m</main><div class=sfContentBlock>chosen</div></body></html>"),
    (8, "", "<html><body><header>h</header><aside>a</aside></body></html>"),
    (9, "", ""),
    (10, "", "<html><body><p>a&amp;b &lt;c&gt; open <p>two<script>var x = 1;</script></body></html>"),
]
TAG_ROWS = [
    (1, "An HDB flat for a Singapore citizen and an industrial site"), (2, "executive condominium or private property, condo"), (3, "a foreigner, non-resident, SC and singapore PR"),
    (4, "stamp duty ABSD and seller's stamp duty, loan-to-value LTV"), (5, "total debt servicing ratio, MSR, central provident fund"), (6, "housing grant, eligibility, first-time, cooling measures, property tax, rental"), (7, "nothing here"), (8, "EC ec mortgage ltv, buyer and seller, accrued interest, an additional permanent resident"),
]
DATE_ROWS = [
    (1, "with effect from 5 March 2023 and 2020-01-01", "2023-03-05"), (2, "effective 7 may 2021", "2021-05-07"), (3, "Effective from 9 JUNE 2022, as at 1 July 2020", "2022-06-09"), (4, "as at 31 February 2020, last updated: 3 August 2019", "2019-08-03"),
    (5, "on 12 September 2018", "2018-09-12"), (6, "dated 2017-11-30", "2017-11-30"), (7, "dated 2017-13-30", ""), (8, "effective 5 Jan 2020", ""), (9, "no date", ""), (10, "as of 5 Jan 2020 then 6 April 2021", "2021-04-06"),
]
URL_ROWS = [
    (1, "/a/b/", "http://h.example/x/y", "http://h.example/a/b"), (2, "c", "http://h.example/x/y", "http://h.example/x/c"), (3, "https://o.example/p/?q=1#f", "http://h.example/", "https://o.example/p?q=1"), (4, "#top", "http://h.example/x/", "http://h.example/x"),
    (5, "?p=2", "http://h.example/x/y", "http://h.example/x/y?p=2"), (6, "../z", "http://h.example/x/y/w", "http://h.example/x/z"), (7, "//o.example/k;v=1", "http://h.example/", "http://o.example/k"), (8, "/", "http://h.example/x", "http://h.example"), (9, "", "http://h.example/x/", "http://h.example/x"), (10, "./q/", "HTTP://h.example:80/x/", "http://h.example:80/x/q"),
]
FOLLOW_ROWS = [
    (1, "hdb", "https://h.example/residential/buying-a-flat/new", True), (2, "hdb", "https://h.example/careers", False), (3, "hdb", "https://h.example/contact-us/residential/buying-a-flat", False), (4, "hdb", "https://h.example/x.pdf", False),
    (5, "ura", "https://u.example/Corporate/Property/List", True), (6, "ura", "https://u.example/corporate/property", False), (7, "ura", "https://u.example/Corporate/Data/x", False), (8, "ura", "https://u.example/docs/a.PDF", True),
    (9, "iras", "https://i.example/x/taxes/stamp-duty/y", True), (10, "iras", "https://i.example/taxes/property-tax/a.png", False), (11, "mas", "https://m.example/regulation/a", True), (12, "mas", "https://m.example/fintech/regulation", False),
    (13, "cpf", "https://c.example/member/home-ownership", True), (14, "cpf", "https://c.example/member/healthcare", False), (15, "none", "https://c.example/member/home-ownership", False), (16, "cpf", "https://c.example", False),
]
ROUTE_ROWS = [(1, "application/pdf", "http://h.example/a/doc.pdf", "pdf", "doc"), (2, "text/html; charset=utf-8", "http://h.example/a/doc.pdf", "pdf", "doc"), (3, "text/html", "http://h.example/a/b", "html", "b"), (4, "image/png", "http://h.example/c", "", "c"), (5, None, "http://h.example/x.PDF", "pdf", "x.PDF")]
HEADING_ROWS = [(1, '[{"level":3,"text":"c"},{"level":2,"text":"b"},{"level":1,"text":"a"}]', "T", "HDB", "b", "HDB"), (2, '[{"level":4,"text":"d"}]', "T", "ura", "T", "URA"), (3, "[]", "T", "x", "T", ""), (4, '[{"level":1,"text":"a"}]', "", None, "a", "")]
TABLE_ROWS = [
    (1, '["A","B"]', '[["1","2"],["3"]]', "Cap", "**Table: Cap**\n| A | B |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |"),
    (2, "[]", '[["x|y","b\\nc"],["1","2","3"]]', "", "| Col 1 | Col 2 | Col 3 |\n| --- | --- | --- |\n| x\\|y | b c |  |\n| 1 | 2 | 3 |"),
    (3, '["A"]', '[["1","2"]]', "", "| A |\n| --- |\n| 1 | 2 |"),
    (4, "[]", "[]", "Cap", ""),
    (5, '["A","B"]', "[]", "", "| A | B |\n| --- | --- |"),
    (6, "[]", '[["",null],[" "]]', "", "| Col 1 | Col 2 |\n| --- | --- |\n|  |  |\n|   |  |"),
]
HTML_TABLE_ROWS = [
    (1, "<table id=r><caption>Rates</caption><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2 <b>x</b></td></tr></tbody></table>", "table#r", "**Table: Rates**\n| A | B |\n| --- | --- |\n| 1 | 2 x |"),
    (2, "<table class='k l'><thead><tr><th>A</th></tr></thead><tr><td>1</td></tr></table>", "table.k", "| A |\n| --- |\n| A |\n| 1 |"),
    (3, "<table><tr><th>H</th></tr><tr><td>v</td></tr><tr><td> </td></tr></table>", "table", "| H |\n| --- |\n| v |"),
    (4, "<table><tr><th>H</th><td>v</td></tr></table>", "table", "| Col 1 | Col 2 |\n| --- | --- |\n| H | v |"),
    (5, "<table><tr><th>only</th></tr></table>", None, None),
]
PDF_ROWS = [
    (1, " ".join(["word"] * 25), "T", 3, None, None, None, None, None),
    (2, " ", "T", 3, None, "from  fallback", "F", 4, None),
    (3, None, None, None, "OSError", "x y", "Untitled", 0, None),
    (4, None, None, None, "OSError", None, None, None, "KeyError"),
]
ROBOTS_ROWS = [
    ("a.example", "User-agent: *\nDisallow: /private\n\nUser-agent: loomtext\nDisallow: /no\nAllow: /"), ("b.example", "User-agent: *\nDisallow:\n"), ("c.example", "User-agent: *\nAllow: /open\nDisallow: /\n"), ("e.example", None),
]
ROBOTS_URL_ROWS = [
    (1, "https://a.example/private/x", True), (2, "https://a.example/no/way", False), (3, "https://b.example/any", True), (4, "https://c.example/x", False), (5, "https://d.example/x", True),
    (6, "https://a.example/nothing?q=1", False), (7, "https://c.example", False), (8, "https://c.example/open/x", True), (9, "https://e.example/x", True),
]
METADATA_STRING_ROWS = [(1, "\ufeff Title ", "Title"), (2, "  a b ", "a b"), (3, None, ""), (4, " \ufeff\ufeff", ""), (5, "x\ufeff", "x\ufeff")]
_PDF = "%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n3 0 obj <</Type /Page /Parent 2 0 R /Contents 4 0 R>> endobj\n4 0 obj <</Length 90>>\nstream\nBT /F1 12 Tf 72 700 Td (Hello plain world) Tj 0 -14 Td [(sec) 20 (ond) -400 (line)] TJ ET\nendstream endobj\n5 0 obj <</Title (Sample)>> endobj\n%%EOF"
PDF_FILE_ROWS = [("a.pdf", _PDF, "Hello plain world\nsecond line", "Sample", 1, False, True), ("b.pdf", "no such file", "", "Untitled", 0, True, True), ("c.pdf", _PDF.replace("/Root", "/Encrypt").replace("<</Title", "<</Encrypt 1 /Title"), "", "Untitled", 0, True, True)]
#: What the literal pages give: title, text, headings, words, warnings, error.
_SHORT = "Very short content ({0} words)"
HTML_WANTED = [
    (1, "A", "Part\none\nx\ny\nz", "2:Partone", 5, _SHORT.format(5), ""), (2, "Only heading", "some text", "", 2, _SHORT.format(2), ""), (3, "Named", "t", "", 1, _SHORT.format(1), ""), (4, "Given", "in", "", 1, _SHORT.format(1), ""), (5, "Untitled", "kept", "", 1, _SHORT.format(1), ""),
    (6, "Untitled", "chosen", "", 1, _SHORT.format(1), ""), (7, "Untitled", "chosen", "", 1, _SHORT.format(1), ""), (8, "Untitled", "", "", 0, "No content text found after extraction", ""), (9, None, None, "", 0, "", "html input is empty"), (10, "Untitled", "a&b <c> open\ntwo", "", 4, _SHORT.format(4), ""),
]
_SCANNED = "Scanned PDF detected (only {0} words extracted) — flagged for OCR queue"
PDF_WANTED = [
    (1, " ".join(["word"] * 25), "T", 3, 25, False, False, ""),
    (2, "from fallback", "F", 4, 2, True, True, "primary reader returned no text, using fallback|" + _SCANNED.format(2)),
    (3, "x y", "Untitled", 0, 2, True, True, "primary reader failed (OSError), using fallback|" + _SCANNED.format(2)),
    (4, "", "Untitled", 0, 0, True, True, "primary reader failed (OSError), using fallback|fallback reader also failed (KeyError)|" + _SCANNED.format(0)),
]
META_ROWS = [(1, "A", 0, '{"title":"t","source_agency":"X","topic_tags":["a","b"]}'), (2, "B", 1, "{}"), (3, "C", 2, '{"property_types":["p"]}')]

CASES = {
    "html": _values("case_id, source, html", HTML_ROWS),
    "tag": _values("case_id, text", TAG_ROWS),
    "date": _values("case_id, text", [r[:2] for r in DATE_ROWS]),
    "url": _values("case_id, href, base", [r[:3] for r in URL_ROWS]),
    "follow": _values("case_id, source, url", [r[:3] for r in FOLLOW_ROWS]),
    "route": _values("case_id, header, url", [r[:3] for r in ROUTE_ROWS]),
    "heading": _values("case_id, headings, title, source", [r[:4] for r in HEADING_ROWS]),
    "table": _values("case_id, headers, rows, caption", [tuple(x.replace("\\", "\\\\") if isinstance(x, str) else x for x in r[:4]) for r in TABLE_ROWS]),
    "html_table": _values("case_id, html", [r[:2] for r in HTML_TABLE_ROWS]),
    "pdf": _values("url, primary_text, primary_title, primary_pages, primary_error, fallback_text, fallback_title, fallback_pages, fallback_error", PDF_ROWS),
    "robots": _values("authority, text", ROBOTS_ROWS),
    "robots_url": _values("case_id, url", [r[:2] for r in ROBOTS_URL_ROWS]),
    "metadata_string": _values("case_id, value", [r[:2] for r in METADATA_STRING_ROWS]),
    "pdf_file": _values("url, content", [r[:2] for r in PDF_FILE_ROWS]),
    "meta": _values("id, source_name, chunk_index, metadata", META_ROWS),
}


def _whole(alternatives: tuple[str, ...]) -> str:
    edge, end = r"(^|[^\pL\pN_])", r"($|[^\pL\pN_])"
    return "|".join(f"{edge}({a[:-1]})" if a.endswith("*") else f"{edge}({a}){end}" for a in alternatives).replace("'", "''")


def _labels(rules, default: str) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches(text, '{_whole(a)}', 'i') THEN '{label}' END" for label, a in rules)
    return f"coalesce(nullif(array_to_string(list_sort(list_filter([{found}], lambda x: x IS NOT NULL)), '|'), ''), '{default}')"


def _contained(words, text: str = "lower(text)") -> str:
    found = ", ".join(f"CASE WHEN contains({text}, '{w}') THEN '{w}' END" for w in words)
    return f"array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), '|')"


def _marks(rules, default: str) -> str:
    found = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{p}')" for p in parts) + f" THEN '{label}' END" for label, parts in rules)
    return f"coalesce(nullif(array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), '|'), ''), '{default}')"


_TAGGED = "(SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT * FROM (" + _values("doc_id, text", [(-i, t) for i, t in TAG_ROWS]) + "))"
_WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"
_ARTICLE = r"regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"


def _unescaped(x: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


_TEXT = _unescaped(r"array_to_string(list_filter(list_transform(regexp_split_to_array(" + _ARTICLE + r", '<[^>]*>'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))")
_EXTRACTED = (
    "(SELECT page_id, url, html, regexp_replace(" + _unescaped(r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + r", '^\s+|\s+$', '', 'g') AS title, "
    + r"regexp_replace(regexp_replace(" + _TEXT + r", '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages)"
)
_URL = r"CASE WHEN regexp_matches(u, '^[^:]+://') THEN lower(regexp_extract(u, '^([^:]+)://', 1)) || '://' || regexp_extract(u, '^[^:]+://([^/?#]*)', 1) || regexp_replace(regexp_replace(regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+$', '') || CASE WHEN regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) = '?' THEN '' ELSE regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) END ELSE u END"
_HOST = "regexp_extract(url, '^[^:]+://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)"
_CRAWLED = f"(SELECT * FROM (SELECT page_id, url, html, {_TEXT} AS text FROM pages) WHERE length(text) >= 100)"
_OLD = "(SELECT url || '#' || page_id AS url, sha256(html) AS h, page_id FROM pages WHERE page_id % 13 <> 0)"
_NEW = "(SELECT url || '#' || page_id AS url, sha256(CASE WHEN page_id % 7 = 0 THEN html || '!' ELSE html END) AS h, page_id FROM pages WHERE page_id % 11 <> 0)"
_DIFF = f"(SELECT url, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'modified' END AS change, o.h AS oh, n.h AS nh FROM {_OLD} o FULL OUTER JOIN {_NEW} n USING (url))"
_CHECKED = r"""
base AS (
  SELECT CAST(conv_id AS VARCHAR) AS doc_key, CAST(turn AS INTEGER) AS i, role,
    CASE WHEN turn = 5 THEN 'Menu' WHEN turn = 6 THEN '© 2024 all' WHEN conv_id % 9 = 0 THEN 'One text that is the same in all turns of a conversation.' ELSE text END AS t, text AS own, turn
  FROM conversations WHERE text IS NOT NULL
), flags AS (
  SELECT *, regexp_replace(t, '^\s+|\s+$', '', 'g') AS s, """ + _WORDS.format("t") + r""" AS n FROM base
), errs AS (
  SELECT *, s = '' AS blank, role = 'system' AS kind, n < 5 AS low, n > 100 AS high,
    regexp_matches(s, '^(skip to (main )?content|jump to navigation)$|^(home\s*[>»|/]\s*){1,}|^(menu|nav(igation)?|sidebar|footer|header|cookie policy|privacy policy)$|^\s*©\s*\d{4}|^(last (updated|modified|reviewed):?\s*[\d/\-]+)$|^(share (this )?page|print this page|back to top|[↑▲]\s*top)$|^(subscribe|sign up|log in|register|contact us)$|^[\s\|\-•·,;:]+$|^\d+\s*$', 'i') AS boiler
  FROM flags
), ok AS (SELECT *, NOT (blank OR kind OR low OR high OR boiler) AS fine FROM errs),
checked AS (
  SELECT *, NOT blank AND coalesce(bool_or(fine) OVER (PARTITION BY doc_key, t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dup FROM ok
), done AS (SELECT *, fine AND NOT dup AS keep FROM checked)"""
_TF = r"(SELECT doc_id, len(w) AS len, unnest(w) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\x0b\f]+'), lambda x: x <> '') AS w FROM documents))"
_BM25 = rf"""
tokens AS {_TF},
size AS (SELECT count(*) AS n, avg(len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\x0b\f]+'), lambda x: x <> ''))) AS m FROM documents),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\x0b\f]+'), lambda x: x <> '')) AS term FROM benchmark),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))), 9) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term) CROSS JOIN size GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 10)"""


def _runs(table: str, key: str, name: str) -> str:
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\x0b\f]+'), lambda x: x <> '')"
    return f"(SELECT DISTINCT {key} AS {name}, md5(array_to_string(w[i : i + 7], ' ')) AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) >= 8))"


_HOLDING = f"""
runs AS {_runs("benchmark", "item_id", "query_id")},
holding AS (SELECT query_id, doc_id FROM runs JOIN {_runs("documents", "doc_id", "doc_id")} USING (run) JOIN (SELECT query_id, count(*) AS n FROM runs GROUP BY 1) USING (query_id) GROUP BY query_id, doc_id, n HAVING count(*) >= 0.5 * n)"""
_FED = rf"""
every AS (SELECT doc_id, len, term, count(*) AS tf FROM tokens GROUP BY ALL),
spread AS (SELECT term, count(*) AS df FROM every GROUP BY term),
held AS (SELECT query_id, every.term, sum(tf / len) AS share FROM ranked JOIN every USING (doc_id) WHERE rank <= 5 GROUP BY ALL),
weighed AS (SELECT query_id, term, round(share * ln(n / df), 9) AS w FROM held ANTI JOIN asked USING (query_id, term) JOIN spread USING (term) CROSS JOIN size),
more AS (SELECT query_id, string_agg(term, ' ' ORDER BY term) AS more FROM (SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, term) <= 5) GROUP BY query_id),
fed AS (SELECT item_id AS query_id, coalesce(text, '') || ' ' || coalesce(more, '') AS text FROM benchmark LEFT JOIN more ON query_id = item_id)"""
_CHECKSUM = "round(list_sum(list_transform({0}, lambda x, i: CAST(x AS DOUBLE) * i)), 4)"


def _cosine(where: str) -> str:
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings {where}),
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM q CROSS JOIN v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""


_PAGE_LINKS = r'''WITH l AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS position FROM pages) SELECT page_id, position, ''' + _URL + " AS url FROM (SELECT page_id, position, CASE WHEN starts_with(h, '/') THEN regexp_extract(base, '^[^:]+://[^/?#]*') || h ELSE h END AS u FROM (SELECT * REPLACE (" + _unescaped("h") + " AS h) FROM l))"

ORACLE = {
    "html_extract_text": f"SELECT page_id, title, text, {_WORDS.format('text')} AS word_count FROM {_EXTRACTED}",
    "page_word_stats": f"SELECT {_HOST} AS host, count(*) AS pages, sum(n) AS words, max(n) AS most_words, count(*) FILTER (n < 50) AS short_pages, count(DISTINCT sha256(html)) AS contents FROM (SELECT *, {_WORDS.format('text')} AS n FROM {_EXTRACTED}) GROUP BY 1",
    "url_normalize": f"SELECT page_id, {_URL} AS url, left(md5(u), 12) AS url_hash FROM (SELECT page_id, url AS u FROM pages)",
    "url_join": _values("case_id, url", [(r[0], r[3]) for r in URL_ROWS]) + " UNION ALL SELECT page_id * 10 + i + 1000, " + _URL + """ FROM (SELECT page_id, i, CASE i WHEN 0 THEN o || '/a/b/' WHEN 1 THEN regexp_replace(url, '[?#].*$', '') || '?p=2' WHEN 2 THEN regexp_replace(url, '#.*$', '') || '#top' WHEN 3 THEN regexp_extract(url, '^[^:]+') || '://o.example/k;v=1' WHEN 4 THEN 'https://o.example/p/?q=1#f' WHEN 5 THEN o || regexp_replace(f, '[^/]+/$', '') || 'z' ELSE o || f || 'q' END AS u FROM (SELECT page_id, url, regexp_extract(url, '^[^:]+://[^/?#]*') AS o, regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS f FROM pages) CROSS JOIN range(7) t(i))""",
    "url_domain_counts": f"SELECT {_HOST} AS domain, count(*) AS pages FROM pages GROUP BY 1",
    "follow_link_filter": _values("case_id, follow", [(r[0], r[3]) for r in FOLLOW_ROWS]) + f""" UNION ALL SELECT page_id * 100 + i + 1000, page_id % 4 IN (0, 2) AND (page_id % 4 = 0 OR i <> -1) FROM pages CROSS JOIN range({sum(len(r.sections) for r in R.FOLLOW_RULES.values())}) t(i)""",
    "content_router": _values("case_id, kind, title", [(r[0], *r[3:]) for r in ROUTE_ROWS]) + """ UNION ALL SELECT page_id + 1000, CASE WHEN page_id % 3 = 0 OR page_id % 4 = 1 THEN 'pdf' WHEN page_id % 4 = 0 THEN 'html' ELSE '' END, 'd' || page_id FROM pages""",
    "path_sections": "SELECT case_id, CASE WHEN len(p) > 1 THEN p[2] ELSE 'general' END AS second, p[-1] AS last, CASE WHEN contains(lower(url), 'stamp-duty') THEN 'stamp_duty' WHEN contains(lower(url), 'property-tax') THEN 'property_tax' ELSE 'general' END AS tax FROM (SELECT *, string_split(trim(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/'), '/') AS p FROM (SELECT case_id, url FROM (" + CASES["follow"] + ") UNION ALL SELECT page_id + 1000, url FROM pages))",
    "page_links": _PAGE_LINKS,
    "page_links_allowed": "SELECT * FROM (" + _PAGE_LINKS + ") WHERE " + _HOST + " IN (SELECT " + _HOST + " FROM pages WHERE page_id % 2 = 0) AND url NOT IN (SELECT regexp_extract(url, '^[^:]+://[^/?#]*') || unnest(['/the', '/The', '/and', '/to', '/in']) FROM pages WHERE page_id % 3 = 0)",
    "link_frontier_bfs": "WITH RECURSIVE links AS (" + _PAGE_LINKS + "), src AS (SELECT page_id, " + _URL + " AS src FROM (SELECT page_id, url AS u FROM pages)), edges AS (SELECT DISTINCT src, url AS dst FROM links JOIN src USING (page_id)), r AS (SELECT src AS url, 0 AS depth FROM src WHERE page_id % 20 = 0 UNION SELECT dst, depth + 1 FROM r JOIN edges ON src = r.url WHERE depth < 200) SELECT url, min(depth) AS depth FROM r GROUP BY 1",
    "crawl_order": "WITH RECURSIVE links AS (" + _PAGE_LINKS + "), src AS (SELECT page_id, regexp_extract(u, '^[^:]+://[^/?#]*') AS host, " + _URL + " AS src FROM (SELECT page_id, url AS u FROM pages)), every AS (SELECT src, position, url FROM links JOIN src USING (page_id) UNION ALL SELECT src, 1000, host || unnest(['/', '/f.pdf']) FROM src UNION ALL SELECT host || '/', page_id, src FROM src), known AS (SELECT src, url, min(position) AS position FROM every GROUP BY ALL), queued AS (SELECT * FROM known WHERE NOT contains(" + _PATH + ", '/and') AND NOT ends_with(lower(url), '.pdf')), ruled AS (SELECT DISTINCT " + _HOST + " AS host FROM pages WHERE page_id % 5 = 0), may AS (SELECT url, NOT (starts_with(" + _PATH + ", '/fr/') AND " + _HOST + " IN (SELECT host FROM ruled)) AS fetched FROM (SELECT url FROM known UNION SELECT src FROM src)), start AS (SELECT src AS url, min(page_id) AS p FROM src WHERE page_id % 20 = 0 GROUP BY 1), reach AS (SELECT url, 0 AS depth FROM start UNION SELECT q.url, depth + 1 FROM reach JOIN may ON may.url = reach.url AND fetched JOIN queued q ON src = reach.url WHERE depth < 50), level AS (SELECT url, min(depth) AS depth FROM reach GROUP BY 1), visit AS (SELECT url, 0 AS depth, row_number() OVER (ORDER BY p, url) - 1 AS n FROM start UNION ALL SELECT url, depth, row_number() OVER (ORDER BY f, url) - 1 AS n FROM (SELECT q.url, v.depth + 1 AS depth, min((v.n, q.position)) AS f FROM visit v JOIN may ON may.url = v.url AND fetched JOIN queued q ON q.src = v.url JOIN level l ON l.url = q.url AND l.depth = v.depth + 1 GROUP BY 1, 2)), sizes AS (SELECT depth, count(*) AS c FROM visit GROUP BY 1), order_of AS (SELECT v.url, v.depth, CAST(v.n + (SELECT coalesce(sum(c), 0) FROM sizes s WHERE s.depth < v.depth) AS BIGINT) AS visit, fetched, false AS inline FROM visit v JOIN may USING (url)), pdfs AS (SELECT k.url, min((visit, position, depth)) AS f FROM known k JOIN order_of o ON o.url = k.src AND fetched WHERE ends_with(lower(k.url), '.pdf') AND k.url NOT IN (SELECT url FROM order_of) GROUP BY 1) SELECT * FROM order_of UNION ALL SELECT url, f[3], f[1], true, true FROM pdfs",
    "robots_filter": f"SELECT page_id, url FROM pages WHERE NOT (starts_with(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/fr/') AND {_HOST} IN (SELECT {_HOST} FROM pages WHERE page_id % 5 = 0))",
    "content_hash_dups": "SELECT page_id, url, sha256(html) AS content_hash, left(md5(url), 12) AS url_hash, count(*) OVER w AS copies, min(page_id) OVER w AS first_page FROM pages WINDOW w AS (PARTITION BY html)",
    "unprocessed_documents": "SELECT doc_id AS document_id, source AS code FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL AND doc_id % 3 <> 0",
    "unembedded_chunks": "SELECT doc_id AS document_id, source AS source_name, 'u' || doc_id AS source_url, 'text' AS chunk_type, 'html' AS content_type, CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS headings FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0",
    "snapshot_diff": f"SELECT url, change FROM {_DIFF}",
    "crawl_job_stats": f"SELECT 's' AS source_id, count(*) FILTER (change <> 'deleted') AS pages_found, count(*) FILTER (change = 'new') AS pages_new, count(*) FILTER (change = 'modified') AS pages_changed, count(*) FILTER (change = 'deleted') AS pages_deleted FROM {_DIFF}",
    "raw_documents_merge": f"SELECT url, coalesce(nh, oh) AS content_hash, 'text/html' AS content_type, CASE WHEN change IN ('new', 'modified') THEN 'pending' ELSE 'processed' END AS status, CASE WHEN change IN ('new', 'modified') THEN '2024-02-01' ELSE '2024-01-01' END AS crawled_on FROM {_DIFF}",
    "mark_processed": "SELECT CASE WHEN doc_id % 3 = 0 THEN 'processed' ELSE 'pending' END AS status, count(*) AS documents FROM documents GROUP BY 1",
    "ensure_sources": "SELECT DISTINCT source AS code, CASE WHEN source <> 'src1' THEN 'old' ELSE 'new' END AS name FROM documents",
    "effective_date": _values("case_id, effective_date", [(r[0], r[2]) for r in DATE_ROWS]) + """ UNION ALL SELECT o_orderkey + 1000, strftime(o_orderdate, '%Y-%m-%d') FROM orders""",
    "tag_property": f"SELECT doc_id, {_labels(R.PROPERTY_RULES, 'all')} AS property_types FROM {_TAGGED}",
    "tag_citizenship": f"SELECT doc_id, {_labels(R.CITIZENSHIP_RULES, 'all')} AS citizenship_types FROM {_TAGGED}",
    "tag_topics": f"SELECT doc_id, {_labels(R.TOPIC_RULES, '')} AS topic_tags FROM {_TAGGED}",
    "section_and_agency": _values("case_id, section, agency", [(r[0], *r[4:]) for r in HEADING_ROWS]) + """ UNION ALL SELECT doc_id + 1000, coalesce(list_filter(list_transform(l, lambda x, i: CASE WHEN (doc_id + i - 1) % 5 < 2 THEN md5(x) END), lambda x: x IS NOT NULL)[1], 'T' || doc_id), ['HDB', 'URA', 'IRAS', 'MAS', 'CPF', ''][doc_id % 6 + 1] FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)""",
    "relevance_and_keywords": f"SELECT doc_id, {_contained(R.RELEVANCE_KEYWORDS)} <> '' AS relevant, {_contained(R.RELEVANCE_KEYWORDS)} AS topics, {_contained(R.HOME_KEYWORDS)} AS home_topics FROM {_TAGGED}",
    "tax_and_home_types": "SELECT doc_id, " + _marks((("BSD", ("buyer", "bsd")), ("ABSD", ("additional", "absd")), ("SSD", ("seller", "ssd"))), "") + " AS tax_types, " + _marks((("hdb", ("hdb",)), ("private", ("private", "condominium")), ("ec", ("executive condominium", " ec "))), "all") + " AS property_types, " + _marks((("SC", ("singapore citizen",)), ("PR", ("permanent resident",))), "all") + f" AS citizenship_types FROM {_TAGGED}",
    "table_markdown": _values("case_id, markdown", [(r[0], r[4]) for r in TABLE_ROWS]) + """ UNION ALL SELECT case_id, '**Table: ' || caption || '**' || chr(10) || '| key | status | day |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(r, lambda x: '| ' || x[1] || ' | ' || replace(x[2], '|', chr(92) || '|') || ' | ' || replace(x[3], chr(10), ' ') || ' |'), chr(10)) FROM (SELECT o_custkey + 1000 AS case_id, 'Orders of ' || o_custkey AS caption, list([CAST(o_orderkey AS VARCHAR), o_orderstatus || '|' || o_orderpriority, strftime(o_orderdate, '%Y') || chr(10) || strftime(o_orderdate, '%m')] ORDER BY o_orderkey) AS r FROM orders GROUP BY o_custkey)""",
    "html_tables": _values("case_id, position, source_tag, markdown", [(r[0], 0, *r[2:]) for r in HTML_TABLE_ROWS if r[2]]) + """ UNION ALL SELECT case_id, 0, 'table#t' || case_id, '**Table: ' || caption || '**' || chr(10) || '| key | status | day |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(r, lambda x: '| ' || x[1] || ' | ' || replace(x[2], '|', chr(92) || '|') || ' | ' || replace(x[3], chr(10), ' ') || ' |'), chr(10)) FROM (SELECT o_custkey + 1000 AS case_id, 'Orders of ' || o_custkey AS caption, list([CAST(o_orderkey AS VARCHAR), o_orderstatus || '|' || o_orderpriority, strftime(o_orderdate, '%Y') || chr(10) || strftime(o_orderdate, '%m')] ORDER BY o_orderkey) AS r FROM orders GROUP BY o_custkey)""",
    "whitespace_normalize": rf"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS tidy_sha256, {_WORDS.format('text')} AS words FROM documents",
    "chunk_words": r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\x0b\f]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((len(w) - 300) / 260.0)) AS BIGINT) + 1)) AS k FROM w WHERE len(w) > 0) SELECT doc_id AS doc_key, k AS chunk_index, len(w[k * 260 + 1 : k * 260 + 300]) AS word_count, sha256(array_to_string(w[k * 260 + 1 : k * 260 + 300], ' ')) AS chunk_sha256 FROM c",
    "heading_asof": "WITH l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)), h AS (SELECT doc_id, i, length(line) % 4 + 1 AS level, md5(line) AS t, max(i) OVER (PARTITION BY doc_id, length(line) % 4 ORDER BY i) AS own FROM l WHERE i % 3 = 0), o AS (SELECT a.doc_id, a.i, a.level, a.t, min(b.i) AS until FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.i > a.i AND b.level <= a.level GROUP BY ALL), p AS (SELECT l.doc_id, l.i, string_agg(level || ':' || t, '|' ORDER BY level) AS path FROM l JOIN o ON l.doc_id = o.doc_id AND o.i <= l.i AND (until IS NULL OR l.i < until) WHERE l.i % 3 <> 0 GROUP BY ALL) SELECT l.doc_id AS doc_key, CAST(l.i AS BIGINT) AS start, coalesce(path, '') AS path FROM l LEFT JOIN p USING (doc_id, i) WHERE l.i % 3 <> 0",
    "validate_errors": f"WITH {_CHECKED} SELECT message, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN blank THEN 'chunk_text is empty or whitespace-only' END, CASE WHEN kind AND NOT blank THEN 'chunk_type ''other'' is not one of [''table'', ''text'']' END, CASE WHEN low AND NOT blank THEN 'token count # is below minimum 5' END, CASE WHEN high THEN 'token count # exceeds maximum 100' END, CASE WHEN boiler AND NOT blank THEN 'chunk contains only navigation or boilerplate content' END, CASE WHEN dup THEN 'duplicate chunk (sha256# …)' END], lambda x: x IS NOT NULL)) AS message FROM done) GROUP BY 1",
    "validate_dedupe_reindex": f"WITH {_CHECKED} SELECT doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY i) - 1 AS chunk_index, sha256(t) AS chunk_sha256 FROM done WHERE keep",
    "validate_summary": f"WITH {_CHECKED} SELECT doc_key, count(*) AS chunks, count(*) FILTER (keep) AS valid, count(*) FILTER (NOT keep) AS filtered, bool_and(keep) AS is_valid, coalesce(list(i ORDER BY i) FILTER (keep), []) <> range(0, count(*) FILTER (keep)) AS renumbered, CASE WHEN coalesce(list(i ORDER BY i) FILTER (keep), []) <> range(0, count(*) FILTER (keep)) THEN 'chunk_index not sequential after filtering; re-indexing from [' || array_to_string(list(i ORDER BY i) FILTER (keep), ', ') || '] to [' || array_to_string(range(0, count(*) FILTER (keep)), ', ') || ']' ELSE '' END AS renumbering FROM done GROUP BY doc_key",
    "validate_lines": "SELECT doc_id || '-' || i AS doc_key, CASE WHEN k < 2 THEN 'chunk_text is empty or whitespace-only' WHEN k = 2 THEN 'chunk_text contains null bytes (possible binary corruption)' ELSE '' END AS errors, CASE WHEN k < 3 THEN '' ELSE array_to_string(list_filter([CASE WHEN i % 3 = 0 THEN 'source_name' END, CASE WHEN i % 2 = 0 THEN 'heading_path' END, CASE WHEN k = 3 THEN 'chunk_text|chunk_text' END], lambda x: x IS NOT NULL), '|') END AS warnings FROM (SELECT doc_id, i, (doc_id + i) % 6 AS k FROM (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents))",
    "token_share": f"SELECT source, doc_id, CAST(floor(sum(n) OVER w / count(*) OVER w) AS BIGINT) AS share FROM (SELECT source, doc_id, {_WORDS.format('text')} AS n FROM documents) WINDOW w AS (PARTITION BY source, doc_id // 16)",
    "vector_namespace_upsert": f"WITH v AS (SELECT lower('NS' || label) || '-' || vec_id AS vector_id, lower('NS' || label) AS ns, len(embedding) AS dim, CASE WHEN vec_id % 10 = 7 THEN -1 ELSE 1 END * {_CHECKSUM.format('embedding')} AS checksum FROM embeddings) SELECT unnest([ns, 'all']) AS namespace, vector_id, dim, checksum FROM v",
    "vector_fallback_upsert": f"SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 's-' || vec_id END AS embedding_id, CASE WHEN vec_id % 3 = 0 THEN -1 WHEN vec_id % 5 = 0 THEN 1 END * {_CHECKSUM.format('embedding')} AS checksum FROM embeddings",
    "embedding_usage": "SELECT doc_id AS id, 3 AS dim, CAST(length(t) + 2 * (length(t) - length(replace(t, ' ', ''))) + 3 * (strlen(t) % 1000) AS DOUBLE) AS checksum FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "migrated_documents": "SELECT source AS source_id, 'u' || doc_id % 400 AS url, CAST(doc_id AS VARCHAR) AS id, sha256(coalesce(text, '')) AS content_hash, true AS no_status FROM documents QUALIFY row_number() OVER (PARTITION BY source, doc_id % 400 ORDER BY doc_id % 3 DESC, sha256(coalesce(text, '')) DESC, CAST(doc_id AS VARCHAR) DESC) = 1",
    "html_cases": _values("case_id, title, text, headings, word_count, warnings, error", HTML_WANTED) + """ UNION ALL SELECT doc_id + 1000, CASE doc_id % 4 WHEN 0 THEN 'T' || doc_id WHEN 1 THEN 'H' || doc_id WHEN 2 THEN 'N' || doc_id ELSE 'Untitled' END, 'Part' || chr(10) || doc_id || chr(10) || md5(coalesce(text, '')) || chr(10) || 'end', '2:Part' || doc_id || '|5:end', 4, 'Very short content (4 words)', '' FROM documents""",
    "rate_tables": _values("case_id, position, headers, n_rows", [(1, 0, "A|B", 1), (2, 0, "A", 2), (3, 0, "H", 1)]) + """ UNION ALL SELECT case_id, 0, 'key|status|day', len(r) FROM (SELECT o_custkey + 1000 AS case_id, 'Orders of ' || o_custkey AS caption, list([CAST(o_orderkey AS VARCHAR), o_orderstatus || '|' || o_orderpriority, strftime(o_orderdate, '%Y') || chr(10) || strftime(o_orderdate, '%m')] ORDER BY o_orderkey) AS r FROM orders GROUP BY o_custkey)""",
    "pdf_table_clean": _values("case_id, headers, rows", [(1, "1|2", "3"), (2, "x|y|b c", "1;2;3"), (3, "", "1;2")]) + """ UNION ALL SELECT case_id, CASE WHEN case_id % 2 = 0 THEN 'key|status|day' WHEN len(r) = 1 THEN '' ELSE array_to_string(c[1], '|') END, array_to_string(list_transform(CASE WHEN case_id % 2 = 0 OR len(r) = 1 THEN c ELSE c[2:] END, lambda x: array_to_string(x, ';')), '|') FROM (SELECT *, list_transform(r, lambda x: [x[1], CASE WHEN starts_with(x[2], 'F|') THEN '' ELSE x[2] END, replace(x[3], chr(10), ' ')]) AS c FROM (SELECT o_custkey + 1000 AS case_id, 'Orders of ' || o_custkey AS caption, list([CAST(o_orderkey AS VARCHAR), o_orderstatus || '|' || o_orderpriority, strftime(o_orderdate, '%Y') || chr(10) || strftime(o_orderdate, '%m')] ORDER BY o_orderkey) AS r FROM orders GROUP BY o_custkey))""",
    "pdf_choice": _values("url, text, title, page_count, word_count, used_fallback, needs_ocr, warnings", PDF_WANTED) + f""" UNION ALL SELECT 'd' || doc_id, sha256(t), CASE WHEN doc_id % 2 = 0 AND n > 0 THEN 'F' WHEN doc_id % 2 = 0 THEN 'F' ELSE 'P' END, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END, n, doc_id % 2 = 0 OR n = 0, n < 20, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'primary reader failed (OSError), using fallback' END, CASE WHEN doc_id % 2 = 1 AND n = 0 THEN 'primary reader returned no text, using fallback' END, CASE WHEN n < 20 THEN 'Scanned PDF detected (only ' || n || ' words extracted) — flagged for OCR queue' END], lambda x: x IS NOT NULL), '|') FROM (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS n, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents)""",
    "pdf_text": _values("url, text, title, page_count, used_fallback, needs_ocr", [(r[0], *r[2:]) for r in PDF_FILE_ROWS]) + """ UNION ALL SELECT 'c' || c_custkey, c_name || ' ' || c_mktsegment, c_name, 1, c_custkey % 3 = 0, true FROM customer""",
    "pdf_documents": r"SELECT doc_id, 'Document ' || doc_id AS title, CAST(greatest(1, ceil(len(w) / 600.0)) AS INTEGER) AS page_count, doc_id % 5 = 0 OR len(w) = 0 AS used_fallback, sha256(array_to_string(w, ' ')) AS words_sha256 FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\x0b\f]+'), lambda x: x <> '') AS w FROM documents)",
    "pdf_tables": "SELECT conv_id, 1 AS page_number, 'turn|role|chars|md5' AS headers, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS chars, left(md5(coalesce(text, '')), 16) AS md5 FROM conversations",
    "robots_text": _values("case_id", [(r[0],) for r in ROBOTS_URL_ROWS if r[2]]) + """ UNION ALL SELECT page_id + 1000 FROM pages WHERE NOT (starts_with(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/fr/') AND regexp_extract(url, '^[^:]+://([^/?#]*)', 1) IN (SELECT regexp_extract(url, '^[^:]+://([^/?#]*)', 1) FROM pages WHERE page_id % 5 = 0))""",
    "metadata_strings": _values("case_id, value", [(r[0], r[2]) for r in METADATA_STRING_ROWS]) + """ UNION ALL SELECT c_custkey + 1000, c_name || ' of ' || c_mktsegment FROM customer""",
    "migrated_sources": _values("id, name, code, is_active, no_base_url", [("a", "A", "x", True, True)]) + " UNION ALL SELECT DISTINCT source, upper(source), source, false, true FROM documents",
    "fetch_status": "SELECT CASE WHEN page_id % 10 IN (3, 4) THEN 'max_retries_exceeded' ELSE '' END AS error, count(*) AS n FROM pages WHERE page_id % 10 NOT IN (1, 2) GROUP BY 1",
    "crawl_jobs": f"SELECT source_id, 'full' AS job_type, 'completed' AS status, count(*) FILTER (change <> 'deleted') AS pages_found, count(*) FILTER (change = 'new') AS pages_new, count(*) FILTER (change = 'modified') AS pages_changed, count(*) FILTER (change = 'deleted') AS pages_deleted, (SELECT count(*) FROM pages WHERE page_id % 10 IN (3, 4)) AS pages_errored, '' AS error_message, true AS has_errors FROM (SELECT 's' AS source_id, change FROM {_DIFF}) GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('t', 'incremental', 'running', 0, 0, 0, 0, 0, '', false), ('u', 'full', 'failed', 0, 0, 0, 0, 0, 'no disk', false))",
    "raw_documents_upsert": f"SELECT url, CASE WHEN k = 'new' THEN nh ELSE oh END AS content_hash, true AS page_fits, k || url AS raw_text, k AS title, 'raw-html/' || k || '/' || CASE WHEN k = 'new' THEN nh ELSE oh END AS s3_html_key, '{{\"crawl\":\"' || k || '\"}}' AS metadata_json, CASE WHEN change = 'new' THEN 'text/new' ELSE 'text/old' END AS content_type, CASE WHEN k = 'new' THEN 'pending' ELSE 'processed' END AS status FROM (SELECT *, CASE WHEN change IN ('new', 'modified') THEN 'new' ELSE 'old' END AS k FROM {_DIFF})",
    "archive_objects": "SELECT 'raw-html/site/2024-03-05/' || left(md5(url), 12) || '.html' AS key, '2024-03-05' AS day, sha256(html) AS sha256 FROM pages",
    "object_store_pages": f"SELECT key, strlen(c) AS n_bytes, sha256(c) AS sha256 FROM (SELECT 'raw-html/site/2024-03-05/' || left(md5(url), 12) || '.html' AS key, CASE WHEN page_id % 3 = 0 THEN html || '<!-- again -->' ELSE html END AS c FROM pages UNION ALL SELECT 'processed/site/2024-03-05/' || left(md5(url), 12) || '.txt', text FROM {_EXTRACTED})",
    "crawl_content": f"SELECT page_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM {_CRAWLED}",
    "crawl_repaired": f"SELECT page_id, {_unescaped("regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^[ \\n\\r\\t]+|[ \\n\\r\\t]+$', '', 'g')")} AS title, length(text) AS n_chars, sha256(text) AS text_sha256 FROM {_CRAWLED}",
    "page_rate_tables": f"SELECT page_id, 'n|link' AS headers, i - 1 AS position, CAST(i - 1 AS VARCHAR) AS n, {_unescaped('h')} AS link, 2 AS cells FROM (SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages))",
    "crawl_results_tax": f"SELECT page_id, url, sha256(html) AS content_hash, left(md5(url), 12) AS url_hash, CASE WHEN contains(lower({_PATH}), 'stamp-duty') THEN 'stamp_duty' WHEN contains(lower({_PATH}), 'property-tax') THEN 'property_tax' ELSE 'general' END AS section, 'false' AS has_rate_tables FROM {_CRAWLED}",
    "crawl_results_home": f"SELECT page_id, string_split(trim({_PATH}, '/'), '/')[-1] AS section, {_PATH} AS path FROM {_CRAWLED}",
    "validate_warnings": f"WITH {_CHECKED}, w AS (SELECT unnest(list_filter([CASE WHEN {_WORDS.format('own')} <> n THEN 'word_count' END, CASE WHEN turn = 2 THEN 'source_url' END, 'metadata', 'metadata.source_agency', CASE WHEN role NOT IN ('user', 'system') AND regexp_matches(s, '^[a-z]') THEN 'chunk_text' END, CASE WHEN role NOT IN ('user', 'system') AND NOT regexp_matches(s, '[.!?…\"'')\\]]+\\s*$') THEN 'chunk_text' END], lambda x: x IS NOT NULL)) AS field FROM done WHERE keep) SELECT field, count(*) AS n FROM w GROUP BY 1",
    "embed_batches": f"WITH RECURSIVE t AS (SELECT source, {_WORDS.format('text')} AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)), r AS (SELECT source, k, n AS held, 1 AS items, 0 AS batch FROM t WHERE k = 1 UNION ALL SELECT t.source, t.k, CASE WHEN held + n > 5000 OR items >= 20 THEN n ELSE held + n END, CASE WHEN held + n > 5000 OR items >= 20 THEN 1 ELSE items + 1 END, CASE WHEN held + n > 5000 OR items >= 20 THEN batch + 1 ELSE batch END FROM r JOIN t ON t.source = r.source AND t.k = r.k + 1) SELECT source, batch, count(*) AS items, sum(n) AS tokens FROM r JOIN t USING (source, k) GROUP BY ALL",
    "vector_metadata": _values("id, source_name, chunk_index, title, source_agency, topic_tags, n_property", [(1, "A", 0, "t", "X", "a|b", 0), (2, "B", 1, "", "", "", 0), (3, "C", 2, "", "", "", 1)]) + """ UNION ALL SELECT CAST(vec_id + 1000 AS INTEGER), 'L' || label, label, 'T' || vec_id, CASE WHEN label > 1 THEN 'X' ELSE '' END, CASE WHEN vec_id % 3 = 0 THEN 'a|' || label ELSE '' END, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END FROM embeddings""",
    "embedding_ids": "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'v-' || vec_id WHEN vec_id % 2 = 0 THEN 'old' END AS embedding_id FROM embeddings",
    "cosine_topk": _cosine(""),
    "filtered_topk": _cosine("WHERE label = 3"),
    "index_topk": _cosine(""),
    "index_filtered_topk": _cosine("WHERE label = 3"),
    "bm25_topk": f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked",
    "rrf_fusion": f"WITH {_BM25}, met AS (SELECT query_id, doc_id, count(*) AS n FROM tf JOIN asked USING (term) GROUP BY ALL), second AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS rank FROM met) WHERE rank <= 10), every AS (SELECT query_id, doc_id, rank FROM ranked UNION ALL SELECT query_id, doc_id, rank FROM second), f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM every GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "retrieval_quality": f"WITH {_BM25}, {_HOLDING}, got AS (SELECT query_id, count(*) AS returned, count(h.doc_id) AS hits FROM ranked r LEFT JOIN holding h USING (query_id, doc_id) GROUP BY 1), want AS (SELECT query_id, count(*) AS relevant FROM holding GROUP BY 1) SELECT query_id, coalesce(returned, 0) AS returned, coalesce(hits, 0) AS hits, coalesce(relevant, 0) AS relevant, coalesce(round(hits / returned, 6), 0) AS precision, coalesce(round(coalesce(hits, 0) / relevant, 6), 0) AS recall FROM (SELECT DISTINCT item_id AS query_id FROM benchmark) FULL JOIN got USING (query_id) FULL JOIN want USING (query_id)",
    "expansion_quality": rf"""WITH {_BM25}, {_FED}, {_HOLDING},
asked2 AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\x0b\f]+'), lambda x: x <> '')) AS term FROM fed),
bm2 AS (SELECT a.query_id, doc_id, round(sum(ln(1 + (n - s.df + 0.5) / (s.df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))), 9) AS score FROM every JOIN spread s USING (term) JOIN asked2 a USING (term) CROSS JOIN size GROUP BY ALL),
ranked2 AS (SELECT * FROM bm2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10),
want AS (SELECT query_id, count(*) AS relevant FROM holding GROUP BY 1),
one AS (SELECT query_id, count(*) AS hits FROM ranked JOIN holding USING (query_id, doc_id) GROUP BY 1),
two AS (SELECT query_id, count(*) AS hits FROM ranked2 JOIN holding USING (query_id, doc_id) GROUP BY 1)
SELECT item_id AS query_id, coalesce(round(coalesce(one.hits, 0) / relevant, 6), 0) AS plain, coalesce(round(coalesce(two.hits, 0) / relevant, 6), 0) AS fed
FROM benchmark LEFT JOIN want ON want.query_id = item_id LEFT JOIN one ON one.query_id = item_id LEFT JOIN two ON two.query_id = item_id""",
    "archive_keys": "SELECT page_id, 'raw-html/site/2024-03-05/' || left(md5(url), 12) || '.html' AS html_key, 'processed/site/2024-03-05/' || left(md5(url), 12) || '.txt' AS text_key FROM pages",
    "vector_archive": f"SELECT 'embeddings/2024-03-05/s-' || vec_id || '/embeddings.json' AS key, 'hashed' AS model, 'b' AS a, {_CHECKSUM.format('embedding')} AS checksum FROM embeddings",
    "linked_pdfs": _values("page_id, url, title", [(1, "http://h.example/a/doc.pdf", "doc"), (5, "http://h.example/x.PDF", "x.PDF")]) + """ UNION ALL SELECT min(page_id) + 1000, o || '/f' || n || '.pdf', 'f' || n FROM (SELECT page_id, page_id % 7 AS n, regexp_extract(url, '^[^:]+://[^/?#]*') AS o FROM pages WHERE page_id % 2 = 0) GROUP BY o, n""",
    "schema_violations": "SELECT 'value of status' AS rule, count(*) AS n FROM documents WHERE doc_id % 2 <> 0 UNION ALL SELECT r, count(*) FROM (SELECT source FROM documents GROUP BY 1 HAVING count(*) > 1) CROSS JOIN (VALUES ('unique id'), ('unique source_id, url')) v(r) GROUP BY r",
    "query_expansion": _values("query_id, text", [(1, "flat tax apartment duty unit"), (2, "nothing "), (3, "Flat apartment unit")]) + f" UNION ALL (WITH {_BM25}, {_FED} SELECT query_id + 1000, text FROM fed)",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
