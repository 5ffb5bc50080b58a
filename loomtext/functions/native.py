"""Column expressions that stay in the JVM. Patterns are Unicode-aware, as the rules expect."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.sources import rules as R

_C = str | Column


def col(x: _C) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: All that a Unicode-aware \\s matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: _C) -> Column:
    """Without white space at both ends, of any kind. Only the ends are looked at, where a pattern would try each place."""
    return F.btrim(col(x), F.lit(WHITE))


def tidy(x: _C) -> Column:
    """Runs of blanks and tabs to one blank, three or more newlines to two, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(col(x), r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n"))


def word_count(x: _C) -> Column:
    s = strip(F.coalesce(col(x), F.lit("")))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)\s+")))


def content_hash(html: _C, pdf: _C | None = None) -> Column:
    """sha256 of the page, or of the lower-case hex text of the PDF's bytes where there is a PDF."""
    own = F.sha2(col(html).cast("binary"), 256)
    return own if pdf is None else F.when(col(pdf).isNotNull(), F.sha2(F.lower(F.hex(col(pdf))).cast("binary"), 256)).otherwise(own)


def url_hash(url: _C) -> Column:
    return F.substring(F.md5(col(url).cast("binary")), 1, 12)


def pattern(alternatives: tuple[str, ...]) -> str:
    """Alternatives as whole words, in any case; one that ends in an asterisk may go on."""
    return "(?iU)" + "|".join(rf"\b{a[:-1]}" if a.endswith("*") else rf"\b{a}\b" for a in alternatives)


def _marks_of(alternative: str) -> list[str]:
    """The runs of letters that each match of an alternative has, in lower case; none if that isn't sure."""
    sure = re.sub(r"\((?:[^()])*\)|\[[^\]]*\]|\\.", " ", alternative.rstrip("*"))
    sure = re.sub(r"[A-Za-z](?=[?*{])", " ", sure)
    return [] if re.search(r"[|()]", sure) else sorted({run.lower() for run in re.findall("[A-Za-z]+", sure)})


def labels(text: Column, rules, default: tuple[str, ...] = ()) -> Column:
    """Sorted labels of the rules that match, or the default.

    A rule's pattern is only tried on a text that has all runs of letters which one of its alternatives needs. The other
    letters that count as s, i and k in any case are folded first, once for all rules.
    """
    fold = lambda t: F.lower(functools.reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), zip("\u017f\u0131\u0130\u212a", "siik", strict=True), t))

    def found(text: Column, low: Column) -> Column:
        tries = []
        for label, alternatives in sorted(rules):
            has = [functools.reduce(lambda a, b: a & b, [F.contains(low, F.lit(m)) for m in _marks_of(a)], F.lit(True)) for a in alternatives]
            may = functools.reduce(lambda a, b: a | b, has)
            tries.append(F.when(may & text.rlike(pattern(alternatives)), F.lit(label)))
        return F.regexp_replace(F.concat_ws("|", *tries), "^$", "|".join(default))

    return F.array_remove(F.split(once(text, lambda t: once(fold(t), lambda low: found(t, low))), r"\|"), "")


def keywords(text: Column, words: tuple[str, ...]) -> Column:
    """Those of words that occur, in their order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def effective_date(text: _C, rules=R.DATE_RULES) -> Column:
    """The first rule in order whose first match is a date, as yyyy-mm-dd; else the empty string."""
    t, tries = F.coalesce(col(text), F.lit("")), []
    for regex, kind in rules:
        part = lambda i, regex=regex: F.regexp_extract(t, "(?iU)" + regex, i)
        order = (1, 2, 3) if kind == "iso" else (3, 2, 1)
        y, m, d = (part(i) for i in order)
        if kind == "dmy":
            at = F.array_position(F.array(*map(F.lit, R.MONTHS.lower().split("|"))), F.lower(m))
            m = F.when(at > 0, at.cast("string"))
        day = F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        tries.append(F.when((y != "") & m.isNotNull() & (F.lpad(y, 4, "0") != "0000"), F.date_format(day, "yyyy-MM-dd")))
    return F.coalesce(*tries, F.lit(""))


def metadata_string(value: _C) -> Column:
    """A text of a file's metadata: bytes read as UTF-8, without byte order marks and white space at its beginning and end; null is empty."""
    return strip(F.regexp_replace(strip(F.coalesce(col(value).cast("string"), F.lit(""))), "^\ufeff+", ""))


def agency(source: _C, table: dict[str, str] = R.AGENCIES) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.coalesce(col(source), F.lit("")))), F.lit(""))


def section(headings: _C, title: _C) -> Column:
    """The first heading of level 1 or 2, else the title."""
    top = F.filter(col(headings), lambda h: h["level"] <= 2)
    return F.coalesce(F.try_element_at(top, F.lit(1))["text"], col(title))


def metadata(text: _C, headings: _C, title: _C, source: _C) -> Column:
    """All of a document's metadata as one struct, with warnings for what wasn't found."""
    t = F.coalesce(col(text), F.lit(""))
    said = F.concat(t, F.lit(" "), F.array_join(F.transform(col(headings), lambda h: h["text"]), " "))
    code = agency(source)
    return once(effective_date(t), lambda day: _metadata(col(title), col(source), code, section(headings, title), day, t, said))


def _metadata(title: Column, source: Column, code: Column, part: Column, day: Column, t: Column, said: Column) -> Column:
    warn = F.array_compact(F.array(F.when(code == "", F.concat(F.lit("Unknown source_name '"), F.coalesce(source, F.lit("")), F.lit("' — source_agency left empty"))), F.when(day == "", F.lit("No effective date found in document text"))))
    return F.struct(
        title.alias("title"), code.alias("source_agency"), part.alias("section"), day.alias("effective_date"), F.try_to_date(day, "yyyy-MM-dd").alias("effective_on"),
        labels(said, R.PROPERTY_RULES, ("all",)).alias("property_types"), labels(t, R.CITIZENSHIP_RULES, ("all",)).alias("citizenship_types"), labels(said, R.TOPIC_RULES).alias("topic_tags"), warn.alias("metadata_warnings"),
    )


def markdown(headers: _C, rows: _C, caption: _C) -> Column:
    """A table as Markdown; "" if it has nothing. Short rows are filled up, long ones stay long."""
    h, r, c = F.coalesce(col(headers), F.array().cast("array<string>")), F.coalesce(col(rows), F.array().cast("array<array<string>>")), F.coalesce(col(caption), F.lit(""))
    widest = F.coalesce(F.array_max(F.transform(r, lambda x: F.size(x))), F.lit(0))
    width = F.when(F.size(h) > 0, F.size(h)).otherwise(widest)
    heads = F.when(F.size(h) > 0, h).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: F.concat(F.lit("Col "), i.cast("string"))))
    safe = lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, safe), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    filled = F.transform(r, lambda x: line(F.concat(x, F.array_repeat(F.lit(""), F.greatest(width - F.size(x), F.lit(0))))))
    top = F.when(c != "", F.array(F.concat(F.lit("**Table: "), safe(c), F.lit("**")))).otherwise(F.array().cast("array<string>"))
    return F.when(width == 0, F.lit("")).otherwise(F.array_join(F.concat(top, F.array(line(heads), rule), filled), "\n"))


def clean_pdf_table(raw: _C) -> Column:
    """struct(headers, rows) of a raw table with null cells; null if no cell is filled. A single row is no header."""
    cells = F.transform(col(raw), lambda row: F.transform(row, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))))
    filled = F.exists(cells, lambda row: F.exists(row, lambda c: c != ""))
    one = F.size(cells) == 1
    none = F.array().cast("array<string>")
    return F.when(filled, F.struct(F.when(one, none).otherwise(F.get(cells, F.lit(0))).alias("headers"), F.when(one, cells).otherwise(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))).alias("rows")))


# --- URLs -----------------------------------------------------------------------------------------------------------
def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _without_dots(url: Column) -> Column:
    """url with "." and ".." parts of its path resolved in one fold, as far up as they go; ".." above the root is dropped."""
    split = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)(/[^?#]*)([?#].*)?$"
    none = F.array().cast("array<string>")
    up = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
    step = lambda kept, x: F.when(x == "..", up(kept)).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))

    def resolved(u: Column, path: Column) -> Column:
        head, tail = F.regexp_extract(u, split, 1), F.regexp_extract(u, split, 3)
        closed = lambda kept: F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
        return once(F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), none, step), lambda kept: F.concat(head, F.lit("/"), F.array_join(kept, "/"), closed(kept), tail))

    return once(url, lambda u: once(F.regexp_extract(u, split, 2), lambda path: F.when(path.rlike(r"/\.\.?(/|$)"), resolved(u, path)).otherwise(u)))


def absolute_url(href: _C, base: _C) -> Column:
    """href against an absolute base, by string rules: whole URLs, //host, /path, ?query, #fragment and relative paths."""

    def whole(h: Column, b: Column) -> Column:
        scheme, host = F.try_parse_url(b, F.lit("PROTOCOL")), F.try_parse_url(b, F.lit("AUTHORITY"))
        root = F.concat(scheme, F.lit("://"), host)
        path = F.coalesce(F.try_parse_url(b, F.lit("PATH")), F.lit(""))
        folder = F.concat(root, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", "")))
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(root, h))
            .when(h == "", b)
            .when(h.startswith("?"), F.concat(F.regexp_replace(b, r"[?#].*$", ""), h))
            .when(h.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), h))
            .otherwise(F.concat(folder, h))
        )

    return _without_dots(once(strip(F.coalesce(col(href), F.lit(""))), lambda h: whole(h, col(base))))


def normalize_url(url: _C) -> Column:
    """scheme://authority, path without closing slashes and parameters, and ?query; no fragment. Not for relative URLs."""
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?]*))?([^?]*)(\?.*)?$"

    def parts(u: Column) -> Column:
        part = lambda i: F.regexp_extract(u, whole, i)
        path = F.regexp_replace(F.regexp_replace(part(3), r";[^/]*$", ""), "/+$", "")
        query = once(part(4), lambda q: F.when(q == "?", F.lit("")).otherwise(q))
        return F.when(u.rlike(whole), F.concat(F.lower(part(1)), F.lit("://"), part(2), path, query)).otherwise(u)

    return once(F.regexp_replace(col(url), "#.*$", ""), parts)


def authority(url: _C) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: _C) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_asset(url: _C) -> Column:
    p = F.lower(url_path(url))
    return F.lit(False) if not R.ASSET_SUFFIXES else p.rlike("(" + "|".join(s.replace(".", r"\.") for s in R.ASSET_SUFFIXES) + ")$")


def follows(url: _C, rule: R.FollowRule) -> Column:
    """Whether a source's rule follows a link; assets never."""
    path = url_path(url)
    low = F.lower(path)
    skip = low.rlike("|".join(_quoted(s.lower()) for s in rule.skip))
    where, sections = (low, [s.lower() for s in rule.sections]) if rule.fold_path else (path, rule.sections)
    hit = where.rlike(("^" if rule.prefix else "") + "(" + "|".join(map(_quoted, sections)) + ")")
    if rule.pdf:
        hit = hit | low.endswith(".pdf")
    return ~skip & hit & ~is_asset(url)


def follows_of(url: _C, source: _C, rules: dict[str, R.FollowRule] = R.FOLLOW_RULES) -> Column:
    out = None
    for code, rule in rules.items():
        out = F.when(F.lower(col(source)) == code, follows(url, rule)) if out is None else out.when(F.lower(col(source)) == code, follows(url, rule))
    return F.coalesce(out, F.lit(False))


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r".-+*?()[]{}|^$\\" else c for c in s)


def content_kind(header: _C, url: _C, by_suffix: bool = True) -> Column:
    """pdf, html or null, from the content-type header and, for most sources, a .pdf suffix."""
    h = F.lower(F.coalesce(col(header), F.lit("")))
    pdf = F.contains(h, F.lit("application/pdf"))
    if by_suffix:
        pdf = pdf | F.lower(url_path(url)).endswith(".pdf")
    return F.when(pdf, "pdf").when(F.contains(h, F.lit("text/html")), "html")


def pdf_title(url: _C, keep_suffix: bool = False) -> Column:
    last = F.element_at(F.split(col(url), "/"), -1)
    return last if keep_suffix else F.replace(last, F.lit(".pdf"), F.lit(""))


def path_section(url: _C, how: str) -> Column:
    """second: the second part of the path or general; last: its last part; tax: by what the path speaks of."""
    path = url_path(url)
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    if how == "second":
        return F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.lit("general"))
    if how == "last":
        return F.element_at(parts, -1)
    low = F.lower(path)
    return F.when(F.contains(low, F.lit("stamp-duty")), "stamp_duty").when(F.contains(low, F.lit("property-tax")), "property_tax").otherwise("general")


def is_relevant(text: _C, title: _C, words: tuple[str, ...] = R.RELEVANCE_KEYWORDS) -> Column:
    any_of = lambda c: F.size(keywords(F.lower(F.coalesce(col(c), F.lit(""))), words)) > 0
    return any_of(text) | any_of(title)


def _marks(text: _C, rules: tuple[tuple[str, tuple[str, ...]], ...], default: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(col(text), F.lit("")))
    has = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p))
    found = F.array_compact(F.array(*[F.when(has(parts), F.lit(label)) for label, parts in rules]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, default)).cast("array<string>"))


def tax_types(text: _C) -> Column:
    return _marks(text, (("BSD", ("buyer", "bsd")), ("ABSD", ("additional", "absd")), ("SSD", ("seller", "ssd"))), ())


def home_property_types(text: _C) -> Column:
    return _marks(text, (("hdb", ("hdb",)), ("private", ("private", "condominium")), ("ec", ("executive condominium", " ec "))), ("all",))


def home_citizenship_types(text: _C) -> Column:
    return _marks(text, (("SC", ("singapore citizen",)), ("PR", ("permanent resident",))), ("all",))
