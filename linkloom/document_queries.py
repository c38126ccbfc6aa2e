"""Registered queries over generated documents and recorded requests, each with the SQL that says what must come out.

Documents of every format, their requests and their caches follow from a page's key, so that
SQL can state the rows.
"""

from __future__ import annotations

import io
import os
import zipfile
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as tx
from linkloom.functions import urls as ux
from linkloom.operators import cache as cx
from linkloom.operators import commit, extract, fixes, local, schedule
from linkloom.operators import verdicts as vx
from linkloom.operators.batches import made, numbers
from linkloom.plans import digest, frontier, judge, report
from linkloom.plans import scan as sx
from linkloom.queries import _pages, _pick, query, table
from linkloom.sources import files, listing
from linkloom.tables import Scratch, folder, mounted, remove

NOW = "2027-01-01"


def _k() -> Column:
    return F.col("page_id")


def _key() -> Column:
    return _k().cast("string")


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


# ---- documents by format

_OFFICE = "http://schemas.openxmlformats.org/"
_NS = {"w": _OFFICE + "wordprocessingml/2006/main", "s": _OFFICE + "spreadsheetml/2006/main", "p": _OFFICE + "presentationml/2006/main", "a": _OFFICE + "drawingml/2006/main", "r": _OFFICE + "officeDocument/2006/relationships"}


def _packed(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def _rels(*targets: tuple[str, str, bool]) -> str:
    each = "".join(f'<Relationship Id="{i}" Type="t" Target={quoteattr(t)}' + (' TargetMode="External"/>' if far else "/>") for i, t, far in targets)
    return f'<Relationships xmlns="{_OFFICE}package/2006/relationships">{each}</Relationships>'


def docx(k: int, url: str) -> bytes:
    field = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    body = [
        '<w:hyperlink r:id="one"/>',
        f'{field("begin")}<w:instrText>HYPERLINK "https://f.</w:instrText><w:instrText>test/{k}"</w:instrText>{field("end")}',
        f'<w:fldSimple w:instr="HYPERLINK &quot;https://s.test/{k}&quot;"/>',
        f'<w:instrText>HYPERLINK "https://i.test/{k}"</w:instrText>',
        f"<w:t>see HYPERLINK https://t.test/{k} now</w:t>",
        f"<w:t><![CDATA[HYPERLINK (https://c.test/{k})]]></w:t>",
        '<x:hyperlink xmlns:x="urn:other" r:id="one"/>',
    ]
    text = f'<w:document xmlns:w="{_NS["w"]}" xmlns:r="{_NS["r"]}">' + "".join(f"<w:p>{x}</w:p>" for x in body) + "</w:document>"
    return _packed({"word/document.xml": text, "word/_rels/document.xml.rels": _rels(("one", url, True)), "word/media/x.bin": "x"})


def xlsx(k: int, url: str) -> bytes:
    sheet = f'<worksheet xmlns="{_NS["s"]}" xmlns:r="{_NS["r"]}"><c r="B2"><f>HYPERLINK("https://f.test/{k}","x")</f></c><hyperlinks><hyperlink ref="A1" r:id="h"/></hyperlinks></worksheet>'
    return _packed({"xl/workbook.xml": f'<workbook xmlns="{_NS["s"]}" xmlns:r="{_NS["r"]}"><sheets><sheet name="Two" r:id="b"/><sheet name="One" r:id="a"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _rels(("a", "./worksheets/../worksheets/s.xml", False), ("b", "/xl/worksheets/t.xml", False)), "xl/worksheets/s.xml": sheet, "xl/worksheets/_rels/s.xml.rels": _rels(("h", url, True)), "xl/worksheets/t.xml": f'<worksheet xmlns="{_NS["s"]}"/>'})


def pptx(k: int, url: str) -> bytes:
    slide = f'<p:sld xmlns:p="{_NS["p"]}" xmlns:a="{_NS["a"]}" xmlns:r="{_NS["r"]}"><a:hlinkClick r:id="l"/></p:sld>'
    deck = f'<p:presentation xmlns:p="{_NS["p"]}" xmlns:r="{_NS["r"]}"><p:sldId r:id="b"/><p:sldId r:id="a"/></p:presentation>'
    return _packed({"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": _rels(("a", "slides/slide1.xml", False), ("b", "slides/slide2.xml", False)), "ppt/slides/slide1.xml": slide, "ppt/slides/slide2.xml": slide, "ppt/slides/_rels/slide1.xml.rels": _rels(("l", url, True)), "ppt/slides/_rels/slide2.xml.rels": _rels(("l", f"https://two.test/{k}", True))})


def pdf(k: int, url: str, more: str = "", annotation: str = "4 0 R 6 0 R 8 0 R") -> bytes:
    """Two pages, the second one's object first; an action beside its annotation, one in UTF-16, one that goes elsewhere."""
    text = f"BT (see https://t.test/{k}.) Tj ET"
    wide = ("﻿" + f"https://u.test/{k}").encode("utf-16-be").hex()
    objects = [
        "<</Type /Catalog /Pages 2 0 R" + more + ">>", "<</Type /Pages /Kids [9 0 R 3 0 R] /Count 2>>",
        f"<</Type /Page /Parent 2 0 R /Annots [{annotation}]>>", "<</Type /Annot /Subtype /Link /A 5 0 R>>", f"<</S /URI /URI ({url})>>",
        f"<</Type /Annot /Subtype /Link /A <</S /URI /URI <{wide}>>> >>", "<</X 1>>", "<</Type /Annot /Subtype /Link /A <</S /GoTo /D (https://no.test)>> >>",
        "<</Type /Page /Parent 2 0 R /Contents 10 0 R>>", f"<</Length {len(text)}>>\nstream\n{text}\nendstream",
    ]
    out, places = "%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n{body}\nendobj\n"
    at = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n" + "".join(f"{p:010d} 00000 n \n" for p in places)
    return (out + f"trailer\n<</Size {len(objects) + 1} /Root 1 0 R>>\nstartxref\n{at}\n%%EOF\n").encode()


DOCUMENT = pa.schema([("path", pa.string()), ("format", pa.string()), ("content", pa.binary())])
BUILT = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "pdf": pdf}


def _built(spark, sf_dir, kind: str, url: str = "https://a.test/?x=1&y=") -> DataFrame:
    """A document of one kind for every page."""

    def make(batches):
        for keys in numbers(batches):
            yield made([(f"{k}.{kind}", kind, BUILT[kind](k, f"{url}{k}")) for k in keys], DOCUMENT)

    return _pages(spark, sf_dir).select("page_id").mapInArrow(make, "path string, format string, content binary")


def _written(spark, sf_dir, kind: str, body: Column) -> DataFrame:
    return _pages(spark, sf_dir).select(_text(_key(), "." + kind).alias("path"), F.lit(kind).alias("format"), F.encode(body, "utf-8").alias("content"))


def _expect(kind: str, rows: list[tuple], names: tuple) -> str:
    """SQL of fixed rows for every page; {k}: its key."""
    lit = lambda v: "NULL::BIGINT" if v is None else str(v) + "::BIGINT" if isinstance(v, int) else "replace('" + v.replace("'", "''") + "', '{k}', page_id::VARCHAR)"
    return " UNION ALL ".join("SELECT page_id || '." + kind + "' AS path, " + ", ".join(f'{lit(v)} AS "{n}"' for v, n in zip(r, names)) + " FROM pages" for r in rows)


_A = "https://a.test/?x=1&y={k}"


@query(_expect("docx", [(_A, 1), ("https://f.test/{k}", 2), ("https://s.test/{k}", 3), ("https://i.test/{k}", 4), ("https://t.test/{k}", 5), ("https://c.test/{k}", 6)], ("url", "paragraph")))
def docx_links(spark, sf_dir):
    """By relation, in complex and simple fields, in instructions and text outside fields; names of other namespaces are no links."""
    return extract.links(_built(spark, sf_dir, "docx")).select("path", "url", "location.paragraph")


@query(_expect("xlsx", [(_A, "One", "A1"), ("https://f.test/{k}", "One", "B2")], ("url", "sheet", "cell")))
def xlsx_links(spark, sf_dir):
    return extract.links(_built(spark, sf_dir, "xlsx")).select("path", "url", "location.sheet", "location.cell")


@query(_expect("pptx", [("https://two.test/{k}", 1), (_A, 2)], ("url", "slide")))
def pptx_links(spark, sf_dir):
    """Slides by the presentation's order."""
    return extract.links(_built(spark, sf_dir, "pptx")).select("path", "url", "location.slide")


@query(_expect("pdf", [("https://t.test/{k}", 1, None), (_A, 2, 0), ("https://u.test/{k}", 2, 1)], ("url", "page", "annotation")))
def pdf_links(spark, sf_dir):
    """Annotations with an action beside them or inside, and URLs in text; pages by the tree's order."""
    return extract.links(_built(spark, sf_dir, "pdf")).select("path", "url", "location.page", "location.annotation")


_MARKDOWN = [
    ("[a](<https://a.test/{k}?x y> 't') and ![i](/img/{k}.png)\n", [("https://a.test/{k}?x y", 1), ("/img/{k}.png", 1)]),
    ("<https://auto.test/{k}> <me{k}@x.test> [b](https://b.test/\\(x\\)/{k}) [c](https://c.test/(y)/{k})\n", [("https://auto.test/{k}", 2), ("mailto:me{k}@x.test", 2), ("https://b.test/(x)/{k}", 2), ("https://c.test/(y)/{k}", 2)]),
    ("[D][ß] [d] [D][ß] `https://code.test` [ftp](ftp://no.test)\n", []),
    ("\n    https://indented.test/{k}\n\n", []),
    ("- item\n\n    https://item.test/{k}\n\n", [("https://item.test/{k}", 9)]),
    ("[SS]: https://d.test/{k}?q&amp;r \"https://title.test\"\n[d]: /d/{k}\n\n", [("https://d.test/{k}?q&r", 11), ("/d/{k}", 12)]),
    ("```\nhttps://fence.test\n```\nhttps://bare.test/{k}.\n", [("https://bare.test/{k}", 17)]),
]


def _filled(body: str) -> Column:
    """A text with every {k} replaced by the page's key."""
    return F.replace(F.lit(body), F.lit("{k}"), _key())


@query(_expect("markdown", [r for _, rows in _MARKDOWN for r in rows], ("url", "line")))
def markdown_forms(spark, sf_dir):
    """All forms of links, and what is none: code, titles, used definitions, other schemes."""
    return extract.links(_written(spark, sf_dir, "markdown", _filled("".join(x for x, _ in _MARKDOWN)))).select("path", "url", "location.line")


_HTML = "<!doctype html><A HREF='https://a.test/?x=1&amp;y={k}'>t</A>\n<a href=https://q.test/{k}\"c>u</a><img src=/i/{k}.png><link href=\"/c.css?{k}\"><script src=s{k}.js>'<a href=\"/no\">'</script>\n<a name=no>http://plain.test</a><a data-x='<a href=/no>' href=\"#f{k}\"><a href=javascript:x><!-- <a href=\"/hidden\">"


@query(_expect("html", [("https://a.test/?x=1&y={k}", 1), ("https://q.test/{k}\"c", 2), ("/i/{k}.png", 2), ("/c.css?{k}", 2), ("s{k}.js", 2), ("#f{k}", 3)], ("url", "line")))
def html_forms(spark, sf_dir):
    """Quoted, unquoted and empty attributes, entities, raw text, an unclosed comment."""
    return extract.links(_written(spark, sf_dir, "html", _filled(_HTML))).select("path", "url", "location.line")


@query("SELECT page_id || '.markdown' AS path, unnest(['notes', 'notes-1', 'notes-2', 'über-uns-' || page_id, 'own' || page_id]) AS anchor FROM pages UNION ALL SELECT page_id || '.html', unnest(['i' || page_id, 'n' || page_id]) FROM pages")
def document_anchors(spark, sf_dir):
    """Slugs of headings, made different, and ids; ids and names of anchors in HTML."""
    m = _written(spark, sf_dir, "markdown", _filled("# Notes\n\nNotes 1\n---\n\n```\n# no\n```\n## Notes ##\n### Über *uns* {k}!\n<b id=own{k}>x</b>\n"))
    h = _written(spark, sf_dir, "html", _filled("<p id=i{k}><a name='n{k}'>x</a><b name=no>"))
    return extract.read(m.unionByName(h)).filter("anchor is not null").select("path", "anchor")


@query("SELECT format, n_docs, n_links, median FROM (SELECT unnest([{'format': 'docx', 'per': 6}, {'format': 'xlsx', 'per': 2}, {'format': 'pptx', 'per': 2}, {'format': 'pdf', 'per': 3}]) AS f, (SELECT count(*) FROM pages) AS n), LATERAL (SELECT f.format AS format, n AS n_docs, n * f.per AS n_links, f.per::DOUBLE AS median)")
def links_by_format(spark, sf_dir):
    """Documents, links, and the median of links a document, by format."""
    docs = None
    for kind in BUILT:
        one = _built(spark, sf_dir, kind)
        docs = one if docs is None else docs.unionByName(one)
    each = extract.links(docs).groupBy("format", "path").agg(F.count("*").alias("n"))
    return each.groupBy("format").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_links"), F.percentile("n", 0.5).alias("median"))


# ---- local links

_LOCAL = [
    ("./{k}.md", None, None), ("../img/{k}.png", None, None), ("../img/none.png", "local-missing", "resolved path does not exist: docs/guide/../img/none.png"), ("../img", None, None),
    ("../img#top", "local-missing", "anchors cannot be checked in directory: docs/guide/../img"), ("{k}.md#here", None, None), ("{k}.md#gone", "local-missing", "anchor not found: #gone in docs/guide/{k}.md"),
    ("%FF.md", "syntax-invalid", "invalid percent escape in path: invalid UTF-8"), ("{k}.md#%2", "syntax-invalid", "invalid percent escape in fragment: incomplete escape"), ("%zz", "syntax-invalid", "invalid percent escape in path: non-hexadecimal escape"),
    ("?q=1", None, None), ("/docs/none", "local-missing", "resolved path does not exist: /docs/none"), ("caf%C3%A9+.md", "local-missing", "resolved path does not exist: docs/guide/café+.md"), ("../../docs/./guide//{k}.md?x#here", None, None), ("#here", None, None), ("{k}.md#", "local-missing", "anchor not found: # in docs/guide/{k}.md"), ("../img/{k}.png#any", None, None),
]


def _cases(rows: list[tuple], columns: int) -> str:
    """SQL list of structs, a case each."""
    lit = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    return "[" + ", ".join("{" + ", ".join(f"'c{i}': {lit(r[i])}" for i in range(columns)) + "}" for r in rows) + "]"


@query(f"SELECT 'docs/guide/' || page_id || '.md' AS path, replace(c.c0, '{{k}}', page_id::VARCHAR) AS url, c.c1 AS reason, replace(c.c2, '{{k}}', page_id::VARCHAR) AS detail FROM (SELECT page_id, {_cases(_LOCAL, 3)}[(page_id % {len(_LOCAL)})::INT + 1] AS c FROM pages) WHERE c.c1 IS NOT NULL")
def local_relative(spark, sf_dir):
    """Dotted, encoded, rooted and empty paths; folders; anchors of documents that have some."""
    p = _pages(spark, sf_dir)
    path = _text("docs/guide/", _key(), ".md")
    links = p.select(path.alias("path"), F.replace(_pick([x[0] for x in _LOCAL], _k()), F.lit("{k}"), _key()).alias("url"))
    there = p.select(F.explode(F.array(path, _text("docs/img/", _key(), ".png"))).alias("path"))
    anchors = p.select(path.alias("path"), F.explode(F.array(F.lit(None).cast("string"), F.lit("here"))).alias("anchor"))
    return local.missing(links, there, anchors)


_ESCAPED = [("a%20b+", "a b+", None), ("%2", None, "incomplete escape"), ("x%", None, "incomplete escape"), ("%é", None, "non-hexadecimal escape"), ("%FF", None, "invalid UTF-8"), ("%c3%A9%zz%2", None, "non-hexadecimal escape"), ("%C3%a9ü", "éü", None), ("%25%32%35", "%25", None), ("", "", None), ("plain", "plain", None)]


@query(f"SELECT page_id, c.c1 AS value, c.c2 AS error FROM (SELECT page_id, {_cases(_ESCAPED, 3)}[(page_id % {len(_ESCAPED)})::INT + 1] AS c FROM pages)")
def percent_decoding(spark, sf_dir):
    x = tx.percent_decoded(_pick([x[0] for x in _ESCAPED], _k()))
    return _pages(spark, sf_dir).select("page_id", x["value"].alias("value"), x["error"].alias("error"))


_PLAIN = [("/a/./b/../c", "/a/c"), ("a//b/", "a/b"), ("../x", "../x"), ("/../x", "/x"), ("a/../../x", "../x"), (".", ""), ("/", "/"), ("./a/.b/..c", "a/.b/..c")]


@query(f"SELECT page_id, c.c1 AS path FROM (SELECT page_id, {_cases(_PLAIN, 2)}[(page_id % {len(_PLAIN)})::INT + 1] AS c FROM pages)")
def plain_paths(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", local.plain(_pick([x[0] for x in _PLAIN], _k())).alias("path"))


_WALK = [("docs/a/{k}.md", True), ("docs/a/{k}.txt", False), ("docs/draft/{k}.md", False), ("{k}.md", True), ("docs/a/b/c/{k}.html", True), ("src/{k}.HTML", False)]


@query(f"SELECT replace(c.c0, '{{k}}', (page_id // 2)::VARCHAR) AS path FROM (SELECT page_id, unnest({_cases(_WALK, 2)}) AS c FROM pages) WHERE c.c1 = 'True' GROUP BY 1 UNION ALL SELECT 'src/named.HTML'")
def walk_selection(spark, sf_dir):
    """Paths by include and exclude globs, one named file that bypasses them, each once."""
    every = _pages(spark, sf_dir).select(F.explode(F.array(*(F.replace(F.lit(p), F.lit("{k}"), F.floor(_k() / 2).cast("string")) for p, _ in _WALK))).alias("path"))
    chosen = every.filter(files.selected(F.col("path"), ["*.md", "docs/**/*.html"], ["draft/*.md", "**/draft/**"]))
    return chosen.unionByName(spark.createDataFrame([("src/named.HTML",)], "path string")).distinct()


@query("""SELECT CASE page_id % 4 WHEN 3 THEN 'd' || page_id % 5 || '/e f/' ELSE 'd' || page_id % 5 || '/' END || page_id || c.c0 AS path, strlen(url) AS length FROM (SELECT page_id, url, [{'c0': '.md'}, {'c0': '.txt'}, {'c0': '.log'}][(page_id % 3)::INT + 1] AS c FROM pages)
WHERE c.c0 <> '.log' AND NOT (page_id % 5 = 2 AND c.c0 = '.txt' AND page_id % 7 <> 1) AND NOT (page_id % 5 = 4 AND page_id % 4 = 3)""")
def tree_listing(spark, sf_dir):
    """Pages written as files of a tree, with ignore files that hold below them, one of which takes names back in; listed by tasks."""
    at = mounted(folder(spark, "tree"))
    own = f"{at}/"
    rows = _pages(spark, sf_dir).select("page_id", "url", F.concat(F.lit("d"), (_k() % 5).cast("string"), F.lit("/"), F.when(_k() % 4 == 3, "e f/").otherwise(""), _key(), _pick([".md", ".txt", ".log"], _k())).alias("name"))

    def write(batches):
        for pdf in batches:
            for url, name in zip(pdf["url"], pdf["name"]):
                os.makedirs(os.path.dirname(own + name), exist_ok=True)
                with open(own + name, "w") as f:
                    f.write(url)
            yield pdf[["name"]]

    names = rows.mapInPandas(write, "name string").count()
    files_ = {".ignore": "*.log\n", "d2/.ignore": "*.txt\n" + "".join(f"!{k}.txt\n" for k in range(1, 7 * names, 7)), "d4/.ignore": "/e f/\n", "d4/.git/config": "x"}
    for name, text in files_.items():
        os.makedirs(os.path.dirname(own + name) or own, exist_ok=True)
        with open(own + name, "w") as f:
            f.write(text)
    kept = Scratch(spark)
    out = kept.keep(kept.settle(listing.listed(spark, [at], exclude=[".ignore"]).select(F.substring("path", len(own) + 1, 1 << 20).alias("path"), "length"), "listed"))
    remove(spark, at)
    return out


# ---- requests and verdicts

_H = "https://h.test/a/{k}"
_OLD = "Wed, 01 Jan 2020 00:00:00 GMT"
#: Case, URL, request, attempt, hops, status, final URL, termination, error kind, message, Last-Modified, body.
_SEEN = [
    (0, _H, "HEAD", 0, [], 200, _H, None, None, None, None, None), (0, _H, "GET", 0, [], 200, _H, None, None, None, None, "fine"),
    (1, _H, "HEAD", 0, [], 404, _H, None, None, None, None, None),
    (2, _H, "HEAD", 0, [], 405, _H, None, None, None, None, None), (2, _H, "GET", 0, [], 200, _H, None, None, None, None, "fine"),
    (3, _H, "HEAD", 0, [], 403, _H, None, None, None, None, None), (3, _H, "GET", 0, [], 403, _H, None, None, None, None, None), (3, _H, "COOKIE", 0, [], 200, _H, None, None, None, None, None),
    (4, _H, "HEAD", 0, [], 401, _H, None, None, None, None, None), (4, _H, "COOKIE", 0, [(302, "https://sso.h.test/x")], 200, "https://sso.h.test/x", None, None, None, None, None),
    (5, _H, "HEAD", 0, [], 401, _H, None, None, None, None, None), (5, _H, "COOKIE", 0, [], 403, _H, None, None, None, None, None),
    (6, _H, "HEAD", 0, [], None, _H, None, "timeout", "slow", None, None),
    (7, _H, "HEAD", 0, [], None, _H, None, "other", "TLS handshake", None, None),
    (8, _H, "HEAD", 0, [], None, _H, "redirect loop detected", None, None, None, None),
    (9, _H, "HEAD", 0, [], 200, _H, None, None, None, None, None), (9, _H, "GET", 0, [(301, "https://n.test/"), (308, "https://n.test/{k}")], 200, "https://n.test/{k}", None, None, None, None, "x"),
    (10, _H, "HEAD", 0, [], 200, _H, None, None, None, None, None), (10, _H, "GET", 0, [(302, "https://h.test/Login?x")], 200, "https://h.test/Login?x", None, None, None, None, "x"), (10, _H, "COOKIE", 0, [], None, _H, None, "dns", "gone", None, None),
    (11, _H, "HEAD", 0, [], 200, _H, None, None, None, None, None), (11, _H, "GET", 0, [(302, "https://h.test/b")], 200, "https://h.test/b", None, None, None, _OLD, "x"),
    (12, _H, "HEAD", 0, [], 200, _H, None, None, None, None, None), (12, _H, "GET", 0, [], 200, _H, None, None, None, "not a date", "Note: this page HAS BEEN superseded"),
    (13, "https://h.test/v1/{k}", "HEAD", 0, [], 200, "https://h.test/v1/{k}", None, None, None, None, None), (13, "https://h.test/v1/{k}", "GET", 0, [], 200, "https://h.test/v1/{k}", None, None, None, None, "x"), (13, "https://h.test/v2/{k}", "GET", 0, [], 200, "https://h.test/v2/{k}", None, None, None, None, "y"),
    (14, _H, "HEAD", 0, [], 200, _H, None, None, None, None, None), (14, _H, "GET", 0, [], 200, _H, None, None, None, None, "One two three, FOUR"), (14, _H, "BESIDE", 0, [], 200, _H, None, None, None, None, "four three two one"),
    (15, _H, "HEAD", 0, [], 503, _H, None, None, None, None, None), (15, _H, "HEAD", 1, [], 200, _H, None, None, None, None, None), (15, _H, "GET", 0, [], 500, _H, None, None, None, _OLD, "has been superseded"),
    (16, _H, "HEAD", 0, [], 200, _H, None, None, None, None, None), (16, _H, "GET", 0, [], None, _H, None, "tls", "x", None, None),
    (17, "https://github.com/{k}", "HEAD", 0, [], 429, "https://github.com/{k}", None, None, None, None, None), (17, "https://github.com/{k}", "COOKIE", 0, [], None, "", "redirect limit exhausted", None, None, None, None),
    (18, _H, "HEAD", 0, [], 200, _H, None, None, None, None, None), (18, _H, "GET", 0, [], 200, _H, None, None, None, None, "One two three, FOUR"), (18, _H, "BESIDE", 0, [], 200, _H, None, None, None, None, "four three two one five"),
]
_CASES = 19
#: Case -> confidence, reason, detail, kind of evidence, evidence, tier; others are clean.
_JUDGED = {
    1: ("dead-certain", "http-status", "404", "status", "404", 1), 4: ("auth-walled", "login-wall", None, "cookie-redirect-chain", "https://sso.h.test/x", 2), 5: ("auth-walled", "http-status", "403", "cookie-status", "403", 2),
    6: ("likely-dead", "network-error", "timeout", "status", "slow", 1), 7: ("likely-dead", "network-error", "tls", "status", "TLS handshake", 1), 8: ("likely-dead", "network-error", "other", "redirect-traversal", "redirect loop detected", 1),
    9: ("outdated", "permanent-redirect", None, "redirect-target", "https://n.test/{k}", 1), 10: ("auth-walled", "login-wall", None, "redirect-chain", _H + " -> https://h.test/Login?x", 1), 11: ("suspect", "far-past", None, "last-modified", "Wed, 1 Jan 2020 00:00:00 +0000", 1),
    12: ("outdated", "staleness-banner", None, "staleness-phrase", "has been superseded", 1), 13: ("outdated", "version-drift", None, "version-upgrade", "https://h.test/v2/{k}", 1), 14: ("likely-dead", "soft-404", None, "sibling-similarity", " (1.00)", 1), 17: ("suspect", "http-status", "310", "cookie-status", "310", 2),
}


def _observed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(urls, observations) of all pages: the cases in turn, by a join with their short list."""
    schema = "m int, url string, method string, attempt int, hops array<struct<status:int,url:string>>, status int, final_url string, termination string, error_kind string, error_message string, last_modified string, body string"
    cases = F.broadcast(spark.createDataFrame(_SEEN, schema))
    rows = _pages(spark, sf_dir).select("page_id", (_k() % _CASES).cast("int").alias("m")).join(cases, "m")
    fill = lambda c: F.replace(c, F.lit("{k}"), _key())
    rows = rows.withColumns({"url": fill(F.col("url")), "final_url": fill(F.col("final_url")), "hops": F.transform("hops", lambda h: F.struct(h["status"].alias("status"), fill(h["url"]).alias("url")))})
    urls = rows.filter("method = 'HEAD'").select("page_id", "url").distinct()
    beside = F.col("method") == "BESIDE"
    seen = rows.withColumn("url", F.when(beside, ux.sibling(F.col("url"))).otherwise(F.col("url"))).withColumn("method", F.when(beside, "GET").otherwise(F.col("method"))).drop("m", "page_id")
    return urls, seen


def _case(i: int) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "replace('" + v + "', '{k}', page_id::VARCHAR)"
    return f"CASE page_id % {_CASES} " + " ".join(f"WHEN {m} THEN {lit(x[i])}" for m, x in _JUDGED.items()) + " END"


@query(f"SELECT page_id, {_case(0)} AS confidence, {_case(1)} AS reason, {_case(2)} AS detail, {_case(3)} AS evidence_kind, {_case(4)} AS evidence, {_case(5)} AS tier FROM pages")
def judged_urls(spark, sf_dir):
    """Verdicts of every rule and the cookie tier, from recorded requests."""
    urls, seen = _observed(spark, sf_dir)
    out = judge.judged(urls, seen, F.lit(NOW).cast("timestamp")).join(urls, "url")
    v = F.col("verdict")
    first = F.get(v["evidence"], F.lit(0))
    shown = F.when(first["kind"] == "sibling-similarity", F.right(first["detail"], F.lit(7))).otherwise(first["detail"])
    return out.select("page_id", v["confidence"].alias("confidence"), v["reason"]["kind"].alias("reason"), v["reason"]["detail"].alias("detail"), first["kind"].alias("evidence_kind"), shown.alias("evidence"), v["tier"].alias("tier"))


#: Case -> the waves that ask for something.
_ASKED = {
    **dict.fromkeys((1, 6, 7, 8), ("head",)), **dict.fromkeys((0, 2, 14, 18), ("head", "get", "sibling")), **dict.fromkeys((9, 11, 12, 15, 16), ("head", "get")),
    3: ("head", "get", "cookie"), 4: ("head", "cookie"), 5: ("head", "cookie"), 17: ("head", "cookie"), 10: ("head", "get", "cookie"), 13: ("head", "get", "version"),
}
_BASE = {13: "https://h.test/v1/", 17: "https://github.com/"}
_FIT = "page_id % 7 <> 3 AND page_id % 19 <> 5 AND NOT (page_id % 5 = 1 AND page_id % 10 <> 6)"


def _frontier_sql() -> str:
    rows = ", ".join(f"({m}, '{w}', '{_BASE.get(m, 'https://h.test/a/') if w != 'version' else 'https://h.test/v2/'}', '{dict(head='HEAD', cookie='COOKIE').get(w, 'GET')}')" for m, waves in _ASKED.items() for w in waves)
    return f"""SELECT wave, CASE WHEN wave = 'sibling' THEN base || 'missing-' ELSE base || page_id END AS url, method, page_id FROM pages JOIN (VALUES {rows}) t(m, wave, base, method) ON page_id % {_CASES} = m WHERE {_FIT}"""


@query(_frontier_sql())
def request_frontier(spark, sf_dir):
    """The requests of every wave: links of three kinds are left out (a pattern, a domain, a fresh cache), the others asked until a rule settles them."""
    urls, world = _observed(spark, sf_dir)
    k = F.col("page_id")
    marked = F.when(k % 7 == 3, F.concat("url", F.lit("?skip"))).when(k % 19 == 5, F.concat(F.lit("https://a.skip.test/"), k.cast("string"))).otherwise(F.col("url"))
    urls = urls.withColumn("url", marked)
    said = F.to_json(vx.verdict("http-status", F.lit("404"), "status", F.lit("404"), 1))
    now = F.unix_timestamp(F.lit(NOW).cast("timestamp"))
    cached = urls.filter(k % 5 == 1).select("url", F.when(k % 2 == 0, said).alias("verdict_json"), F.when(k % 10 == 6, now - 99).otherwise(now).alias("checked_at"), F.lit(2).alias("tier"))
    limits = frontier.Limits(("[?]skip$",), ("skip.test",), cached, 50)
    own = Scratch(spark)
    _, asked = frontier.observed(urls, lambda wanted: world.join(wanted.select("url", "method"), ["url", "method"], "left_semi"), own, limits, now=F.lit(NOW).cast("timestamp"), cookies=True)
    names = urls.select("page_id", "url", ux.sibling(F.col("url")).alias("beside"), ux.version_upgrade(F.col("url")).alias("up"))
    names = names.select("page_id", F.explode(F.array(F.struct("url"), F.struct(F.col("beside").alias("url")), F.struct(F.col("up").alias("url")))).alias("x")).select("page_id", "x.url")
    return asked.join(names, "url").select("wave", F.regexp_replace("url", "missing-[0-9a-f]+$", "missing-").alias("url"), "method", "page_id")


@query("""WITH RECURSIVE r AS (SELECT 'h' || o_custkey % 61 AS host, o_orderkey AS k, 20 + o_orderkey * 37 % 400 AS took, row_number() OVER (PARTITION BY o_custkey % 61 ORDER BY o_orderkey) AS n FROM orders),
w AS (SELECT host, 0::BIGINT AS n, [0, 0, 0, 0]::BIGINT[] AS ends, NULL::BIGINT AS k, NULL::BIGINT AS began, NULL::BIGINT AS slot FROM (SELECT DISTINCT host FROM r) UNION ALL
SELECT w.host, w.n + 1, list_transform(w.ends, lambda e, i: CASE WHEN i = list_position(w.ends, list_min(w.ends)) THEN e + r.took ELSE e END), r.k, list_min(w.ends), list_position(w.ends, list_min(w.ends)) - 1 FROM w JOIN r ON r.host = w.host AND r.n = w.n + 1)
SELECT host, k AS o_orderkey, slot::INT AS slot, began AS start_ms FROM w WHERE k IS NOT NULL""")
def host_schedule(spark, sf_dir):
    """Orders as requests of 61 hosts, with durations by key: four of a host at a time, the others as soon as one ends."""
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(F.concat(F.lit("h"), (F.col("o_custkey") % 61).cast("string")).alias("host"), "o_orderkey", (20 + k * 37 % 400).alias("took_ms"))
    return schedule.planned(asked, order="o_orderkey").select("host", "o_orderkey", "slot", "start_ms")


@query("""WITH r AS (SELECT o_custkey AS c, max(o_orderkey) FILTER (o_orderkey % 3 <> 0) AS a, max(o_orderkey) FILTER (o_orderkey % 3 = 0 AND o_custkey % 4 = 0) AS b, max(o_custkey % 10) = 5 AND count(*) FILTER (o_orderkey % 3 = 0 AND o_custkey % 4 = 0) = 0 AS gone FROM orders GROUP BY 1)
SELECT 'https://h.test/' || c AS url, greatest(coalesce(a, b), coalesce(b, a)) AS checked_at FROM r WHERE coalesce(a, b) IS NOT NULL AND NOT gone""")
def cache_updates(spark, sf_dir):
    """Customers' orders as verdicts in a cache on disk, by two updates of its buckets; the second also takes URLs out."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(_text("https://h.test/", F.col("o_custkey").cast("string")).alias("url"), F.lit(None).cast("string").alias("verdict_json"), F.col("o_orderkey").alias("checked_at"), F.lit(1).alias("tier"), "o_custkey")
    none = rows.limit(0).drop("o_custkey")
    at = folder(spark, "cache")
    cx.update(cx.upsert(none, rows.filter("checked_at % 3 <> 0").drop("o_custkey")), at)
    cx.update(cx.upsert(none, rows.filter("checked_at % 3 = 0 AND o_custkey % 4 = 0").drop("o_custkey")), at, rows.filter("o_custkey % 10 = 5").select("url"))
    kept = Scratch(spark)
    out = kept.keep(kept.settle(cx.load(spark, at).select("url", "checked_at"), "cached"))
    remove(spark, at)
    return out


_PAGE = [(404, "https://h.test/", "x", "http-status", "cookie-status"), (200, "https://h.test/signin", "x", "login-wall", "browser-page"), (200, "https://h.test/", "a CAPTCHA", "login-wall", "browser-page"), (200, "https://h.test/", "Sign in <input type='password'>", "login-wall", "browser-page"), (200, "https://h.test/", "Sign in here", None, None), (204, "https://h.test/", "", None, None)]


@query(f"SELECT page_id, c.c3 AS reason, c.c4 AS evidence FROM (SELECT page_id, {_cases(_PAGE, 5)}[(page_id % {len(_PAGE)})::INT + 1] AS c FROM pages)")
def browser_pages(spark, sf_dir):
    """What a browser's page says."""
    o = F.struct(_pick([x[0] for x in _PAGE], _k()).alias("status"), _pick([x[1] for x in _PAGE], _k()).alias("final_url"), vx.page_signs(_pick([x[2] for x in _PAGE], _k())).alias("walled"))
    v = vx.by_page(o)
    return _pages(spark, sf_dir).select("page_id", v["reason"]["kind"].alias("reason"), F.get(v["evidence"], F.lit(0))["kind"].alias("evidence"))


_AFTER = [("7", 7), ("0", 0), ("99", 30), ("Fri, 01 Jan 2027 00:00:09 GMT", 9), ("Fri, 01 Jan 2027 00:10:00 GMT", 30), ("Thu, 31 Dec 2026 00:00:00 GMT", None), ("Fri, 1 Jan 2027 02:00:07 +0200", 7), ("1 Jan 2027 00:00:05 GMT", 5), ("Friday, 1 Jan 2027 00:00:40 +0000", 30), ("soon", None), (None, None)]


@query(f"SELECT page_id, c.c1::BIGINT AS seconds FROM (SELECT page_id, {_cases(_AFTER, 2)}[(page_id % {len(_AFTER)})::INT + 1] AS c FROM pages)")
def retry_after(spark, sf_dir):
    """Seconds or a date; past dates say nothing, 30 at most."""
    return _pages(spark, sf_dir).select("page_id", vx.retry_after_s(_pick([x[0] for x in _AFTER], _k()), F.lit(NOW).cast("timestamp")).alias("seconds"))


_B = "https://h.test/b/c/d;p?q"
_JOINED = [
    ("https://h.test/a/b?q", "../c", "https://h.test/c"), ("https://h.test/a/b", "//o.test/x", "https://o.test/x"), ("https://h.test/a/b", "?n", "https://h.test/a/b?n"), ("https://h.test/a/", "/r#f", "https://h.test/r#f"), ("https://h.test", "x", "https://h.test/x"),
    (_B, "http://o.test/a/../b?x#y", "http://o.test/b?x#y"), (_B, "mailto:a@b", "mailto:a@b"), (_B, "g", "https://h.test/b/c/g"), (_B, "./g/", "https://h.test/b/c/g/"), (_B, "", _B), (_B, "#s", _B + "#s"), (_B, "g?y/./x", "https://h.test/b/c/g?y/./x"),
    (_B, ".", "https://h.test/b/c/"), (_B, "..", "https://h.test/b/"), (_B, "../../../../g", "https://h.test/g"), (_B, "/./g/../..//x", "https://h.test//x"), (_B, "g;x=1/../y", "https://h.test/b/c/y"), (_B, "..g/.h./...", "https://h.test/b/c/..g/.h./..."), (_B, "a b%20ü", "https://h.test/b/c/a b%20ü"),
]


@query(f"SELECT page_id, c.c2 AS url FROM (SELECT page_id, {_cases(_JOINED, 3)}[(page_id % {len(_JOINED)})::INT + 1] AS c FROM pages)")
def url_joins(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", ux.joined(_pick([x[0] for x in _JOINED], _k()), _pick([x[1] for x in _JOINED], _k())).alias("url"))


@query("SELECT page_id, printf('%.2f', (page_id % 7) / 7.0) AS shown FROM pages")
def shown_similarity(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", tx.two_digits((_k() % 7) / F.lit(7.0)).alias("shown"))


# ---- scans, caches, reports

_CACHED = "(CASE page_id % 4 WHEN 1 THEN '404' WHEN 3 THEN NULL ELSE '410' END)"


def _cached_scan(spark, sf_dir, refresh: bool = False) -> sx.Scan:
    """Text documents of a URL each, requests that say 410, and a cache: a malformed row, a fresh verdict, an old one, a clean one."""
    p = _pages(spark, sf_dir)
    url = _text("https://h.test/", _key())
    docs = _written(spark, sf_dir, "text", _text("see ", url, " and ", url, "."))
    seen = p.select(url.alias("url"), F.lit("HEAD").alias("method"), F.lit(410).alias("status"))
    return sx.scan(docs, seen, now=F.lit(NOW).cast("timestamp"), cache=_cache_of(spark, sf_dir), ttl=50, refresh=refresh)


def _cache_of(spark, sf_dir) -> DataFrame:
    said = F.to_json(vx.verdict("http-status", F.lit("404"), "status", F.lit("404"), 1))
    now = F.unix_timestamp(F.lit(NOW).cast("timestamp"))
    return _pages(spark, sf_dir).select(_text("https://h.test/", _key()).alias("url"), F.when(_k() % 4 == 0, "{bad").when(_k() % 4 != 3, said).alias("verdict_json"), F.when(_k() % 4 == 2, now - 100).otherwise(now - 50).alias("checked_at"), F.lit(1).alias("tier"))


@query(f"SELECT page_id || '.text' AS path, 'https://h.test/' || page_id AS url, unnest([5, 6 + 4 + strlen('https://h.test/' || page_id)])::BIGINT AS \"column\", {_CACHED} AS detail FROM pages WHERE {_CACHED} IS NOT NULL")
def cached_scan(spark, sf_dir):
    """One verdict a URL, from the cache or from requests, at each of its occurrences."""
    return sx.flat(_cached_scan(spark, sf_dir).findings).select("path", "url", "column", "detail")


@query("SELECT page_id || '.text' AS path, '410' AS detail, 2 AS n FROM pages")
def refreshed_scan(spark, sf_dir):
    """A refresh does not read the cache."""
    return sx.flat(_cached_scan(spark, sf_dir, True).findings).groupBy("path", "detail").agg(F.count("*").alias("n"))


@query("SELECT 'https://h.test/' || page_id AS url, CASE page_id % 4 WHEN 1 THEN '404' WHEN 3 THEN NULL ELSE '410' END AS detail, page_id % 4 IN (0, 2) AS renewed FROM pages")
def cache_after_scan(spark, sf_dir):
    """The next cache: new verdicts over old ones, malformed rows gone."""
    found = _cached_scan(spark, sf_dir)
    kept = cx.upsert(cx.wellformed(_cache_of(spark, sf_dir)), found.cache)
    return kept.select("url", F.get_json_object("verdict_json", "$.reason.detail").alias("detail"), (F.col("checked_at") == F.unix_timestamp(F.lit(NOW).cast("timestamp"))).alias("renewed"))


@query("SELECT count(*) AS files_scanned, count(*) AS links_checked, count(*) AS links_unique, 2 * count(*) AS links FROM pages")
def scan_counts(spark, sf_dir):
    return _cached_scan(spark, sf_dir).run


_JSON = f"""SELECT page_id || '.text' AS path, '{{"url":"https://h.test/' || page_id || '","resolved_url":null,"source":{{"path":"' || page_id || '.text","format":"text","location":{{"type":"text","line":1,"column":' || c || '}},"byte_span":{{"start":' || (c - 1) || ',"end":' || (c - 1 + strlen('https://h.test/' || page_id))
|| '}}}},"verdict":{{"confidence":"dead-certain","reason":{{"kind":"http-status","detail":' || d || '}},"evidence":[{{"kind":"status","detail":"' || d || '"}}],"checked_at":"2027-01-01T00:00:00.000000Z","tier":1}},"fix":null}}' AS json FROM (SELECT page_id, {_CACHED} AS d, unnest([5, 10 + strlen('https://h.test/' || page_id)]) AS c FROM pages) WHERE d IS NOT NULL"""


@query(_JSON)
def json_findings(spark, sf_dir):
    """Findings as objects of the report's schema."""
    return report.json_rows(_cached_scan(spark, sf_dir).findings).select("path", "json")


@query(f"SELECT json FROM ({_JSON})")
def json_report_file(spark, sf_dir):
    """A report written as a file by shards, read again by its objects."""
    found = _cached_scan(spark, sf_dir).findings
    at = f"{mounted(folder(spark, 'report'))}/report.json"
    report.json_document(found, dict.fromkeys(("files_scanned", "links_checked", "links_unique"), 0)).write(at)
    whole, each = report.objects(spark, f"file://{at}", "findings")
    kept = Scratch(spark)
    # an object's text without the report's line breaks and blanks
    each = each.filter(F.lit(whole["schema_version"] == 1)).select(F.from_json(F.concat(F.lit('{"x":'), "text", F.lit("}")), "x string")["x"].alias("json"))
    out = kept.keep(kept.settle(each, "objects"))
    remove(spark, os.path.dirname(at))
    return out


@query("""SELECT o_orderkey % 7 AS k, rule_id, level, message, uri, line FROM (SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'SL0001' ELSE 'SL0201' END AS rule_id, CASE o_orderkey % 2 WHEN 0 THEN 'error' ELSE 'warning' END AS level,
CASE o_orderkey % 2 WHEN 0 THEN 'HTTP status: ' ELSE 'Permanent redirect: ' END || 'https://h.test/' || o_orderkey || '?é' AS message, 'a%20' || o_orderkey % 7 || '.md' AS uri, o_orderkey AS line FROM orders)""")
def sarif_report_file(spark, sf_dir):
    """The whole SARIF document of many findings, written by shards and read again."""
    k = F.col("o_orderkey")
    dead = k % 2 == 0
    said = F.when(dead, vx.verdict("http-status", F.lit("404"), "status", F.lit("404"), 1)).otherwise(vx.verdict("permanent-redirect", None, "redirect-target", F.lit("https://n.test/"), 1)).withField("checked_at", F.lit(NOW).cast("timestamp"))
    place = F.struct(F.lit("text").alias("type"), k.alias("line"), F.lit(1).cast("long").alias("column"), *(F.lit(None).cast("string").alias(c) for c in ("page", "annotation", "paragraph", "sheet", "cell", "slide")))
    none = F.lit(None).cast("long")
    found = table(spark, sf_dir, "orders").select(_text("a ", (k % 7).cast("string"), ".md").alias("path"), F.lit("markdown").alias("format"), _text("https://h.test/", k.cast("string"), "?é").alias("url"), F.lit(None).cast("string").alias("resolved_url"), place.alias("location"), none.alias("start"), none.alias("end"), said.alias("verdict"))
    found = found.withColumn("fix", fixes.suggested(F.col("verdict.reason.kind"), F.col("verdict.evidence")))
    at = f"{mounted(folder(spark, 'report'))}/report.sarif"
    report.sarif_document(found, 1).write(at)
    result = "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>"
    whole, each = report.objects(spark, f"file://{at}", "results")
    kept = Scratch(spark)
    x = F.col("x")
    where = x["locations"][0]["physicalLocation"]
    rows = each.filter(F.lit(whole["version"] == "2.1.0")).select(F.from_json("text", result).alias("x"))
    rows = rows.select((where["region"]["startLine"] % 7).alias("k"), x["ruleId"].alias("rule_id"), x["level"].alias("level"), x["message"]["text"].alias("message"), where["artifactLocation"]["uri"].alias("uri"), where["region"]["startLine"].alias("line"))
    out = kept.keep(kept.settle(rows, "results"))
    remove(spark, os.path.dirname(at))
    return out


# ---- fixes

_NEW = "https://new.test/{k}?a=1&b"


def _old_documents(spark, sf_dir) -> DataFrame:
    """Documents of every format that name https://old.test/<key>."""
    old = "https://old.test/"
    docs = _written(spark, sf_dir, "markdown", _filled("[x](https://old.test/{k}) <https://old.test/{k}>\n")).unionByName(_written(spark, sf_dir, "text", _filled("see https://old.test/{k}.")))
    docs = docs.unionByName(_written(spark, sf_dir, "html", _filled("<a href=https://old.test/{k}>a</a><a href='https://old.test/{k}'>b</a><img src=\"https://old.test/{k}\">")))
    for kind in BUILT:
        docs = docs.unionByName(_built(spark, sf_dir, kind, old))
    return docs


def _asked(docs: DataFrame) -> DataFrame:
    key = F.substring_index("path", ".", 1)
    return docs.select("path", _text("https://old.test/", key).alias("old"), _text("https://new.test/", key, "?a=1&b").alias("new"))


_KINDS = "[{'f': 'markdown', 'n': 2}, {'f': 'text', 'n': 1}, {'f': 'html', 'n': 3}, {'f': 'docx', 'n': 1}, {'f': 'xlsx', 'n': 1}, {'f': 'pptx', 'n': 1}, {'f': 'pdf', 'n': 1}]"


@query(f"SELECT page_id || '.' || k.f AS path, 'https://new.test/' || page_id || '?a=1&b' AS url, k.n::BIGINT AS n FROM (SELECT page_id, unnest({_KINDS}) AS k FROM pages)")
def fix_roundtrip(spark, sf_dir):
    """URLs replaced in documents of all formats, and extracted from what came out."""
    docs = _old_documents(spark, sf_dir)
    done = fixes.run(docs, _asked(docs)).filter("error is null")
    return extract.links(done.select("path", "format", "content")).filter(F.contains("url", F.lit("old.test")) | F.contains("url", F.lit("new.test"))).groupBy("path", "url").agg(F.count("*").alias("n"))


@query("SELECT page_id || '.html' AS path, '<a href=https://new.test/' || page_id || '?a&#61;1&amp;b>a</a><a href=''https://new.test/' || page_id || '?a=1&amp;b''>b</a><img src=\"https://new.test/' || page_id || '?a=1&amp;b\">' AS content FROM pages")
def html_rewrites(spark, sf_dir):
    """The replacement written by each value's quoting."""
    docs = _old_documents(spark, sf_dir).filter("format = 'html'")
    return fixes.run(docs, _asked(docs)).select("path", F.decode("content", "utf-8").alias("content"))


@query("SELECT page_id || '.text' AS path, '--- ' || page_id || '.text' || chr(10) || '+++ ' || page_id || '.text' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-see https://old.test/' || page_id || '.+see https://new.test/' || page_id || '?a=1&b.' AS diff FROM pages UNION ALL SELECT page_id || '.pptx', page_id || '.pptx: https://old.test/' || page_id || ' -> https://new.test/' || page_id || '?a=1&b' || chr(10) FROM pages")
def fix_previews(spark, sf_dir):
    """A diff of text, a line a replacement of other formats."""
    docs = _old_documents(spark, sf_dir).filter("format in ('text', 'pptx')")
    return fixes.run(docs, _asked(docs)).select("path", "diff")


@query("SELECT page_id || '.pdf' AS path, CASE page_id % 4 WHEN 0 THEN 'encrypted PDF files are not modified' WHEN 1 THEN 'signed PDF files are not modified' WHEN 2 THEN 'PDF files with direct link annotations are not modified' END AS reason FROM pages WHERE page_id % 4 < 3")
def pdf_preflight(spark, sf_dir):
    """PDFs that are never changed, with findings or without."""
    return fixes.plan(_no_findings(spark, sf_dir), _closed_pdfs(spark, sf_dir))[1].select("path", "reason")


def _closed_pdfs(spark, sf_dir) -> DataFrame:
    """Encrypted, signed, with direct link annotations, or open, in turn."""

    def make(batches):
        for keys in numbers(batches):
            rows = []
            for k in keys:
                more = "/AcroForm <</Fields [7 0 R]>> /Perms <<>>" if k % 4 == 1 else ""
                body = pdf(k, f"https://old.test/{k}", more, "<</Subtype /Link /A <</S /URI /URI (https://x.test)>> >>" if k % 4 == 2 else "4 0 R")
                rows.append((f"{k}.pdf", "pdf", body.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 7 0 R") if k % 4 == 0 else body))
            yield made(rows, DOCUMENT)

    return _pages(spark, sf_dir).select("page_id").mapInArrow(make, "path string, format string, content binary")


def _no_findings(spark, sf_dir) -> DataFrame:
    return sx.scan(_written(spark, sf_dir, "text", F.lit("nothing")), None, now=F.lit(NOW).cast("timestamp")).findings


@query("SELECT page_id || '.text' AS path, 'https://h.test/v1/' || page_id AS old, 'https://h.test/v2/' || page_id AS new FROM pages WHERE page_id % 2 = 0")
def planned_fixes(spark, sf_dir):
    """From a scan's findings to the replacements that may be made: version upgrades, without redirects."""
    p = _pages(spark, sf_dir)
    docs = _written(spark, sf_dir, "text", _filled("https://h.test/v1/{k}"))
    url, up = _filled("https://h.test/v1/{k}"), _filled("https://h.test/v2/{k}")
    hops = F.when(_k() % 2 == 1, F.array(F.struct(F.lit(301).alias("status"), F.lit("https://n.test/").alias("url")))).otherwise(F.array().cast("array<struct<status:int,url:string>>"))
    row = lambda u, method, h: F.struct(u.alias("url"), F.lit(method).alias("method"), F.lit(200).alias("status"), h.alias("hops"), F.lit("https://n.test/").alias("final_url"), F.lit("x").alias("body"))
    none = F.array().cast("array<struct<status:int,url:string>>")
    seen = p.select(F.explode(F.array(row(url, "HEAD", none), row(url, "GET", hops), row(up, "GET", none))).alias("o")).select("o.*")
    found = sx.scan(docs, seen, now=F.lit(NOW).cast("timestamp")).findings
    return fixes.plan(found, docs, "outdated", ("redirect",))[0]


@query("SELECT page_id || '.markdown' AS path, CASE page_id % 3 WHEN 0 THEN 'https://old.test/(x) is written with escapes' WHEN 1 THEN 'replacement URL was not extractable: https://new.test/' ELSE 'two replacements of https://old.test/(x)' END AS error FROM pages")
def fix_refusals(spark, sf_dir):
    """Escaped destinations, URLs that are not there, and two replacements of one URL are refused."""
    docs = _written(spark, sf_dir, "markdown", F.when(_k() % 3 == 1, "no link").otherwise("[a](https://old.test/\\(x\\))"))
    one = docs.select("path", F.lit("https://old.test/(x)").alias("old"), F.lit("https://new.test/").alias("new"))
    two = one.filter(F.substring_index("path", ".", 1).cast("long") % 3 == 2).withColumn("new", F.lit("https://other.test/"))
    return fixes.run(docs, one.unionByName(two)).select("path", "error")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a.b/c.fixed.md' WHEN 1 THEN 'x.fixed' ELSE '.hid/y.tar.fixed.gz' END AS name FROM pages")
def copy_names(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", fixes.copy_name(_pick(["a.b/c.md", "x", ".hid/y.tar.gz"], _k())).alias("name"))


@query("""SELECT page_id || s.s AS name, CASE s.s WHEN '.text.bak' THEN 'see https://old.test/' || page_id || '.' WHEN '.text' THEN CASE WHEN page_id % 3 = 1 THEN 'see nothing' ELSE 'see https://new.test/' || page_id || '?a=1&b.' END ELSE '<a href=https://old.test/' || page_id || '>' END AS content FROM pages,
(VALUES ('.text'), ('.text.bak'), ('.html')) s(s) WHERE page_id % 3 <> 1 OR s.s <> '.text.bak'""")
def in_place_writes(spark, sf_dir):
    """Documents written as files, their links replaced in place with backups, and read again; pages without the link stay, others are not touched."""
    at = mounted(folder(spark, "docs"))
    own = f"{at}/"
    body = F.when(_k() % 3 == 1, "see nothing").otherwise(_filled("see https://old.test/{k}."))
    docs = _written(spark, sf_dir, "text", body).unionByName(_written(spark, sf_dir, "html", _filled("<a href=https://old.test/{k}>")))

    def put(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with open(own + name, "wb") as f:
                    f.write(bytes(content))
            yield pdf[["path"]]

    docs.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(put, "path string").count()
    asked = _asked(docs.filter("format = 'text'"))
    fixed = fixes.run(docs, asked).filter("content is not null").withColumn("path", F.concat(F.lit(own), "path"))
    kept = Scratch(spark)
    kept.drop(commit.write(fixed, kept, backup=True))
    # listed and read by tasks: as small files of a binaryFile source they would be listed by the driver and be a task for every few
    read = files.contents(spark, listing.listed(spark, [at], ignore=False)).select(F.substring_index("path", "/", -1).alias("name"), F.decode("content", "utf-8").alias("content"))
    out = kept.settle(read, "read")
    kept.keep(out)
    kept.drop(*kept.tables())
    remove(spark, at)
    return out


@query("SELECT format, n, printf('%016x', h) || printf('%016x', l) AS digest FROM (SELECT k.f AS format, (count(*) * any_value(k.n))::BIGINT AS n, (k.n * sum(('0x' || substr(m, 1, 16))::UBIGINT::HUGEINT) % 18446744073709551616)::UBIGINT AS h, (k.n * sum(('0x' || substr(m, 17, 16))::UBIGINT::HUGEINT) % 18446744073709551616)::UBIGINT AS l FROM (SELECT k, md5(page_id || '.' || k.f || chr(31) || 'https://old.test/' || page_id) AS m FROM (SELECT page_id, unnest(" + _KINDS + ") AS k FROM pages)) GROUP BY k.f, k.n)")
def links_digest(spark, sf_dir):
    """One digest of each format's links, whatever their order and partitions."""
    links = extract.links(_old_documents(spark, sf_dir)).filter(F.contains("url", F.lit("old.test")))
    return digest.digested(links, ["path", "url"], ["format"])


@query("SELECT page_id || '.text' AS path, 'https://old.test/' || page_id AS url, row_number() OVER (ORDER BY page_id || '.text' || chr(31) || 'https://old.test/' || page_id) AS place FROM pages")
def record_order(spark, sf_dir):
    """Links in the order of their serialised records, numbered without gathering them."""
    links = extract.links(_old_documents(spark, sf_dir).filter("format = 'text'"))
    return digest.numbered(links.select("path", "url"), ["path", "url"])
