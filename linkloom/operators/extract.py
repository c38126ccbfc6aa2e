"""Links of documents: bytes to rows (url, location, byte span), one function a format.

Functions take the document's bytes and yield ``(url, location, start, end)``; ``location`` is
a dict of the location's own fields; start and end are byte offsets of the raw link in text
formats, None in binary ones. ``links`` runs them over a DataFrame.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.batches import made, pieces

LOCATION = "struct<type:string,page:bigint,annotation:bigint,paragraph:bigint,sheet:string,cell:string,slide:bigint,line:bigint,column:bigint>"
MEMBER_LIMIT = 64 << 20
_BARE = re.compile(r"https?://[^\s<>\"`{}|\\^]+", re.I)
_CLOSERS = {")": "(", "]": "[", "}": "{"}


def _trim(url: str) -> str:
    """Without trailing punctuation and closing brackets that nothing in the URL opens."""
    while url:
        c = url[-1]
        if c in ".,:;!?'\"*_~":
            url = url[:-1]
        elif c in _CLOSERS and url.count(c) > url.count(_CLOSERS[c]):
            url = url[:-1]
        else:
            break
    return url


def bare_urls(text: str):
    """(url, start) of http and https URLs in plain text."""
    for m in _BARE.finditer(text):
        url = _trim(m[0])
        host = url.partition("://")[2]
        if re.match(r"[\w\[]", host):
            yield url, m.start()


class _Places:
    """Character offsets to byte offsets, lines and columns."""

    def __init__(self, text: str):
        self.text = text
        self.at = self.byte = 0
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def byte_of(self, i: int) -> int:
        if i < self.at:
            self.at = self.byte = 0
        self.byte += len(self.text[self.at : i].encode())
        self.at = i
        return self.byte

    def place(self, i: int) -> dict:
        from bisect import bisect_right

        k = bisect_right(self.lines, i)
        return {"type": "text", "line": k, "column": i - self.lines[k - 1] + 1}

    def row(self, url: str, start: int, end: int):
        a = self.byte_of(start)
        return url, self.place(start), a, a + len(self.text[start:end].encode())


def wanted(url: str) -> bool:
    """http and https, contacts, and what no scheme makes a URL of its own."""
    try:
        parts = urlsplit(url)
    except ValueError:
        return True
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", url):
        return True
    return parts.scheme in ("http", "https", "mailto", "tel")


def text_links(body: bytes):
    text = body.decode()
    places = _Places(text)
    for url, start in bare_urls(text):
        yield places.row(url, start, start + len(url))


#: Attributes by the states of the HTML syntax: a quote opens a value only behind ``=``; an unquoted value ends at a blank or ``>``.
_INSIDE = r"(?:[\s/]++|[^\s/>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|))*+"
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/>]*+)({_INSIDE})(?:>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)|'([^']*+)|([^\s>\"'][^\s>]*+)))?")
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "title")}
LINK_ATTRIBUTES = {"a": "href", "link": "href", "img": "src", "script": "src"}


def tags(text: str):
    """(name, attributes with their value's start and end) of every start tag outside comments and raw text."""
    at = 0
    while m := _TAG.search(text, at):
        at = m.end()
        if not m[1]:
            continue
        name, begin = m[1].lower(), m.start(2)
        found = {}
        for a in _ATTRIBUTE.finditer(m[2]):
            group = next((g for g in (2, 3, 4) if a[g] is not None), None)
            if group:
                found.setdefault(a[1].lower(), (a[group], begin + a.start(group), begin + a.end(group)))
        yield name, found
        if name in _RAW:
            end = _RAW[name].search(text, at)
            at = end.start() if end else len(text)


def html_links(body: bytes):
    text = body.decode("utf-8", "replace")
    places = _Places(text)
    for name, attributes in tags(text):
        hit = attributes.get(LINK_ATTRIBUTES.get(name, ""))
        if hit and wanted(url := html.unescape(hit[0])):
            yield places.row(url, hit[1], hit[2])


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n(?:.*?\n)??(?: {0,3}\1[`~]* *(?:\n|$)|\Z)", re.S | re.M)
_DEFINITION = re.compile(r"^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|\S+)(?:[ \t]*\n?[ \t]+(\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$", re.M)
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


_INDENTED = re.compile(r"(?:(?<=\n\n)|\A)(?:(?: {4}| {0,3}\t)[^\n]*(?:\n+|\Z))+")
_LIST = re.compile(r"^ {0,3}(?:[-+*]|\d{1,9}[.)])[ \t]", re.M)


class _Spans:
    """Whether a place is inside any of the spans, by their order."""

    def __init__(self, spans):
        self.starts, self.reach = [], []
        for a, b in sorted(spans):
            self.starts.append(a)
            self.reach.append(max(b, self.reach[-1] if self.reach else b))

    def __contains__(self, i: int) -> bool:
        from bisect import bisect_right

        k = bisect_right(self.starts, i)
        return k > 0 and i < self.reach[k - 1]


def _label(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip()).casefold()


def _semantic(raw: str) -> str:
    return _ESCAPE.sub(r"\1", html.unescape(raw))


#: Brackets open inside a destination, and characters of a label, beyond which there is none: a text is read in linear time.
NESTED, LABEL = 32, 999


def _code_spans(text: str):
    """(start, end) of code spans: from a run of backticks to the next of the same length."""
    runs = [m.span() for m in re.finditer("`+", text)]
    after, last = [0] * len(runs), {}
    for i in range(len(runs) - 1, -1, -1):
        length = runs[i][1] - runs[i][0]
        after[i] = last.get(length, -1)
        last[length] = i
    i = 0
    while i < len(runs):
        if after[i] > 0:
            yield runs[i][0], runs[after[i]][1]
            i = after[i]
        i += 1


def _closing(text: str) -> dict[int, int]:
    """The place behind the bracket that closes each opening one."""
    out, open_ = {}, []
    for m in re.finditer(r"\\.|[\[\]]", text, re.S):
        if m[0] == "[":
            open_.append(m.start())
        elif m[0] == "]" and open_:
            out[open_.pop()] = m.end()
    return out


def _destination(text: str, at: int):
    """(start, end, after) of an inline destination behind ``](``, or None."""
    n = len(text)
    while at < n and text[at] in " \t\n":
        at += 1
    if at < n and text[at] == "<":
        end = at + 1
        while end < n and text[end] not in "<>\n":
            end += 2 if text[end] == "\\" else 1
        if end >= n or text[end] != ">":
            return None
        start, stop, at = at + 1, end, end + 1
    else:
        start, depth = at, 0
        while at < n and not text[at].isspace():
            c = text[at]
            if c == "\\" and at + 1 < n:
                at += 2
                continue
            if c == "(":
                depth += 1
                if depth > NESTED:
                    return None
            elif c == ")":
                if not depth:
                    break
                depth -= 1
            at += 1
        stop = at
    rest = re.compile(r"(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S).match(text, at)
    return (start, stop, rest.end()) if rest else None


def markdown_links(body: bytes):
    text = body.decode()
    places = _Places(text)
    hidden = list(text)

    def hide(a: int, b: int) -> None:
        hidden[a:b] = ["\n" if c == "\n" else " " for c in text[a:b]]

    for m in _FENCE.finditer(text):
        hide(m.start(), m.end())
    seen = "".join(hidden)
    for m in _INDENTED.finditer(seen):
        end = m.start()
        while end and seen[end - 1] == "\n":
            end -= 1
        if not _LIST.match(seen, seen.rfind("\n", 0, end) + 1, end):  # in a list, indented lines go on with the item
            hide(m.start(), m.end())
    for span in list(_code_spans("".join(hidden))):
        hide(*span)
    visible = "".join(hidden)
    definitions, spans, found = {}, [], {}
    for m in _DEFINITION.finditer(visible):
        raw, start = m[2], m.start(2)
        if raw.startswith("<"):
            raw, start = raw[1:-1], start + 1
        definitions.setdefault(_label(m[1]), (_semantic(raw), start, start + len(raw)))
        spans.append(m.span())
    used = _Spans(spans).__contains__

    def add(url: str, a: int, b: int) -> None:
        if wanted(url):
            found.setdefault((a, b), url)

    taken = []
    for m in re.finditer(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)*)>", visible):
        if not used(m.start()):
            mail = ":" not in m[1]
            add("mailto:" + m[1] if mail else m[1], m.start(1), m.end(1))
            taken.append(m.span())
    closing = _closing(visible)
    for m in re.finditer(r"!?\[", visible):
        at = closing.get(m.end() - 1)
        if at is None or used(m.start()) or (m.start() and visible[m.start() - 1] == "\\"):
            continue
        inner = visible[m.end() : at - 1] if at - m.end() <= LABEL else ""
        if visible[at : at + 1] == "(" and (hit := _destination(visible, at + 1)):
            add(_semantic(text[hit[0] : hit[1]]), hit[0], hit[1])
            taken.append((m.start(), hit[2]))
            continue
        ref = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(visible, at)
        label = _label(ref[1]) if ref and ref[1].strip() else _label(inner)
        if label in definitions:
            add(*definitions[label])
            taken.append((m.start(), ref.end() if ref else at))
    inside = _Spans(taken)
    for url, start in bare_urls(visible):
        if not used(start) and start not in inside:
            add(url, start, start + len(url))
    for (a, b), url in sorted(found.items()):
        yield places.row(url, a, b)


def _members(body: bytes) -> dict[str, bytes]:
    out = {}
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        for info in z.infolist():
            if info.filename.endswith((".xml", ".rels")):
                with z.open(info) as f:
                    data = f.read(MEMBER_LIMIT + 1)
                if len(data) > MEMBER_LIMIT:
                    raise ValueError(f"{info.filename}: over {MEMBER_LIMIT} bytes")
                out[info.filename] = data
    return out


def _events(data: bytes, part: str):
    """(kind, name, attributes or text); names as ``namespace name``."""
    out = []
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler = lambda n, a: out.append(("start", n, a))
    parser.EndElementHandler = lambda n: out.append(("end", n, {}))
    parser.CharacterDataHandler = lambda t: out.append(("text", "", t))
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise ValueError(f"{part}: {e}") from e
    return out


_OFFICE = "http://schemas.openxmlformats.org/"
_W, _S, _P, _A = (_OFFICE + x for x in ("wordprocessingml/2006/main", "spreadsheetml/2006/main", "presentationml/2006/main", "drawingml/2006/main"))
_RID = _OFFICE + "officeDocument/2006/relationships id"


def relationships(members: dict[str, bytes], part: str, external: bool) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
    out = {}
    for kind, n, a in _events(members[rels], rels) if rels in members else ():
        if kind == "start" and n.endswith(" Relationship") and "Id" in a and "Target" in a and (a.get("TargetMode") == "External") == external:
            out[a["Id"]] = a["Target"]
    return out


def resolve_part(base: str, target: str) -> str:
    parts = [] if target.startswith("/") else base.split("/")[:-1]
    for p in target.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def field_link(text: str) -> str | None:
    """After HYPERLINK, from the first http to a blank, quote or closing bracket."""
    m = re.search(r"HYPERLINK.*?(http[^\s\")]*)", text, re.S | re.I)
    return m[1] if m else None


def docx_links(body: bytes):
    """Hyperlinks by relation, complex and simple fields, and HYPERLINK in instructions or text outside fields."""
    members = _members(body)
    part = "word/document.xml"
    rels = relationships(members, part, True)
    paragraph, field, instruction, plain = 0, None, None, ""

    def row(url: str, at: int):
        return url, {"type": "docx", "paragraph": at}, None, None

    for kind, name, a in _events(members.get(part, b"<x/>"), part):
        if kind == "text":
            if field is not None:
                field = field[0], field[1] + a
            elif instruction is not None:
                instruction = instruction[0], instruction[1] + a
            else:
                plain += a  # the parser may cut a text into pieces
            continue
        if plain and (url := field_link(plain)):
            yield row(url, paragraph)
        plain = ""
        if kind == "start":
            if name == f"{_W} p":
                paragraph += 1
            elif name == f"{_W} hyperlink" and a.get(_RID) in rels:
                yield row(rels[a[_RID]], paragraph)
            elif name == f"{_W} fldSimple" and (url := field_link(a.get(f"{_W} instr", ""))):
                yield row(url, paragraph)
            elif name == f"{_W} fldChar":
                state = a.get(f"{_W} fldCharType")
                if state == "begin":
                    field = paragraph, ""
                elif state == "end" and field is not None:
                    if url := field_link(field[1]):
                        yield row(url, field[0])
                    field = None
            elif name == f"{_W} instrText":
                instruction = paragraph, ""
        elif name == f"{_W} instrText" and instruction is not None:
            if url := field_link(instruction[1]):
                yield row(url, instruction[0])
            instruction = None


def xlsx_links(body: bytes):
    members = _members(body)
    book = "xl/workbook.xml"
    targets = relationships(members, book, False)
    for kind, name, a in _events(members.get(book, b"<x/>"), book):
        if kind != "start" or name != f"{_S} sheet" or a.get(_RID) not in targets:
            continue
        part, sheet = resolve_part(book, targets[a[_RID]]), a.get("name", "")
        rels, cell, formula = relationships(members, part, True), None, None
        for k, n, x in _events(members.get(part, b"<x/>"), part):
            if k == "start" and n == f"{_S} c":
                cell = x.get("r")
            elif k == "start" and n == f"{_S} f":
                formula = ""
            elif k == "text" and formula is not None:
                formula += x
            elif k == "end" and n == f"{_S} f":
                if url := field_link(formula or ""):
                    yield url, {"type": "xlsx", "sheet": sheet, "cell": cell}, None, None
                formula = None
            elif k == "start" and n == f"{_S} hyperlink" and x.get(_RID) in rels:
                yield rels[x[_RID]], {"type": "xlsx", "sheet": sheet, "cell": x.get("ref")}, None, None


def pptx_links(body: bytes):
    members = _members(body)
    deck = "ppt/presentation.xml"
    targets = relationships(members, deck, False)
    slides = [resolve_part(deck, targets[a[_RID]]) for kind, n, a in _events(members[deck], deck) if kind == "start" and n == f"{_P} sldId" and a.get(_RID) in targets] if deck in members else []
    if not slides:
        slides = sorted((m for m in members if re.fullmatch(r"ppt/slides/slide\d+\.xml", m)), key=lambda m: int(re.search(r"\d+", m)[0]))
    for number, part in enumerate(slides, 1):
        rels = relationships(members, part, True)
        for kind, n, a in _events(members.get(part, b"<x/>"), part):
            if kind == "start" and n in (f"{_A} hlinkClick", f"{_A} hlinkHover") and a.get(_RID) in rels:
                yield rels[a[_RID]], {"type": "pptx", "slide": number}, None, None


_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_URI = re.compile(rb"/URI\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", re.S)


def pdf_string(raw: bytes) -> str:
    """A literal or hexadecimal string, UTF-16 with its mark or else one byte a character."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else plain.get(m[1], m[1]), raw[1:-1], flags=re.S)
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be")
    if b"\x7f" in data or b"\x9f" in data:
        raise ValueError("undefined byte in a PDF string")
    return data.decode("latin-1")


def pdf_objects(body: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[3] for m in _OBJECT.finditer(body)}
    for data in list(found.values()):
        if b"/ObjStm" in data and (s := _stream(data)) is not None:
            n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", data)[1]) for k in (b"N", b"First"))
            heads = list(map(int, s[:first].split()))[: 2 * n]
            for i in range(0, len(heads), 2):
                stop = heads[i + 3] + first if i + 3 < len(heads) else len(s)
                found.setdefault(heads[i], s[first + heads[i + 1] : stop])
    return found


def _stream(data: bytes) -> bytes | None:
    m = re.search(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S)
    if not m:
        return None
    try:
        return zlib.decompress(m[1]) if b"/FlateDecode" in data else m[1]
    except zlib.error:
        return None


def _refs(data: bytes, key: bytes, objects: dict[int, bytes]) -> list[bytes]:
    """The dictionaries that an entry names: directly, by reference, or as an array of either."""
    m = re.search(rb"/" + key + rb"\s*(\[.*?\]|\d+\s+\d+\s+R|<<.*)", data, re.S)
    if not m:
        return []
    value = m[1]
    if (r := re.fullmatch(rb"(\d+)\s+\d+\s+R", value)) and objects.get(int(r[1]), b"").strip()[:1] == b"[":
        value = objects[int(r[1])].strip()
    if value[:2] == b"<<":
        return [value]
    out = [objects.get(int(r[1]), b"") for r in re.finditer(rb"(\d+)\s+\d+\s+R", value)]
    return out + re.findall(rb"<<.*?>>(?:\s*>>)?", value, re.S)


def _pages_in_order(objects: dict[int, bytes]) -> list[bytes]:
    """Page dictionaries by the page tree; by object number if there is no tree."""
    page = re.compile(rb"/Type\s*/Page\b(?!s)")
    root = next((m for d in objects.values() if re.search(rb"/Type\s*/Catalog\b", d) and (m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", d))), None)
    out, seen, stack = [], set(), [int(root[1])] if root else []
    while stack:
        n = stack.pop()
        if n in seen or n not in objects:
            continue
        seen.add(n)
        if page.search(objects[n]):
            out.append(objects[n])
        elif kids := re.search(rb"/Kids\s*\[(.*?)\]", objects[n], re.S):
            stack += [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", kids[1])][::-1]
    return out or [d for _, d in sorted(objects.items()) if page.search(d)]


def pdf_links(body: bytes):
    """URI annotations of every page, then URLs in its uncompressed or deflated text; nothing if encrypted."""
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", body):
        return
    objects = pdf_objects(body)
    pages = _pages_in_order(objects)
    for number, page in enumerate(pages, 1):
        for i, note in enumerate(_refs(page, b"Annots", objects)):
            action = next(iter(_refs(note, b"A", objects)), b"")
            if re.search(rb"/S\s*/URI\b", action) and (m := _URI.search(action)):
                yield pdf_string(m[1]), {"type": "pdf", "page": number, "annotation": i}, None, None
        text = []
        for content in _refs(page, b"Contents", objects):
            for run in re.finditer(rb"(\[(?:[^\[\]\\]|\\.)*\]|\((?:[^()\\]|\\.)*\))\s*(TJ|Tj|'|\")", _stream(content) or b"", re.S):
                text.append("".join(pdf_string(x) for x in re.findall(rb"\((?:[^()\\]|\\.)*\)", run[1], re.S)))
        for url, _ in bare_urls("\n".join(text)):
            yield url, {"type": "pdf", "page": number, "annotation": None}, None, None


EXTRACTORS = {"text": text_links, "markdown": markdown_links, "html": html_links, "docx": docx_links, "xlsx": xlsx_links, "pptx": pptx_links, "pdf": pdf_links}
FIELDS = ("type", "page", "annotation", "paragraph", "sheet", "cell", "slide", "line", "column")


_TEXT, _LONG = pa.string(), pa.int64()
_FOUND = pa.schema(
    [("path", _TEXT), ("format", _TEXT), ("url", _TEXT), ("location", pa.struct([(f, _TEXT if f in ("type", "sheet", "cell") else _LONG) for f in FIELDS])), ("start", _LONG), ("end", _LONG), ("error", _TEXT), ("has_anchors", pa.bool_()), ("anchor", _TEXT)]
)


def found(batches: Iterable[pa.RecordBatch], mode: str, with_anchors: bool) -> Iterator[pa.RecordBatch]:
    """Batches of documents (path, format, content) to batches of links, and of anchors if these are asked for."""
    schema = _FOUND if with_anchors else pa.schema(list(_FOUND)[:7])
    more = (False, None) if with_anchors else ()
    for part in pieces(batches):
        rows = []
        for path, kind, body in zip(part["path"], part["format"], part["content"]):
            extractor, known = EXTRACTORS.get(kind), None
            if extractor is None or body is None:
                continue
            try:
                rows += [(path, kind, u, {f: loc.get(f) for f in FIELDS}, a, b, None, *more) for u, loc, a, b in extractor(body)]
                if with_anchors:
                    known = anchors(body, kind)
            except Exception as e:
                if mode != "permissive":
                    raise ValueError(f"{path}: {e}") from e
                rows.append((path, kind, None, None, None, None, str(e), *more))
                continue
            if known is not None:
                rows += [(path, kind, None, None, None, None, None, True, x) for x in [None, *dict.fromkeys(known)]]
        yield made(rows, schema)


def links(docs: DataFrame, mode: str = "failfast") -> DataFrame:
    """docs (path, format, content) to (path, format, url, location, start, end, error).

    mode: failfast raises at a document that can't be read, permissive gives a row with its error.
    """
    return docs.select("path", "format", "content").mapInArrow(lambda batches: found(batches, mode, False), f"path string, format string, url string, location {LOCATION}, start long, end long, error string")


def read(docs: DataFrame, mode: str = "failfast") -> DataFrame:
    """Links and anchors of docs in one pass: the columns of ``links``, has_anchors and anchor.

    Rows are links (url), errors, and, of documents whose anchors are known (has_anchors), their anchors;
    one with a null anchor stands for the document itself.
    """
    schema = f"path string, format string, url string, location {LOCATION}, start long, end long, error string, has_anchors boolean, anchor string"
    return docs.select("path", "format", "content").mapInArrow(lambda batches: found(batches, mode, True), schema)


def hrefs(page):
    """The double-quoted href values of a column of HTML: the fast path where all attributes are so quoted."""
    return F.regexp_extract_all(page, F.lit('href="([^"]*)"'), F.lit(1))


def anchors(body: bytes, kind: str) -> list[str] | None:
    """Anchors of an HTML or Markdown document; None: any anchor counts as there."""
    from linkloom.functions.text import numbered

    if kind not in ("html", "markdown"):
        return None
    text = body.decode("utf-8", "replace")
    ids = [html.unescape(v[0]) for name, a in tags(text) for key, v in a.items() if key == "id" or (key == "name" and name == "a")]
    if kind == "html":
        return ids
    plain = _FENCE.sub("", text)
    heads = [m[1] or m[2] for m in re.finditer(r"^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$|^(\S[^\n]*)\n {0,3}(?:=+|-+)[ \t]*$", plain, re.M)]
    clean = [re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"[`*]", "", h)) for h in heads]
    return numbered(["".join("-" if c.isspace() else c for c in h.lower() if c.isalnum() or c in "-_" or c.isspace()) for h in clean]) + ids
