"""Replacing links in documents: choosing, checking and applying edits."""

from __future__ import annotations

import difflib
import html
import io
import re
import struct
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.batches import made, pieces
from linkloom.operators.extract import EXTRACTORS, _URI, pdf_objects, pdf_string


def suggested(reason: Column, evidence: Column) -> Column:
    """struct(replacement_url, origin, fixable) from the first evidence of the reason's kind, if that is an http URL."""
    pick = lambda kind: F.get(F.filter(evidence, lambda e: e["kind"] == kind), F.lit(0))["detail"]
    url = F.when(reason == "permanent-redirect", pick("redirect-target")).when(reason == "version-drift", pick("version-upgrade"))
    url = F.when(url.rlike("^(?i)https?://"), url)
    origin = F.when(reason == "permanent-redirect", "redirect-target").when(reason == "version-drift", "version-upgrade")
    fixable = F.struct(F.lit("auto").alias("kind"), F.lit(None).cast("string").alias("reason"))
    return F.when(url.isNotNull(), F.struct(url.alias("replacement_url"), origin.alias("origin"), fixable.alias("fixable")))


def selected(findings: DataFrame, least_rank: int, excluded: list[str]) -> DataFrame:
    """Findings whose fix is asked for; read: format, origin, replacement_url, rank."""
    kind = F.when(F.col("origin") == "redirect-target", "redirect").when(F.col("origin").isin("https-upgrade", "version-upgrade"), "url-upgrade")
    no = F.lit(False)
    for x in excluded:
        no = no | ((F.col("format") == "pdf") if x == "pdf" else F.coalesce(kind == x, F.lit(False)))
    return findings.filter(F.col("replacement_url").isNotNull() & (F.col("rank") >= least_rank) & ~no)


def conflicts(replacements: DataFrame) -> DataFrame:
    """(path, old) that two different replacements are asked for."""
    return replacements.groupBy("path", "old").agg(F.countDistinct("new").alias("n")).filter("n > 1").select("path", "old")


def overlaps(edits: DataFrame) -> DataFrame:
    """Edits (path, start, end) that begin before an earlier one ends, or insert at the same place as the one before."""
    w = Window.partitionBy("path").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    before, was = F.lag("end").over(w), F.lag("start").over(w)
    return edits.withColumns({"_r": reach, "_e": before, "_s": was}).filter((F.col("start") < F.col("_r")) | ((F.col("start") == F.col("_s")) & (F.col("start") == F.col("end")) & (F.col("_s") == F.col("_e")))).drop("_r", "_e", "_s")


def apply_edits(body: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """Edits spliced in from the back; they must be in bounds and must not overlap."""
    last_start, last_end = len(body) + 1, len(body) + 1
    for a, b, new in sorted(edits, key=lambda e: (-e[0], -e[1])):
        if not 0 <= a <= b <= len(body):
            raise ValueError(f"edit {a}-{b} is out of range")
        if b > last_start or (a == b == last_start == last_end):
            raise ValueError(f"edit {a}-{b} overlaps another")
        body = body[:a] + new + body[b:]
        last_start, last_end = a, b
    return body


def _encoded(url: str, quote: str) -> str:
    out = url.replace("&", "&amp;")
    if quote == '"':
        return out.replace('"', "&quot;")
    if quote == "'":
        return out.replace("'", "&#39;")
    return "".join(f"&#{ord(c)};" if c in " \t\n\r\f\"'=<>`" else c for c in out)


def fix_text(body: bytes, kind: str, wanted: dict[str, str]) -> bytes:
    """Markdown or plain text: the raw bytes must be the URL itself."""
    edits = []
    for url, _, a, b in EXTRACTORS[kind](body):
        if url in wanted:
            if body[a:b] != url.encode():
                raise ValueError(f"{url} is written with escapes")
            edits.append((a, b, wanted[url].encode()))
    return apply_edits(body, edits)


def fix_html(body: bytes, wanted: dict[str, str]) -> bytes:
    edits = []
    for url, _, a, b in EXTRACTORS["html"](body):
        if url in wanted:
            if html.unescape(body[a:b].decode()) != url:
                raise ValueError(f"{url} can't be placed")
            quote = body[a - 1 : a].decode() if body[a - 1 : a] in (b'"', b"'") else ""
            edits.append((a, b, _encoded(wanted[url], quote).encode()))
    return apply_edits(body, edits)


def fix_office(body: bytes, wanted: dict[str, str]) -> bytes:
    """Rewrites .xml and .rels members that hold a URL; other members' records are copied as they are."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        infos, new, found = z.infolist(), {}, set()
        for i in infos:
            if not i.filename.endswith((".xml", ".rels")):
                continue
            data = z.read(i)
            text = data.decode("utf-8")
            for old, to in wanted.items():
                a, b = escape(old, {'"': "&quot;"}), escape(to, {'"': "&quot;"})
                if re.search(rf"{re.escape(a)}(?=[\"'\s)<]|&quot;)", text):
                    text = re.sub(rf"{re.escape(a)}(?=[\"'\s)<]|&quot;)", lambda _: b, text)
                    found.add(old)
            if text.encode() != data:
                new[i.filename] = text.encode()
        if missing := set(wanted) - found:
            raise ValueError(f"not found: {sorted(missing)}")
        out, heads = io.BytesIO(), []
        for i in infos:
            at = out.tell()
            if i.filename in new:
                one = io.BytesIO()
                with zipfile.ZipFile(one, "w", zipfile.ZIP_DEFLATED) as w:
                    info = zipfile.ZipInfo(i.filename, i.date_time)
                    info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, i.external_attr
                    w.writestr(info, new[i.filename])
                raw = one.getvalue()
                start = raw.rindex(b"PK\x01\x02")
                record, local = raw[start : raw.rindex(b"PK\x05\x06")], raw[:start]
            else:
                if i.extra:
                    raise ValueError(f"{i.filename} has extra fields")
                n, e = struct.unpack_from("<HH", body, i.header_offset + 26)
                size = 30 + n + e + i.compress_size
                if i.flag_bits & 8:
                    tail = i.header_offset + size
                    size += 16 if body[tail : tail + 4] == b"PK\x07\x08" else 12
                local = body[i.header_offset : i.header_offset + size]
                record = _central(body, i.filename)
            out.write(local)
            heads.append(record[:42] + struct.pack("<I", at) + record[46:])
        start = out.tell()
        for h in heads:
            out.write(h)
        size = out.tell() - start
        out.write(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, len(heads), len(heads), size, start, 0))
        return out.getvalue()


def _central(body: bytes, name: str) -> bytes:
    at, raw = struct.unpack_from("<L", body, body.rindex(b"PK\x05\x06") + 16)[0], name.encode()
    while body[at : at + 4] == b"PK\x01\x02":
        n, e, c = struct.unpack_from("<HHH", body, at + 28)
        if body[at + 46 : at + 46 + n] == raw:
            return body[at : at + 46 + n + e + c]
        at += 46 + n + e + c
    raise ValueError(f"no central record of {name}")


def pdf_refusal(body: bytes) -> str | None:
    """Why a PDF is not changed: it is encrypted, signed, or has link annotations that are no objects of their own."""
    if not body.startswith(b"%PDF-"):
        return "it can't be read"
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", body):
        return "encrypted PDF files are not modified"
    objects = pdf_objects(body)
    if any(re.search(rb"/FT\s*/Sig\b", d) or (re.search(rb"/Type\s*/Catalog\b", d) and b"/Perms" in d) for d in objects.values()):
        return "signed PDF files are not modified"
    for d in objects.values():
        if re.search(rb"/Type\s*/Page\b(?!s)", d) and (m := re.search(rb"/Annots\s*\[(.*)", d, re.S)):
            own = m[1][: _closing(m[1])]
            if re.search(rb"<<.*?/Subtype\s*/Link\b", own, re.S):
                return "PDF files with direct link annotations are not modified"
    return None


def _closing(array: bytes) -> int:
    """Where an array ends whose opening bracket has been read."""
    depth = 1
    for m in re.finditer(rb"\((?:[^()\\]|\\.)*\)|[\[\]]", array, re.S):
        depth += (m[0] == b"[") - (m[0] == b"]")
        if not depth:
            return m.start()
    return len(array)


def _link_actions(body: bytes) -> set[int]:
    """Numbers of the objects that hold the URI action of a link annotation: the annotation itself, or its action."""
    objects, out = pdf_objects(body), set()
    for number, d in objects.items():
        if not re.search(rb"/Subtype\s*/Link\b", d):
            continue
        if m := re.search(rb"/A\s+(\d+)\s+\d+\s+R", d):
            if re.search(rb"/S\s*/URI\b", objects.get(int(m[1]), b"")):
                out.add(int(m[1]))
        elif re.search(rb"/S\s*/URI\b", d):
            out.add(number)
    return out


def fix_pdf(body: bytes, wanted: dict[str, str]) -> bytes:
    """An appended update with new versions of the objects whose URI action changes."""
    if why := pdf_refusal(body):
        raise ValueError(why)
    new, found, links = {}, set(), _link_actions(body)
    for m in re.finditer(rb"(\d+)\s+0\s+obj\b(.*?)\bendobj", body, re.S):
        data = m[2]
        if int(m[1]) not in links or not (u := _URI.search(data)):
            continue
        url = pdf_string(u[1])
        if url in wanted:
            to = pdf_encoded(wanted[url])
            new[int(m[1])] = data[: u.start(1)] + b"(" + to + b")" + data[u.end(1) :]
            found.add(url)
    if missing := set(wanted) - found:
        raise ValueError(f"no link annotation: {sorted(missing)}")
    out = bytearray(body + (b"" if body.endswith(b"\n") else b"\n"))
    places = {}
    for n, data in sorted(new.items()):
        places[n] = len(out)
        out += b"%d 0 obj%sendobj\n" % (n, data)
    start = re.findall(rb"startxref\s+(\d+)", body)[-1]
    trailer = re.findall(rb"trailer\s*<<(.*?)>>\s*startxref", body, re.S)
    entries = re.sub(rb"/Prev\s+\d+", b"", trailer[-1]) if trailer else b""
    at = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in sorted(places.items()))
    out += b"trailer\n<<%s /Prev %s>>\nstartxref\n%d\n%%%%EOF\n" % (entries.strip(), start, at)
    return bytes(out)


def pdf_encoded(url: str) -> bytes:
    """A literal string's inside; only characters that stand for themselves in one byte."""
    if any(not 0x20 <= ord(c) < 0x7F for c in url):
        raise ValueError(f"{url} can't be written in a PDF string")
    return url.encode().replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def fixed(body: bytes, kind: str, wanted: dict[str, str]) -> bytes:
    """The document with its URLs replaced, checked by extracting again."""
    if kind in ("markdown", "text"):
        out = fix_text(body, kind, wanted)
    elif kind == "html":
        out = fix_html(body, wanted)
    else:
        out = fix_pdf(body, wanted) if kind == "pdf" else fix_office(body, wanted)
    verify(out, kind, wanted)
    return out


def verify(body: bytes, kind: str, wanted: dict[str, str]) -> None:
    """Every new URL must be there, and no old one, by extracting again."""
    there = {u for u, *_ in EXTRACTORS[kind](body)}
    for old, new in sorted(wanted.items()):
        if new not in there:
            raise ValueError(f"replacement URL was not extractable: {new}")
        if old in there:
            raise ValueError(f"old URL is still extractable: {old}")


def run(docs: DataFrame, replacements: DataFrame) -> DataFrame:
    """docs (path, format, content) and replacements (path, old, new) to (path, format, content, error, diff)."""
    asked = replacements.groupBy("path").agg(F.collect_set(F.struct("old", "new")).alias("asked"))

    schema = pa.schema([("path", pa.string()), ("format", pa.string()), ("content", pa.binary()), ("error", pa.string()), ("diff", pa.string())])

    def work(batches):
        for part in pieces(batches):
            rows = []
            for path, kind, body, asked in zip(part["path"], part["format"], part["content"], part["asked"]):
                wanted, error, out = {}, None, None
                try:
                    for x in asked:
                        if wanted.setdefault(x["old"], x["new"]) != x["new"]:
                            raise ValueError(f"two replacements of {x['old']}")
                    out = fixed(body, kind, wanted)
                except (ValueError, zipfile.BadZipFile) as e:
                    error = str(e)
                diff = None
                if out is not None and kind in ("markdown", "text", "html"):
                    a, b = (x.decode("utf-8", "replace").splitlines(True) for x in (body, out))
                    diff = "".join(difflib.unified_diff(a, b, path, path))
                elif out is not None:
                    diff = "".join(f"{path}: {o} -> {n}\n" for o, n in sorted(wanted.items()))
                rows.append((path, kind, out, error, diff))
            yield made(rows, schema)

    return docs.join(asked, "path").select("path", "format", "content", "asked").mapInArrow(work, "path string, format string, content binary, error string, diff string")


def plan(findings: DataFrame, docs: DataFrame, least: str = "dead-certain", excluded: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(replacements, refused) of a scan's findings, in no order.

    replacements: path, old, new, of fixes that may be made. refused: path, reason, of PDFs that
    are never changed (all documents are looked at, findings or not) and of fixes that are not automatic.
    """
    from linkloom.operators.verdicts import RANK, rank

    rows = findings.select("path", "format", "url", rank(F.col("verdict.confidence")).alias("rank"), "fix.replacement_url", "fix.origin", "fix.fixable")
    rows = selected(rows, RANK[least], list(excluded))
    auto = F.col("fixable.kind") == "auto"
    hand = rows.filter(~auto).select("path", F.when(F.col("fixable.kind") == "manual", "fix requires manual editing").otherwise(F.col("fixable.reason")).alias("reason"))
    none = docs.filter(F.lit("pdf" not in excluded) & (F.col("format") == "pdf")).select("path", "content")

    def look(batches):
        for part in pieces(batches):
            yield made([(p, why) for p, c in zip(part["path"], part["content"]) if (why := pdf_refusal(c))], pa.schema([("path", pa.string()), ("reason", pa.string())]))

    closed = none.mapInArrow(look, "path string, reason string")
    asked = rows.filter(auto).join(closed.select("path"), "path", "left_anti").select("path", F.col("url").alias("old"), F.col("replacement_url").alias("new")).distinct()
    return asked, closed.unionByName(hand)


def copy_name(path: Column) -> Column:
    """stem.fixed.ext"""
    return F.regexp_replace(path, r"^(.*/)?([^/]+?)(\.[^./]*)?$", "$1$2.fixed$3")
