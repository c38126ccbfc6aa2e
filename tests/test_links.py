"""Extractors, fixers, local checks, configuration, on documents made here."""

import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.functions import text as tx
from linkloom.operators import extract as ex
from linkloom.operators import fixes
from linkloom.plans import config

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def rel(i, target, external=True):
    return f'<Relationship Id="{i}" Type="t" Target="{target}"' + (' TargetMode="External"/>' if external else "/>")


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def urls(kind, body):
    return [u for u, *_ in ex.EXTRACTORS[kind](body)]


def test_text_trims_and_counts_characters():
    rows = list(ex.text_links("é http://a.test/x. (see https://b.test/y_(z)) https://.".encode()))
    assert [r[0] for r in rows] == ["http://a.test/x", "https://b.test/y_(z)"]
    assert rows[0][1]["column"] == 3 and rows[0][2] == 3


def test_markdown_forms():
    body = "[a](<https://a.test/x y> 't') ![i](/img.png) <https://c.test> [D][ß] [d] `[no](/no)`\n\n[SS]: https://d.test/q&amp;r \"https://title.test\"\n[d]: /d\n\n```\nhttps://code.test\n```\nhttps://bare.test.\n".encode()
    rows = list(ex.markdown_links(body))
    assert [r[0] for r in rows] == ["https://a.test/x y", "/img.png", "https://c.test", "https://d.test/q&r", "/d", "https://bare.test"]
    assert body[rows[3][2] : rows[3][3]] == b"https://d.test/q&amp;r"


def test_markdown_is_read_in_linear_time():
    import time

    for body in ("[" * 100_000, "[a](" * 25_000, "[" * 50_000 + "]" * 50_000, "".join("`" * (i % 300 + 1) + "a" for i in range(2000)), "x\n\n    y\n\n" * 20_000, "[a](x (" * 15_000):
        began = time.time()
        assert urls("markdown", body.encode()) == []
        assert time.time() - began < 5
    deep = "(" * 32 + ")" * 32
    assert urls("markdown", f"[a](/x{deep}) [b](/y({deep}))".encode()) == [f"/x{deep}"]
    assert urls("markdown", b"``[a](/x) ` [b](/y)`` `[c](/z)` [d](/w) ` [e](/v)") == ["/w", "/v"]


def test_reference_used_twice_is_one_link():
    assert urls("markdown", b"[x][r] [y][r]\n\n[r]: https://a.test\n") == ["https://a.test"]


def test_html_attributes():
    body = b"<A HREF='https://a.test?x=1&amp;y'>t</A><img src=/b.png><!-- <a href=\"/no\"> --><script>'<a href=\"/no\">'</script><a href=\"javascript:x\">"
    rows = list(ex.html_links(body))
    assert [r[0] for r in rows] == ["https://a.test?x=1&y", "/b.png"]
    assert body[rows[1][2] : rows[1][3]] == b"/b.png"


def docx():
    doc = f'<w:document xmlns:w="{W}" xmlns:r="{R}"><w:p><w:hyperlink r:id="r1"/></w:p><w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:instrText>HYPERLINK "https://f</w:instrText><w:instrText>.test/x"</w:instrText><w:fldChar w:fldCharType="end"/><w:fldSimple w:instr="HYPERLINK https://s.test"/></w:p></w:document>'
    return packed({"word/document.xml": doc, "word/_rels/document.xml.rels": RELS.format(rel("r1", "https://a.test/1")), "word/media/x.bin": b"\0\1"})


def test_docx():
    rows = list(ex.docx_links(docx()))
    assert [(r[0], r[1]["paragraph"]) for r in rows] == [("https://a.test/1", 1), ("https://f.test/x", 2), ("https://s.test", 2)]


def test_xlsx_and_pptx():
    x = packed({"xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="One" r:id="a"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": RELS.format(rel("a", "./worksheets/s.xml", False)), "xl/worksheets/s.xml": f'<worksheet xmlns="{S}" xmlns:r="{R}"><c r="B2"><f>HYPERLINK("https://f.test","t")</f></c><hyperlink ref="A1" r:id="z"/></worksheet>', "xl/worksheets/_rels/s.xml.rels": RELS.format(rel("z", "https://h.test"))})
    assert [(u, p["cell"]) for u, p, *_ in ex.xlsx_links(x)] == [("https://f.test", "B2"), ("https://h.test", "A1")]
    slide = f'<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}"><a:hlinkClick r:id="l"/></p:sld>'
    p = packed({"ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldId r:id="b"/><p:sldId r:id="a"/></p:presentation>', "ppt/_rels/presentation.xml.rels": RELS.format(rel("a", "slides/slide1.xml", False) + rel("b", "slides/slide2.xml", False)), "ppt/slides/slide1.xml": slide, "ppt/slides/slide2.xml": slide, "ppt/slides/_rels/slide1.xml.rels": RELS.format(rel("l", "https://one.test")), "ppt/slides/_rels/slide2.xml.rels": RELS.format(rel("l", "https://two.test"))})
    assert [(u, p["slide"]) for u, p, *_ in ex.pptx_links(p)] == [("https://two.test", 1), ("https://one.test", 2)]


PDF = b"%PDF-1.4\n1 0 obj\n<</Type /Page /Annots [2 0 R] /Contents 3 0 R>>\nendobj\n2 0 obj\n<</Subtype /Link /A <</S /URI /URI (https://a.test/old)>> >>\nendobj\n3 0 obj\n<</Length 40>>\nstream\nBT (see https://t.test/x) Tj ET\nendstream\nendobj\nxref\n0 1\ntrailer\n<</Root 1 0 R>>\nstartxref\n9\n%%EOF\n"


def test_pdf():
    rows = [(u, p["annotation"]) for u, p, *_ in ex.pdf_links(PDF)]
    assert rows == [("https://a.test/old", 0), ("https://t.test/x", None)]
    out = fixes.fix_pdf(PDF, {"https://a.test/old": "https://a.test/new"})
    assert out.startswith(PDF) and out.count(b"%%EOF") == 2
    assert "https://a.test/new" in urls("pdf", out)
    assert fixes.pdf_refusal(b"%PDF-1.4 /Encrypt 4 0 R") == "encrypted PDF files are not modified"


def test_malformed_part_names_itself():
    with pytest.raises(ValueError, match="word/document.xml"):
        list(ex.docx_links(packed({"word/document.xml": "<a>"})))


def test_fix_office_keeps_other_members():
    before = docx()
    after = fixes.fixed(before, "docx", {"https://a.test/1": "https://n.test/?a=1&b"})
    assert urls("docx", after)[0] == "https://n.test/?a=1&b"
    with zipfile.ZipFile(io.BytesIO(after)) as z:
        assert z.testzip() is None and z.read("word/media/x.bin") == b"\0\1"


def test_fix_html_and_refusals():
    assert fixes.fixed(b"<a href=https://o.test>x</a>", "html", {"https://o.test": "https://n.test/a?b&c"}) == b"<a href=https://n.test/a?b&amp;c>x</a>"
    with pytest.raises(ValueError):
        fixes.fixed(rb"[a](https://a.test/\(x\))", "markdown", {"https://a.test/(x)": "https://b.test"})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.one_of(st.none(), st.binary(max_size=4))), max_size=8))
def test_edits_replace_pieces_of_a_body(pieces):
    """A body of pieces, some of which are replaced: the result is the new pieces in their order."""
    body = b"".join(old for old, _ in pieces)
    ends = [sum(len(old) for old, _ in pieces[: i + 1]) for i in range(len(pieces))]
    edits = [(end - len(old), end, new) for (old, new), end in zip(pieces, ends) if new is not None and old]
    assert fixes.apply_edits(body, edits[::-1]) == b"".join(new if new is not None and old else old for old, new in pieces)


def test_edit_errors():
    for edits in ([(0, 3, b""), (2, 4, b"")], [(1, 1, b"a"), (1, 1, b"b")], [(0, 9, b"")]):
        with pytest.raises(ValueError):
            fixes.apply_edits(b"12345", edits)


def test_slugs_are_made_different():
    assert tx.numbered(["intro", "intro-1", "intro", "x", "intro"]) == ["intro", "intro-1", "intro-2", "x", "intro-3"]


def test_config(tmp_path):
    (tmp_path / "linkloom.toml").write_text("[network]\ntimeout = '5s'\nretries = 7\n[ignore]\nexclude-domain = ['a.test']\n")
    found = config.load({"network_timeout": "1s", "ignore_exclude_domain": ["b.test"]}, str(tmp_path), env={"LINKLOOM_NETWORK_RETRIES": "3", "LINKLOOM_IGNORE_LOCAL_LINKS": "true"})
    assert (found.network_timeout, found.network_retries, found.network_per_host, found.ignore_local_links) == (1.0, 3, 4, True)
    assert found.ignore_exclude_domain == ("b.test", "a.test")
    for text, known in (("[network]\nretrys = 5\n", "network.retries"), ("[netwrok]\n", "network")):
        (tmp_path / "linkloom.toml").write_text(text)
        with pytest.raises(ValueError, match=known):
            config.load({}, str(tmp_path), env={})
    assert [config.duration(x) for x in ("30s", "1h 30m", "500ms", "2d", "7")] == [30, 5400, 0.5, 172800, 7] and config.said(5400.5) == "1h 30m 500ms"
    assert config.words(" a, ,b ") == ["a", "b"]
    with pytest.raises(ValueError):
        config.duration("5 parsecs")


def test_scan_and_fix_run(spark, tmp_path):
    from linkloom.plans import report
    from linkloom.plans.scan import flat, scan
    from linkloom.sources import files

    (tmp_path / "a.md").write_text("# Head\n[x](b.html#nope) [y](missing.md) [z](#head) [m](mailto:bad) https://h.test/old\n")
    (tmp_path / "b.html").write_text("<a id=top href='https://h.test/old'>")
    (tmp_path / "c.bin").write_bytes(b"\0\1\2")
    docs = files.detected(files.walk(spark, [str(tmp_path)], exclude=["*.bin"]))
    obs = spark.createDataFrame([("https://h.test/old", 404, None, None)], "url string, status int, termination string, error_kind string")
    out = scan(docs, obs)
    found = out.findings
    got = sorted((r.url, r.verdict.reason.kind) for r in found.collect())
    assert out.run.first().links_unique == 5
    assert got == [("b.html#nope", "local-missing"), ("https://h.test/old", "http-status"), ("https://h.test/old", "http-status"), ("mailto:bad", "syntax-invalid"), ("missing.md", "local-missing")]
    assert report.table(flat(found)).startswith("CONFIDENCE")
    assert '"SL0401"' in report.sarif(found)
    said = json.loads(report.json_report(found, out.run.first().asDict()))
    assert said["run"]["findings_by_confidence"]["dead_certain"] == 5 and {"url", "resolved_url", "source", "verdict", "fix"} == set(said["findings"][0])
    wanted = docs.select("path").selectExpr("path", "'https://h.test/old' as old", "'https://h.test/new' as new")
    fixed = fixes.run(docs, wanted).collect()
    assert all(r.error is None and b"h.test/new" in bytes(r.content) for r in fixed) and len(fixed) == 2


def test_probe_judges_a_local_server(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from linkloom.operators import probe

    class H(BaseHTTPRequestHandler):
        def do_GET(self):
            to = {"/a": "/ok", "/loop": "/loop"}.get(self.path)
            self.send_response(301 if to else 200 if self.path == "/ok" else 404)
            if to:
                self.send_header("Location", to)
            self.end_headers()

        do_HEAD = do_GET

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    see = lambda p: probe.observe(base + p, "HEAD", 5, "t")
    assert see("/a")["status"] == 200 and len(see("/a")["hops"]) == 1
    assert see("/loop")["termination"] == "redirect loop detected" and see("/x")["status"] == 404
    server.shutdown()


def test_following_a_folder(spark, tmp_path):
    from linkloom.streaming.follow import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("https://a.test/1")
    follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert [r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["https://a.test/1"]


def test_redirect_closures_of_long_chains_and_loops(spark):
    """Chains of 40 keys that end in a loop or a terminal, more rows than a recursive query may have."""
    from linkloom.operators import verdicts

    to = {k: k - 1 if k % 40 == 39 else k + 1000000 if k % 40 == 0 else k + 1 for k in range(400)}
    want = set()
    for k in to:
        path, end = [k], None
        while end is None:
            if path[-1] in path[:-1]:
                end = "loop"
            elif len(path) > 11:
                end = "limit"
            elif path[-1] not in to:
                end = "terminal"
            else:
                path.append(to[path[-1]])
        want |= {(f"u{k}", i, f"u{x}", end if i == len(path) - 1 else None) for i, x in enumerate(path)}
    assert {x[3] for x in want} == {None, "loop", "limit", "terminal"}
    edges = spark.createDataFrame([(f"u{a}", f"u{b}") for a, b in to.items()], "url string, target string")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        got = [(r.start, r.hop, r.url, r.end) for r in verdicts.closures(edges).collect()]
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert len(got) == len(want) and set(got) == want


def test_commands(spark, tmp_path, monkeypatch, capsys):
    from linkloom.__main__ import main

    monkeypatch.setenv("LINKLOOM_CACHE_DIR", str(tmp_path / "cache"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/.gitignore").write_text("skip.md\nout/\n")
    (tmp_path / "d/a.md").write_text("[x](b.md) https://h.test/old\n")
    (tmp_path / "d/skip.md").write_text("[x](gone.md)")
    seen = str(tmp_path / "seen")
    rows = [("https://h.test/old", "HEAD", 200, [], "https://h.test/old"), ("https://h.test/old", "GET", 200, [(301, "https://h.test/new")], "https://h.test/new")]
    spark.createDataFrame(rows, "url string, method string, status int, hops array<struct<status:int,url:string>>, final_url string").write.parquet(seen)
    run = lambda *args: main([*args, str(tmp_path / "d"), "--observations", seen], spark)
    report = tmp_path / "r.json"
    assert run("scan", "--json", "-o", str(report)) == 1
    said = json.loads(report.read_text())
    assert {x["url"] for x in said["findings"]} == {"b.md", "https://h.test/old"} and said["run"]["files_scanned"] == 2
    assert run("scan", "--fail-on", "dead-certain", "--no-local") == 0  # from the cache
    assert "OUTDATED" in capsys.readouterr().out
    assert run("fix") == 0 and capsys.readouterr().out == ""  # only dead-certain fixes without a word
    assert run("fix", "--min-fix-confidence", "outdated") == 0 and "+[x](b.md) https://h.test/new" in capsys.readouterr().out
    assert run("fix", "--write", "--backup", "--min-fix-confidence", "outdated") == 0
    assert (tmp_path / "d/a.md").read_text() == "[x](b.md) https://h.test/new\n" and (tmp_path / "d/a.md.bak").exists()
    assert main(["cache", "stats"], spark) == 0 and "entries: 1" in capsys.readouterr().out
    assert main(["cache", "clear"], spark) == 0 and not (tmp_path / "cache").exists()
    assert main(["scan", "--format", "nothing"], spark) == 2 and main(["scan", str(tmp_path / "none")], spark) == 3


def test_listing_honours_ignore_files(spark, tmp_path):
    from linkloom.sources import listing

    for name in ("a.md", "b.txt", "x/c.md", "x/keep.log", "x/no.log", "out/d.md", ".hidden.md", "a-b/e.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / ".ignore").write_text("# comment\n*.log\n!keep.log\n/out/\n")
    for parts in (1, 2, 50):
        got = [r.path[len(str(tmp_path)) + 1 :] for r in listing.listed(spark, [str(tmp_path), str(tmp_path / "out/d.md")], exclude=["*.txt"], parts=parts).collect()]
        assert got == [".hidden.md", ".ignore", "a-b/e.md", "a.md", "out/d.md", "x/c.md", "x/keep.log"]
    got = [r.path[len(str(tmp_path)) + 1 :] for r in listing.listed(spark, [str(tmp_path / "x"), str(tmp_path), str(tmp_path)]).collect()]  # rules of the folder above hold
    assert [p for p in got if p.startswith("x/")] == ["x/c.md", "x/keep.log"] and len(set(got)) == len(got)
    got = [".hidden.md", ".ignore", "a-b/e.md", "a.md", "out/d.md", "x/c.md", "x/keep.log"]
    assert got == [".hidden.md", ".ignore", "a-b/e.md", "a.md", "out/d.md", "x/c.md", "x/keep.log"]


def test_settings_of_many_rows_are_loaded_once_each(spark, tmp_path):
    from linkloom.tables import Scratch

    (tmp_path / config.FILE).write_text("[network]\nretries = 5\n")
    rows = spark.range(600).selectExpr("id", "if(id % 2 = 0, '{\"network_retries\": 7, \"fix_write\": true}', null) flags", f"'{tmp_path}' start", "if(id % 3 = 0, '{\"LINKLOOM_NETWORK_RETRIES\": \"6\", \"LINKLOOM_IGNORE_EXCLUDE\": \"a, b\"}', null) env")
    with Scratch(spark) as own:
        got = config.loaded(rows, own).collect()
        assert own.tables()[0].count() == 4
    assert len(got) == 600
    for r in got:
        want = config.load({"network_retries": 7, "fix_write": True} if r.id % 2 == 0 else {}, str(tmp_path), env={"LINKLOOM_NETWORK_RETRIES": "6", "LINKLOOM_IGNORE_EXCLUDE": "a, b"} if r.id % 3 == 0 else {})
        assert {k: tuple(v) if isinstance(v, list) else v for k, v in r.settings.asDict().items()} == vars(want)


def test_fixes_are_made_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    from linkloom.operators import batches as bx

    docs = spark.createDataFrame([("a.txt", "text", b"")], "path string, format string, content binary")
    asked = spark.createDataFrame([("a.txt", "x", "y")], "path string, old string, new string")
    held = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: held.append(f))
    fixes.run(docs, asked)
    rows = [(f"{k}.txt", "text", b"see https://o.test/%d" % k, [{"old": f"https://o.test/{k}", "new": f"https://n.test/{k}"}]) for k in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["path", "format", "content", "asked"])
    out = list(held[0]([batch]))
    assert max(b.num_rows for b in out) <= bx.ROWS and [c for b in out for c in b.column(2).to_pylist()] == [b"see https://n.test/%d" % k for k in range(1000)]


def test_batches_of_documents_are_read_in_pieces():
    import pyarrow as pa

    from linkloom.operators import batches as bx

    bodies = [b"see https://h.test/%d" % k for k in range(3000)] + [b"https://big.test/ " + b"x" * (bx.BYTES + 1), None, b""]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(bodies))]), pa.array(["text"] * len(bodies)), pa.array(bodies, pa.binary())], names=["path", "format", "content"])
    parts = list(bx.pieces([batch, batch.slice(0, 0)]))
    assert [c for p in parts for c in p["content"]] == bodies and max(len(p["path"]) for p in parts) == bx.ROWS
    assert all(sum(len(c or b"") for c in p["content"]) <= bx.BYTES or len(p["content"]) == 1 for p in parts)
    for with_anchors in (False, True):
        out = list(ex.found([batch], "failfast", with_anchors))
        assert max(b.num_rows for b in out) <= bx.ROWS  # one link a document
        assert [u for b in out for u in b.column(2).to_pylist()] == [*(f"https://h.test/{k}" for k in range(3000)), "https://big.test/"]


def test_fixes_of_many_documents(spark):
    docs = spark.range(2000, numPartitions=1).selectExpr("concat(id, '.txt') path", "'text' format", "cast(concat('see https://o.test/', id) as binary) content")
    asked = spark.range(2000).selectExpr("concat(id, '.txt') path", "concat('https://o.test/', id) old", "concat('https://n.test/', id) new")
    assert {(r.path, bytes(r.content).decode()) for r in fixes.run(docs, asked).collect()} == {(f"{k}.txt", f"see https://n.test/{k}") for k in range(2000)}


def test_many_ignore_rules_are_looked_up(spark, tmp_path):
    import time

    from linkloom.sources import listing

    (tmp_path / "d").mkdir()
    for k in range(1500):
        (tmp_path / f"d/{k}.txt").write_text("x")
    (tmp_path / "d/.ignore").write_text("*.txt\n" + "".join(f"!{k}.txt\n" for k in range(0, 7 * 40_000, 7)))
    began = time.time()
    got = {r.path.rsplit("/", 1)[1] for r in listing.listed(spark, [str(tmp_path)], exclude=[".ignore"], parts=1).collect()}
    assert got == {f"{k}.txt" for k in range(0, 1500, 7)}
    assert time.time() - began < 60  # every rule for every file: 60 million searches


def test_ignore_rules_by_table_decide_as_in_turn(tmp_path):
    import random
    import re

    from linkloom.sources import files, listing

    deal = random.Random(3)
    names = ["a", "b.md", "c d", "a/b.md", "a/c d/x", "x", "q[1"]
    lines = [deal.choice(["", "!"]) + deal.choice(["", "/"]) + deal.choice([*names, "*.md", "**/x", "a/*", "?", "[ab]*"]) + deal.choice(["", "", "/"]) for _ in range(400)]
    paths = [p + x for p in ("a", "b.md", "c d", "x", "q[1") for x in ("", "/a", "/b.md", "/c d", "/c d/x", "/a/b.md")]
    for at in range(0, 400, 8):
        (tmp_path / ".ignore").write_text("\n".join(lines[at : at + 8]) + "\n")
        rules = listing.Rules(str(tmp_path))
        for path in paths:
            for is_folder in (False, True):
                want = None
                for line in lines[at : at + 8]:
                    negated, line = line.startswith("!"), line.lstrip("!")
                    only, line = line.endswith("/"), line.rstrip("/")
                    expression = files.glob_regex(line.lstrip("/"))
                    if "/" in line:
                        expression = "^" + expression[7:]
                    if (is_folder or not only) and re.search(expression, path):
                        want = not negated
                assert rules.said(f"{tmp_path}/{path}", is_folder) == want, (lines[at : at + 8], path)


def test_files_of_a_large_folder_are_dealt_out(spark, tmp_path, monkeypatch):
    import json

    from linkloom.sources import listing

    monkeypatch.setattr(listing, "SHARE", 10)
    for k in range(95):
        (tmp_path / f"{k}.md").write_text("x")
    reader = listing.Reader({"tops": json.dumps([str(tmp_path)]), "parts": "4"})
    parts = reader.partitions()
    each = [[p for p, _ in reader.read(part)] for part in parts]
    assert len(parts) == 4 and all(each) and sorted(p for x in each for p in x) == sorted(str(x) for x in tmp_path.iterdir())


def test_html_values_and_comments():
    body = b'<a href=https://a.test/b"c>x</a><img alt="a>b" src=\'/i\'><a title=it\'s href="/t"><!-- <a href="/no">'
    assert urls("html", body) == ['https://a.test/b"c', "/i", "/t"]
    assert urls("html", b"<!--><a href=/yes><!-- x --!><a href=/too><title><a href=/no></title>") == ["/yes", "/too"]


def test_markdown_with_many_links_is_not_quadratic():
    body = "".join(f"[{i}]: https://d.test/{i}\n" for i in range(3000)) + "".join(f"[x][{i}] https://b.test/{i}\n" for i in range(3000))
    assert len(urls("markdown", body.encode())) == 6000


def test_pdf_refusals_and_link_objects():
    from linkloom import document_queries as dq

    assert fixes.pdf_refusal(dq.pdf(1, "https://x.test")) is None
    for more, notes, why in (("/Perms <<>>", "4 0 R", "signed"), ("", "<</Subtype /Link /A <</S /URI /URI (https://x.test)>> >>", "direct")):
        assert why in fixes.pdf_refusal(dq.pdf(1, "https://x.test", more, notes))
    other = dq.pdf(1, "https://x.test").replace(b"<</X 1>>", b"<</S /URI /URI (https://only.test)>>")
    with pytest.raises(ValueError, match="no link annotation"):  # no annotation names that action
        fixes.fix_pdf(other, {"https://only.test": "https://n.test"})


def test_only_neighbours_and_earlier_long_edits_overlap(spark):
    rows = [("a", 0, 100), ("a", 5, 10), ("a", 20, 30), ("a", 100, 101), ("b", 3, 3), ("b", 3, 3)]
    got = {tuple(r) for r in fixes.overlaps(spark.createDataFrame(rows, "path string, start long, end long")).collect()}
    assert got == {("a", 5, 10), ("a", 20, 30), ("b", 3, 3)}


def test_cookie_files_and_headers():
    from linkloom.sources import cookies

    rows = cookies.parsed('[["a.test", "x", "1"], [".b.test", "y", "2"]]') + cookies.parsed('[{"domain": "a.test", "path": "/p", "secure": true, "expires": 50, "name": "z", "value": "3"}]')
    see = lambda url, now=10: cookies.header(rows, url, now)
    assert see("https://a.test/p/q") == "x=1; z=3" and see("http://a.test/p") == "x=1" and see("https://a.test/pq") == "x=1"
    assert see("https://a.test/p", 60) == "x=1" and see("https://s.a.test/") == "" and see("https://s.b.test/") == "y=2" and see("https://xb.test/") == ""
