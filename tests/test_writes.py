"""Files written in two phases, reports written in shards, digests of sets."""

import json
import os
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom.operators import commit
from linkloom.operators import verdicts as vx
from linkloom.plans import digest, report
from linkloom.tables import Scratch


@pytest.fixture
def tree(tmp_path):
    for k in range(40):
        (tmp_path / f"{k}.md").write_text(f"old {k}")
    os.chmod(tmp_path / "1.md", 0o600)
    return tmp_path


def _files(spark, tree, n=40):
    return spark.createDataFrame([(str(tree / f"{k}.md"), f"new {k}".encode()) for k in range(n)], "path string, content binary").repartition(4)


def _texts(tree):
    return {p.name: p.read_text() for p in tree.iterdir()}


OLD = {f"{k}.md": f"old {k}" for k in range(40)}
NEW = {f"{k}.md": f"new {k}" for k in range(40)}


def test_a_stop_between_or_in_the_phases_is_made_good(spark, tree):
    with Scratch(spark) as own:
        journal = own.settle(commit.staged(_files(spark, tree), "run"), "journal")
        assert {k: v for k, v in _texts(tree).items() if k in OLD} == OLD  # nothing is in place yet
        half = journal.filter("pmod(xxhash64(path), 2) = 0")
        assert commit.committed(half).filter("error is not null").count() == 0  # then the tasks are lost
        some = {k: v for k, v in _texts(tree).items() if k in OLD}
        assert 0 < sum(some[k] == NEW[k] for k in OLD) < 40 and all(some[k] in (OLD[k], NEW[k]) for k in OLD)
        assert own.settle(commit.committed(journal), "written").filter("error is null").count() == 40
        assert own.settle(commit.committed(journal), "written").filter("error is null").count() == 40  # again, without harm
        commit.cleared(journal).count()
    assert _texts(tree) == NEW and os.stat(tree / "1.md").st_mode & 0o777 == 0o600


def test_staging_again_and_two_attempts_at_once(spark, tree):
    with Scratch(spark) as own:
        journal = own.settle(commit.staged(_files(spark, tree), "run"), "journal")
        again = own.settle(commit.staged(_files(spark, tree), "run"), "journal")
        assert {tuple(r) for r in journal.collect()} == {tuple(r) for r in again.collect()}
        found = []
        both = [threading.Thread(target=lambda: found.append(commit.committed(journal, backup=True).collect())) for _ in range(2)]
        for t in both:
            t.start()
        for t in both:
            t.join()
        assert [r.error for rows in found for r in rows] == [None] * 80
        commit.cleared(journal).count()
    assert _texts(tree) == NEW | {f"{k}.bak": v for k, v in OLD.items()}


def test_restoring_and_files_that_changed_meanwhile(spark, tree):
    with Scratch(spark) as own:
        journal = own.settle(commit.staged(_files(spark, tree), "run"), "journal")
        (tree / "3.md").write_text("by another")
        done = {os.path.basename(r.path): r.error for r in commit.committed(journal).collect()}
        assert done == dict.fromkeys(OLD) | {"3.md": "changed meanwhile"}
        for _ in range(2):
            assert commit.restored(journal).filter("error is not null").count() == 0
            assert {k: v for k, v in _texts(tree).items() if k in OLD} == OLD | {"3.md": "by another"}
        commit.cleared(journal).count()
    assert set(_texts(tree)) == set(OLD)


def test_writing_counts_what_failed(spark, tree):
    (tree / "2.fixed.md").write_text("there")
    with Scratch(spark) as own:
        done = commit.write(_files(spark, tree, 3), own, copy=True)
        assert {r.path: r.error for r in done.collect()} == {str(tree / "0.md"): None, str(tree / "1.md"): None, str(tree / "2.md"): "exists"}
        none = done.filter("false")
        assert tuple(commit.outcome(done, none).first()) == (2, 1, 0, 1) and tuple(commit.outcome(none, done.select("path")).first()) == (0, 0, 3, 1)
        assert tuple(commit.outcome(done.filter("error is null"), none).first()) == (2, 0, 0, 0) and tuple(commit.outcome(none, none).first()) == (0, 0, 0, 0)
    assert _texts(tree) == OLD | {"0.fixed.md": "new 0", "1.fixed.md": "new 1", "2.fixed.md": "there"}


def test_backups_are_the_old_files_and_writes_are_dealt_out(spark, tmp_path):
    from linkloom.operators import commit
    from linkloom.tables import Scratch

    for k in range(200):
        (tmp_path / f"{k}.md").write_text(f"old {k}")
    nodes = {os.stat(tmp_path / f"{k}.md").st_ino for k in range(200)}
    new = spark.range(200, numPartitions=1).selectExpr(f"concat('{tmp_path}/', id, '.md') path", "cast(concat('new ', id) as binary) content")
    with Scratch(spark) as own:
        done = commit.write(new, own, backup=True)
        assert done.filter("error is null").count() == 200
        assert sum(name.startswith("part-") for name in os.listdir(own.held[id(done)][1])) > 1
    assert {p.read_text() for p in tmp_path.glob("*.md")} == {f"new {k}" for k in range(200)}
    assert {(p.name, p.read_text()) for p in tmp_path.glob("*.bak")} == {(f"{k}.md.bak", f"old {k}") for k in range(200)}
    assert {os.stat(p).st_ino for p in tmp_path.glob("*.bak")} == nodes and len(os.listdir(tmp_path)) == 400  # not written again


def _found(spark, n):
    k = F.col("id")
    place = F.struct(F.lit("text").alias("type"), k.alias("line"), F.lit(1).alias("column"), *(F.lit(None).cast("string").alias(c) for c in ("page", "annotation", "paragraph", "sheet", "cell", "slide")))
    said = F.when(k % 2 == 0, vx.verdict("http-status", F.lit("404"), "status", F.lit("404"), 1)).otherwise(vx.verdict("network-error", F.lit("dns"), "status", F.lit('"é"\n'), 1)).withField("checked_at", F.lit("2027-01-01").cast("timestamp"))
    fix = F.lit(None).cast("struct<replacement_url:string,origin:string,fixable:struct<kind:string,reason:string>>")
    return spark.range(n).repartition(7).select(F.concat(F.lit("d "), (k % 9).cast("string")).alias("path"), F.lit("markdown").alias("format"), F.concat(F.lit("https://h.test/"), k.cast("string")).alias("url"), F.lit(None).cast("string").alias("resolved_url"), place.alias("location"), F.lit(0).cast("long").alias("start"), F.lit(5).cast("long").alias("end"), said.alias("verdict"), fix.alias("fix"))


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_reports_in_shards_equal_whole_ones(spark, tmp_path, n):
    found = _found(spark, n)
    run = dict.fromkeys(("files_scanned", "links_checked", "links_unique"), n)
    for document, at in ((report.json_document(found, run), "findings"), (report.sarif_document(found, 1), "results")):
        document.write(str(tmp_path / "r.json"))
        text = (tmp_path / "r.json").read_text()
        whole = json.loads(text)
        assert text == document.text() == json.dumps(whole, indent=2) + "\n"  # as one writer would put it
        rows = whole["findings"] if at == "findings" else whole["runs"][0]["results"]
        assert len(rows) == n
        urls = [x["url"] if at == "findings" else x["properties"]["url"] for x in rows]
        assert urls == [f"https://h.test/{k}" for k in sorted(range(n), key=lambda k: (k % 9, k))]
    assert os.listdir(tmp_path) == ["r.json"]


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_reports_are_read_again_by_their_objects(spark, tmp_path, n):
    found = _found(spark, n)
    run = dict.fromkeys(("files_scanned", "links_checked", "links_unique"), n)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        for document, name in ((report.json_document(found, run), "findings"), (report.sarif_document(found, 1), "results")):
            document.write(str(tmp_path / "r.json"))
            whole = json.loads((tmp_path / "r.json").read_text())
            held = whole if name == "findings" else whole["runs"][0]
            rows, held[name] = held[name], []
            around, each = report.objects(spark, str(tmp_path / "r.json"), name)
            assert around == whole
            got = [r.text for r in each.collect()]
            order = lambda x: json.dumps(x, sort_keys=True)
            assert sorted(map(json.loads, got), key=order) == sorted(rows, key=order)
            assert n < 3000 or each.rdd.getNumPartitions() > 3  # no task holds the report
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "r.json").write_text('{"findings": [{}, {}]')
    with pytest.raises(ValueError, match="no report"):
        report.objects(spark, str(tmp_path / "r.json"), "findings")


def test_registered_reports_are_not_read_whole(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    from linkloom import document_queries

    seen, text = [], DataFrameReader.text
    monkeypatch.setattr(DataFrameReader, "text", lambda self, *a, **b: seen.append(b) or text(self, *a, **b))
    for name in ("json_report_file", "sarif_report_file"):
        getattr(document_queries, name)(spark, "/root/testdata/sf0.001")
    assert seen and not any(b.get("wholetext") for b in seen)


def test_a_report_that_fails_leaves_the_old_one(spark, tmp_path):
    at = tmp_path / "r.json"
    at.write_text("old")
    bad = report.Document("{", spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("text")), "}", "{}")
    with pytest.raises(Exception, match="no"):
        bad.write(str(at))
    assert at.read_text() == "old" and os.listdir(tmp_path) == ["r.json"]


def test_digests_do_not_depend_on_order_or_partitions(spark):
    import hashlib

    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice(["x", "y", None]), r.randint(0, 5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, a string, b long")
    want = {}
    for k in "ab":
        sums = [0, 0]
        for _, a, b in [x for x in rows if x[0] == k]:
            m = hashlib.md5(f"{a or ''}\x1f{b}".encode()).hexdigest()
            sums = [(s + int(m[i * 16 : i * 16 + 16], 16)) % (1 << 64) for i, s in enumerate(sums)]
        want[k] = "".join(f"{s:016x}" for s in sums)
    for n in (1, 3, 8):
        assert {x.k: x.digest for x in digest.digested(df.repartition(n), ["a", "b"], ["k"]).collect()} == want
    assert {x.k: x.digest for x in digest.digested(df.limit(499), ["a", "b"], ["k"]).collect()} != want
    got = [(x.a, x.b, x.place) for x in digest.numbered(df.select("a", "b"), ["a", "b"]).orderBy("place").collect()]
    assert [x[2] for x in got] == list(range(1, 501)) and Counter(x[:2] for x in got) == Counter(x[1:] for x in rows)
    records = [f"{a or ''}\x1f{b}" for a, b, _ in got]
    assert records == sorted(records) and digest.numbered(df.limit(0), ["a"]).count() == 0
