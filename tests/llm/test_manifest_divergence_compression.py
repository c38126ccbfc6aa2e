"""Operators 11 to 13 against plain versions, held-out labels, and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from linkloom.llm import compression, divergence, merkle, queries

DATA = Path("/root/testdata/sf0.01")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `leaf` string, `term` string, `_path` string, `score` double"
R = random.Random(7)
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def _path(levels, i):
    out = ""
    for nodes in levels[:-1]:
        out += ("=" if i ^ 1 >= len(nodes) else "<>"[i % 2 == 0] + nodes[i ^ 1])
        i //= 2
    return out


def test_paths_advance_leaf_by_leaf():
    for n in [*range(1, 70), 255, 256, 257, 1000]:
        nodes = [H(str(i)) for i in range(n)]
        levels = _levels(nodes)
        top = merkle.height(n)
        assert merkle.root(nodes, top) == levels[-1][0]
        assert list(merkle.paths(nodes, top)) == [_path(levels, i) for i in range(n)]


def test_a_block_keeps_few_nodes(monkeypatch):
    held, step = [], merkle.Tree.step

    def seen(self):
        out = step(self)
        held.append(len(self.stack))
        return out

    monkeypatch.setattr(merkle.Tree, "step", seen)
    nodes = [H(str(i)) for i in range(1 << 10)]
    assert sum(1 for _ in merkle.paths(nodes, 10)) == 1024
    assert max(held) <= 11


def _odd(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 0.5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    rows = [(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(2500)]  # three blocks
    rows += [(i, "é🤖" * (i % 5), "fr", None, None) for i in range(5)] + [(7, "same", "de", "a", 4)] * 3 + [(None, None, None, None, None), (None, "", None, "", 0), (-3, "neg", "", "a", 2**63 - 1), (9, "x" * 300_000, "one", "a", 300_000)]
    R.shuffle(rows)
    return rows


def test_merkle_equals_whole_trees(spark, odd_rows):
    said = lambda *v: H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))
    groups = defaultdict(list)
    for i, text, lang, source, n in odd_rows:
        bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        leaf = said(i, source, lang, n, text)
        groups[lang].append((i is not None, i or 0, leaf, said(i, source, lang, n if n is None else n + 1, text) if bad else leaf))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: _levels([x[2] for x in sorted(groups[k])]) for k in names}
    top = _levels([trees[k][-1][0] for k in names])
    want = Counter()
    for place, k in enumerate(names):
        for at, (there, i, leaf, other) in enumerate(sorted(groups[k])):
            path = _path(trees[k], at) + _path(top, place)
            node = other
            for side, beside in re.findall("([<>=])([0-9a-f]*)", path):
                node = H(beside + node) if side == "<" else H(node + beside)
            want[i if there else None, leaf, trees[k][-1][0], top[-1][0], H(re.sub("[<>=]", "", path)), node, node == top[-1][0]] += 1
    found = merkle.audited(_odd(spark, odd_rows))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, found.collect())) == want
    assert {x[-1] for x in want} == {True, False}
    assert merkle.audited(_odd(spark, [])).count() == 0
    assert merkle.audited(_odd(spark, odd_rows[:1])).first().root == merkle.audited(_odd(spark, odd_rows[:1])).first().leaf


def test_merkle_does_not_depend_on_the_layout(spark, odd_rows):
    rows = [r for r in odd_rows if r[0] != 7]
    a, b = (sorted(map(tuple, merkle.audited(_odd(spark, rows).repartition(n)).fillna({"doc_id": -1}).collect())) for n in (1, 7))
    assert a == b


def _divergence(rows):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)})))) for _, text, lang, source, _ in rows]
    have, count, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, c in docs:
        groups[lang].add(source)
        for t, n in c.items():
            have[lang, t] += 1
            count[lang, source, t] += n
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), n in have.items() if x == lang and n >= 30]
        whole = {t: sum(count[lang, s, t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p = {s: share({t: count[lang, s, t] for t in kept}) for s in sources}
        q = share(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if count[lang, s, t] and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 50)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("shard", [divergence.SHARD, 40])
def test_divergence_equals_plain_counts(spark, shard):
    words = ["Über", "ÉTÉ", "été", "abc", "ABC", "x1y", "的", "it's", "a\0b"] + [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90)]
    text = lambda: " ".join(R.choices(words, weights=[1 + 30 / (1 + i) for i in range(len(words))], k=R.randint(0, 60)))
    rows = [(i, text(), R.choice(["en", "en", "de", None]), R.choice(["a", "a", "b", "c", None, "é"]), 0) for i in range(400)]
    rows += [(500, None, "en", "none", 0), (501, "rare words", "few", "a", 0), (502, "rare words", "few", "b", 0), (503, None, "few", "c", 0), (504, "abc " * 50_000, "en", "long", 0), (505, "solo", "alone", "a", 0)]
    found = divergence.audit(_odd(spark, rows + rows[:5]), shard=shard)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(found.dtypes)["rank"] == "int"
    got = [tuple(r) for r in found.collect()]
    want = _divergence(rows + rows[:5])
    assert len(got) == len(want) and set(got) == want
    assert any(x[0] == "few" and x[4] == 0 for x in want) and any(x[2] == "term" and x[5] == 50 for x in want)
    assert divergence.audit(_odd(spark, [])).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_merkle", "op12_divergence"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = queries.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in rel.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_compression_tells_held_out_labels(spark):
    large = DATA.parent / "sf0.1"
    docs, labels = (spark.read.parquet(f"{large}/{t}.parquet") for t in ("documents", "labels"))
    found = queries.op13_compression(spark, str(large)).cache()
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r for r in rows if r.quality == k] for k in (1, 0))
    assert sum(r.predicted for r in good) >= 0.99 * len(good) and sum(r.predicted for r in bad) <= 0.1 * len(bad)
    above = sum((a.score > b.score) + (a.score == b.score) / 2 for a in good for b in bad) / len(good) / len(bad)
    assert above > 0.98
    for r in found.collect():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    # held-out labels and the table's layout have no part in it
    held = compression.fold(labels["doc_id"]) == compression.HELD
    turned = labels.filter(~held).unionByName(labels.filter(held).withColumn("quality", 1 - labels.quality))
    assert compression.fit(docs.repartition(5), turned.repartition(3)) == compression.fit(docs, labels)
    assert turned.count() == labels.count()


def test_compression_of_odd_rows(spark):
    import zstandard as zs

    words = lambda k: " ".join("".join(R.choices("abcdefgh", k=5)) for _ in range(k))
    junk = lambda k: " ".join("".join(R.choices("#$%&XYZ", k=6)) for _ in range(k))
    rows = [(i, junk(80) if i % 3 == 0 else words(80), "en", "a", 0) for i in range(300)]
    edge = [(1000, None, None, None, None), (1001, "", "en", "a", 0), (None, words(50), "en", "a", 0), (1002, "é" * 100_000, "en", "a", 0), *rows[:2]]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, 0, 0), (None, 1, 0), (9999, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    docs = _odd(spark, rows + edge)
    model = compression.fit(docs, labels)
    got = compression.scored(docs, model).collect()
    assert len(got) == len(rows) + len(edge)
    both = [compression._compressor(d) for d in (model.good, model.bad)]
    text = {r[0]: (r[1] or "").encode() for r in rows + edge}
    for r in got:
        t = text[r.doc_id]
        assert [r.n_good, r.n_bad] == [sum(len(c.compress(t[k : k + 512])) for k in range(0, len(t), 512)) for c in both] and r.n_raw == len(t)
        assert isinstance(both[0], zs.ZstdCompressor) and 0 <= r.score <= 1
    assert all((r.predicted == 1) == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 300)
    assert len({(r.doc_id, r.score) for r in got}) == len(text)
    assert next(r for r in got if r.doc_id is None).held_out is False
    # one class, no labels, no rows
    one = compression.fit(docs, labels.filter("quality = 1"))
    assert one.weights[1:] == (0.0, 0.0) and {r.predicted for r in compression.scored(docs, one).collect()} == {1}
    none = compression.scored(docs, compression.fit(docs, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}
    assert compression.scored(_odd(spark, []), model).count() == 0 and compression.classified(_odd(spark, []), labels).count() == 0
