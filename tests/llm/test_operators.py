"""Training-data operators against brute force, the libraries, and edge rows."""

import hashlib
import html
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkloom.llm import _text as tx
from linkloom.tables import settle
from linkloom.llm import audio, kneser_ney, main_text, near_dup, packing, pieces, pii, quality, queries, repeats, urls

R = random.Random(11)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(400)]
TEXTS = [" ".join(R.choices(VOCAB, k=R.randint(1, 300))) for _ in range(60)]
EDGE = [None, "", " \n\t ", "é🤖ß a  b\n\n c", "x" * 5000, "1 " * 2000, TEXTS[0], TEXTS[0]]
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "extra") for i, t in enumerate(TEXTS + EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `place` string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_pieces_equal_the_library(spark, docs, nothing):
    import sentencepiece

    model = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    own = pieces.Pieces(model)
    some = ["".join(R.choice("ab  ▁\n\té🤖的hello\u0000") for _ in range(R.randint(0, 50))) for _ in range(800)]
    parts = [p.replace(pieces.MARK, "") for p in R.sample(own.text[300:], 2000)]
    some += ["".join(R.choices(parts, k=R.randint(1, 40))) for _ in range(300)] + ["".join(R.choice("aeinstr") for _ in range(R.randint(1, 200))) for _ in range(300)]
    some += [R.choice(["a", "ab", "aab", "0", "10", "-", "=", " ", "的", "\t"]) * R.randint(1, 300) for _ in range(300)]
    long_ = ["a" * 20000, " " * 20000, "ab" * 10000, "的一是" * 5000, "".join(R.choices(parts, k=5000)), "".join(R.choice("abcXYZ019+/") for _ in range(100000))]
    for t in some + long_ + [" " * 1500 + "ab" * 900]:
        assert own.encode(t) == sp.encode(t)
        assert own.decode(own.encode(t)) == sp.decode(sp.encode(t))
    for _ in range(500):
        ids = [R.choice([3 + R.randrange(256), R.randrange(32000), 0, 1, 2]) for _ in range(R.randint(0, 10))]
        assert own.decode(ids) == sp.decode(ids)
    for r in pieces.digests(docs, model).join(docs, "doc_id").collect():
        ids = sp.encode(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.digests(nothing, model).count() == 0


@pytest.mark.parametrize("part_bytes, files", [(kneser_ney.PART_BYTES, kneser_ney.FILES), (700, 3)])
def test_kneser_ney_equals_plain_formulas(docs, nothing, monkeypatch, part_bytes, files):
    monkeypatch.setattr(kneser_ney, "FILES", files)
    got = {r.doc_id: r for r in kneser_ney.held_out_scores(docs, part_bytes=part_bytes).collect()}
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    tok = {r.doc_id: re.findall(WORD, (r.text or "").translate(low)) + ["</>"] for r in docs.collect()}
    c, pairs = Counter(), Counter()
    for i, w in tok.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
            pairs.update(zip(["<s>"] + w, w))
    n, v = sum(c.values()), len(c)
    before, total, kinds = Counter(b for _, b in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, _), k in pairs.items():
        kinds[a][min(k, 3) - 1] += 1
        total[a] += k
    count = lambda x: [sum(1 for y in x if y == k) for k in (1, 2, 3, 4)]
    d2, d1 = kneser_ney._discounts(count(pairs.values())), kneser_ney._discounts(count(before.values()))
    ones = [sum(1 for x in before.values() if min(x, 3) == k) for k in (1, 2, 3)]
    cut = lambda x, d: x - (d[min(x, 3) - 1] if x else 0)
    p1 = lambda w: cut(before[w], d1) / len(pairs) + sum(a * b for a, b in zip(d1, ones)) / len(pairs) / (v + 1)

    def p2(a, w):
        return p1(w) if not total[a] else cut(pairs[a, w], d2) / total[a] + sum(i * j for i, j in zip(d2, kinds[a])) / total[a] * p1(w)

    for i, w in tok.items():
        r = got[i]
        assert r.n_tokens == len(w) and r.n_known == sum(c[t] > 0 for t in w) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w), rel_tol=1e-12)
        assert math.isclose(r.score, sum(math.log10(p2(a, t)) for a, t in zip(["<s>"] + w, w)), rel_tol=1e-9)
    assert abs(sum(p2("<s>", w) for w in c) + p2("<s>", "?") - 1) < 1e-9  # the unseen words' share is one word's
    assert kneser_ney.held_out_scores(nothing).count() == 0


def test_kneser_ney_counts_are_64_bits_wide(tmp_path):
    n = np.array([1, 7, 2**32 - 2, 2**32 - 1, 2**32, 5_000_000_000], np.uint64)
    key = np.sort(tx.mix(np.arange(6, dtype=np.uint64)))
    file = kneser_ney._Parts(str(tmp_path), 0, 1)
    file.add(0, key, n)
    file.close()
    kneser_ney._save(str(tmp_path), "word-0", np.array([(int(key[5]), 5_000_000_000, 1, 2, 3, 2**40)], kneser_ney.WORD))
    model = kneser_ney.Model(str(tmp_path), 1, 1, 1, 1, 1, (0.5,) * 3, (0.5,) * 3, (1, 1, 1), ())
    reader = kneser_ney.Reader(model)
    assert reader.pair(key, key).tolist() == n.tolist()
    assert reader.word(key[5:]).T.tolist() == [[5_000_000_000, 1, 2, 3, 2**40]]
    for top in (200, 60_000, 4_000_000_000, 5_000_000_000):
        a, b = kneser_ney._unpacked(kneser_ney._packed(key, kneser_ney._small(np.full(6, top, np.uint64))))
        assert a.tolist() == key.tolist() and b.tolist() == [top] * 6


def _counts(t):
    w = re.findall(WORD, t or "")
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    seen, hit = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return [len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)]


def test_quality_counts_and_outliers(spark, docs, nothing):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.judged(docs).collect():
        assert [r[c] for c in quality.BASE] == _counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    words = lambda k: R.choices(VOCAB, k=k)
    rows = [(i, " ".join(words(200)), "en", None) for i in range(150)] + [(1000 + i, " ".join(w + "&%$" for w in words(200)), "en", None) for i in range(8)]
    verdict = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(verdict[i] for i in range(150)) and not any(verdict[1000 + i] for i in range(8))
    assert quality.judged(nothing).count() == 0
    assert quality.kept_rows(docs).columns == docs.columns


def test_quality_distances_equal_plain_loops(spark):
    r = random.Random(3)
    def text(shift):
        w = r.choices(VOCAB, k=r.randint(20, 400))
        return " ".join(x.capitalize() + r.choice(",.;") if r.random() < 0.1 + shift else x for x in w)

    rows = [(i, text(0.5 if i % 20 == 0 else 0.0), "en", "a" if i % 3 else "b") for i in range(400)]
    rows += [(1000 + i, rows[1][1], "en", "a") for i in range(700)]  # copies count once
    got = {x.doc_id: x for x in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for source in "ab":
        want = _robust({i: t for i, t, _, s in rows if s == source and not got[i].base_failed})
        assert all(math.isclose(got[i].d2, d, rel_tol=1e-6) for i, d in want.items())
        assert all(got[i].kept == (d <= quality.CUTOFF) for i, d in want.items())
    junk = {i for i in range(0, 400, 20)}
    assert all(got[i].kept for i in range(400) if i not in junk) and not any(got[i].kept for i in junk if got[i].n_words > 100)


def test_quality_judges_small_groups(spark):
    clean = lambda: " ".join(R.choices(VOCAB, k=200))
    junk = lambda: " ".join(w + "&%$" for w in R.choices(VOCAB, k=200))
    rows = [(i, clean(), "en", f"s{i % 10}") for i in range(90)] + [(500 + i, clean(), "fr", "s0") for i in range(3)] + [(600 + i, clean(), "de", "s0") for i in range(60)]
    bad = [(1000 + i, junk(), "en", f"s{i}") for i in range(4)] + [(1100, junk(), "fr", "s0"), (1101, junk(), None, None), (1102, junk(), "de", "s1")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r.d2 is not None for r in got.values()) and len(got) == len(rows + bad)
    assert {i for i, r in got.items() if not r.kept} == {x[0] for x in bad}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="no test tables")
def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judged(docs).filter("NOT base_failed").join(labels, "doc_id").collect()
    good, bad = ([r for r in rows if r.quality == k] for k in (1, 0))
    rejected = sum(not r.kept for r in bad)
    assert rejected >= 0.99 * len(bad)  # recall
    assert sum(not r.kept for r in good) <= 0.001 * len(good) and rejected >= 0.99 * sum(not r.kept for r in rows)  # clean texts stay; precision


def test_url_rules(spark):
    cases = {"http://a.example.net/en/x?y": ("example.net/en/", "allow"), "http://b.net/": ("net/", "block"), "https://EXAMPLE.com/de/1#z": ("example.com/de/", "block"), "http://x.org/fr/": ("org/fr/", "allow"), "http://net": (None, "allow"), "http://h.test/login?a": (None, "block"), "http://h.test/login/help/": (None, "allow"), "http://ads.h.test/": (None, "block"), None: (None, "allow"), "no scheme/login/": (None, "allow")}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judged(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urls.judged(df.limit(0)).count() == 0


def test_url_rules_ties_and_plan(spark):
    rules = (urls.Rule("block", "/a^"), urls.Rule("allow", "/a^"), urls.Rule("block", "a.test/x/", True), urls.Rule("allow", "a.test/x/", True), *(urls.Rule("block", f"^word{i}^") for i in range(500)), urls.Rule("block", "*"))
    names = ["http://h.test/a/", "http://a.test/x/1", "http://h.test/?word499=1", "http://h.test/" + "y" * 100_000, None, "word1"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(names * 2)], "page_id long, url string, fetched string, `table` string")
    found = urls.judged(df, tuple(r for r in rules if r.host), tuple(r for r in rules if not r.host))
    got = [(r.verdict, r.rule, r.pattern) for r in found.orderBy("page_id").collect()]
    assert got == [("allow", None, "/a^"), ("block", "a.test/x/", None), ("block", None, "^word499^"), ("block", None, "*"), ("allow", None, None), ("allow", None, None)] * 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0] and "Join" not in plan and "Python" not in plan


def test_urls_match_sql(spark):
    import duckdb

    own = urls.judged(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    cols = own.columns
    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    assert sorted(map(str, (tuple(r) for r in own.collect()))) == sorted(map(str, con.sql(f"select {', '.join(cols)} from ({urls.oracle()})").fetchall()))


def _ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    luhn = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_pii_base_and_bootstrapped(spark, docs):
    def luhn(head):
        return next(head + str(k) for k in range(10) if _ok("card", head + str(k)))

    rows = [(i, "".join(R.choice("a@b.c-1 2+3(4)5%_9\né🤖@.") for _ in range(R.randint(0, 70)))) for i in range(1500)]
    rows += [(9000 + i, "please charge member card " + luhn("".join(R.choice("0123456789") for _ in range(15))) + " now") for i in range(30)]
    rows += [(9900, "please charge member card AB-99-1234-Z now"), (9901, None), (9902, "a.b" * 9000 + "@x.com"), (9903, "x@" + "b." * 9000 + "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for r in pii.spans(df).collect():
        t = texts[r.doc_id] or ""
        if r.doc_id not in (9902,):
            base = [f"{k}:{m.start()}:{m.end()}" for k in pii.KINDS for m in re.finditer(pii.SAYS[k], t) if _ok(k, m[0])]
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (r, t)
        if r.doc_id == 9900:
            assert r.spans == "card:26:38" and r.n_card == 0
    red = {r.doc_id: r.text for r in pii.redacted(df.filter("doc_id >= 9000")).collect()}
    assert red[9900] == "please charge member card [CARD] now" and red[9901] is None
    assert pii.spans(docs.limit(0)).count() == 0


def test_pii_contexts_are_not_bounded_by_characters(spark):
    r = random.Random(6)
    email = lambda: "".join(r.choices("abcdef", k=9)) + "@x.example"
    wide, far = "w" * 400, " " * 300
    rows = [(i, f"{wide}{far}{wide} {email()} and more") for i in range(9)] + [(100, f"{wide} {wide}  user99x and more")]
    rows += [(200 + i, f"write {email()}") for i in range(9)] + [(300, "write user-12-b"), (301, "do write user-12-b")]  # at a text's start
    rows += [(400 + i, f"call home now +1 (415) 555-01{i:02d} please") for i in range(9)] + [(500, "call home now (415) 555 0100 please")]
    got = {x.doc_id: x.spans for x in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "email:803:810" and got[300] == "email:6:15" and got[301] == "" and got[500] == "phone:14:28"


def test_pii_takes_linear_time_in_values(spark):
    import time

    def took(n):
        began = time.time()
        text = " ".join(f"no {100000 + i} a@b.example" for i in range(n))
        (row,) = pii.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        assert row.n_email == n and row.spans.count(",") >= n - 1
        return time.time() - began

    took(10)
    few, many = took(2000), took(16000)
    assert many < 4 * few + 8


def test_scan_gives_running_results(spark):
    from pyspark.sql import functions as F

    rows = [(n, [r % 7 for r in range(n)]) for n in (0, 1, 127, 128, 129, 300, 1000)]
    df = spark.createDataFrame(rows, "n int, x array<int>")
    sums = pii.scan(F.col("x"), F.struct(F.lit(0).alias("s")), "struct<s:int>", lambda a, x: F.struct((a["s"] + x).alias("s")))
    for r in df.select("n", "x", sums.alias("y")).collect():
        assert [y.s for y in r.y] == list(itertools.accumulate(r.x))


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(queries.vocabulary("byte_bpe_50k.json").decode())
    ranks = queries.vocabulary("byte_bpe_50k.json")
    own = packing.Ids(ranks)
    odd = ["".join(R.choice("ab  \n\té🤖's<|endoftext|> .,12　") for _ in range(R.randint(0, 60))) for _ in range(1500)]
    odd += ["".join(R.choice(["<|endoftext|>", " ", "a", "\n", "<|endoftext", "|>", "b c"]) for _ in range(R.randint(0, 12))) for _ in range(500)]
    for x, ids in zip(odd, own.of(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    got = packing.packed(docs, ranks, size=256).collect()
    texts = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(texts[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in got) == sum(map(len, texts.values()))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert [a for a, _ in v] == [0, *np.cumsum([n for _, n in v])[:-1]] and sum(n for _, n in v) <= 256
    assert packing.packed(nothing, ranks).count() == 0


def test_packing_costs_no_more_than_encoding():
    import json
    import time

    import tiktoken

    vocabulary = queries.vocabulary("byte_bpe_50k.json")
    spelt = {c: bytes([b]) for b, c in packing._letters().items()}
    ranks = {b"".join(spelt[c] for c in t): i for t, i in json.loads(vocabulary)["model"]["vocab"].items() if t != "<|endoftext|>"}
    plain = tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = packing.Ids(vocabulary)
    r = random.Random(8)
    took = {"plain": [], "own": []}
    for _ in range(4):  # new texts each time
        texts = [" ".join("".join(r.choices("aeinorst", k=r.randint(5, 12))) for _ in range(300)) for _ in range(1000)]
        began = time.process_time()
        want = [plain.encode_ordinary(x) for x in texts]
        took["plain"].append(time.process_time() - began)
        began = time.process_time()
        got = list(own.of(texts))
        took["own"].append(time.process_time() - began)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert min(took["own"]) < 2 * min(took["plain"]), took


def test_packing_encodes_long_white_space():
    from tokenizers import Tokenizer

    vocabulary = queries.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_str(vocabulary.decode())
    own, n = packing.Ids(vocabulary), 100_000
    odd = [" " * n, " " * (n + 3) + "x", "a" + "\n" * n + " y", "\t" * (n - 1) + " b" + " " * n + "<|endoftext|>" + "\u3000" * n + "'s", "z" * n + "\x1f" * n + "z"]
    odd.append(" " * 1_500_000 + "x")  # more than the encoder takes at once
    for x, ids in zip(odd, own.of(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_local_search_knows_its_bins():
    r = random.Random(4)
    lengths = [r.choice([5, 100, 700, 1024, 1025, 1300]) for _ in range(600)]
    search = packing.Search(packing.arrival(lengths, 2048), lengths, 2048)
    search.run(math.ceil(sum(lengths) / 2048))
    assert search.splits and search.rising
    for b, (items, own) in search.rising.items():
        assert sorted(items) == sorted(search.bins[b]) and own == sorted(own) == [lengths[i] for i in items]


def test_local_search_decides():
    r = random.Random(2)
    for n in (1, 40, 400, 3000):
        lengths = [min(2047, int(r.lognormvariate(6.2, 0.9)) + 1) for _ in range(n)]
        start = packing.arrival(lengths, 2048)
        search = packing.Search([list(b) for b in start], lengths, 2048)
        least = math.ceil(sum(lengths) / 2048)
        squares = sum((2048 - g) ** 2 for g in search.gap)
        out = search.run(least)
        assert sorted(i for b in out for i in b) == list(range(n)) and all(sum(lengths[i] for i in b) <= 2048 for b in out)
        assert squares <= sum((2048 - g) ** 2 for g in search.gap)
        assert len(out) <= math.ceil(1.01 * least) and (len(start) == len(out) or search.moves + search.swaps > 0)
    assert len(packing.pack([700] * 500, 2048)) == 250 and packing.pack([], 2048) == []  # ties


def test_local_search_frees_bins():
    # best fit can't: 6+4 | 5+5 from a bad start
    lengths = [6, 5, 4, 3, 2]
    bins = packing.Search([[0, 3], [1, 2], [4]], lengths, 10).run(2)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == [0, 1, 2, 3, 4] and all(sum(lengths[i] for i in b) <= 10 for b in bins)


def test_loser_tree_knows_prefixes():
    words = [bytes(R.choice(b"ab") for _ in range(R.randint(0, 12))) for _ in range(900)]
    runs = [repeats.Run.unpack(repeats.Run(words[i::5], words[i::5], np.arange(len(words[i::5]), dtype=np.uint64)).pack()) for i in range(5)]
    out = list(repeats.merge(runs))
    assert [x[1] for x in out] == sorted(words)
    for a, b in zip(out, out[1:]):
        n = b[0]
        assert a[1][:n] == b[1][:n] and (len(a[1]) == n or len(b[1]) == n or a[1][n] != b[1][n])


def test_repeats_equal_brute_force(spark, nothing):
    base = [" ".join(R.choices(VOCAB, k=R.randint(60, 400))) for _ in range(40)]
    rows = list(enumerate(base)) + [(100 + i, base[i][50 : 50 + R.randint(380, 430)] + base[i + 1][:300]) for i in range(20)]
    rows += [(200, "-" * 3000), (201, "ab" * 600), (202, None), (203, ""), (204, "q" * 399), (204, base[3]), (205, base[4] + "é" + base[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + 400] for _, b in bodies for k in range(len(b) - 399))
    want = []
    for i, b in bodies:
        cover = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                cover[k : k + 400] = b"\1" * 400
        spans = len(re.findall(b"\1+", bytes(cover)))
        want.append((i, len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    assert sorted(map(tuple, repeats.digests(df).collect())) == sorted(want)
    assert repeats.digests(nothing).count() == 0
    assert repeats.kept_rows(df).count() == len(rows)


def test_repeated_runs_of_words_equal_brute_force(spark, nothing):
    r = random.Random(21)
    words = lambda k: r.choices(VOCAB, k=k)
    passage, long_ = words(58), words(130)
    rows = [" ".join([*words(r.randint(0, 60)), *passage, *words(r.randint(0, 60))]) for _ in range(6)]
    rows += [" ".join(words(40)) + "\n" + "\t ".join(passage[: 49 + k]) + "  " + " ".join(words(40)) for k in range(5)]  # 49 to 53 words, other white space
    rows += [" ".join(words(30) + long_[k : k + 70] + words(30)) for k in range(0, 60, 7)]
    rows += [" ".join(words(20) + ["on"] * n + words(20)) for n in (40, 51, 52, 90)] + ["é ß " * 60, None, "", " ", "x" * 3000, " ".join(words(50)), " ".join(words(300))]
    rows += [" ".join(long_[40:91]), rows[-1]]
    rows = [(i, t) for i, t in enumerate(rows)] + [(0, " ".join(passage[3:54])), (None, " ".join(passage[:51]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [[m.span() for m in re.finditer(WORD, t or "")] for _, t in rows]
    runs = [[tuple(t[a:b] for a, b in w[k : k + 51]) for k in range(len(w) - 50)] for (_, t), w in zip(rows, found)]
    seen = Counter(x for v in runs for x in v)
    want = []
    for (i, t), w, v in zip(rows, found, runs):
        gone = set()
        for k, x in enumerate(v):
            if seen[x] > 1:
                gone.update(range(w[k][0], w[k + 50][1]))
        want.append((i or 0, t if t is None else "".join(c for at, c in enumerate(t) if at not in gone)))
    got = repeats.kept_rows(df, length=10**6, words=51).collect()
    assert sorted((x.doc_id or 0, x.text or "") for x in got) == sorted((i, t or "") for i, t in want)
    assert sum(t != u for (_, t), (_, u) in zip(rows, want)) > 20
    assert repeats.kept_rows(nothing, words=51).count() == 0


def test_repeats_query_shows_short_passages_of_many_words(spark, tmp_path):
    r = random.Random(22)
    words = lambda k: " ".join(r.choices(VOCAB, k=k))
    passage, bytes_ = " ".join(x[:4] for x in words(55).split()), "yé" * 150
    assert len(passage) < 399
    rows = [(i, f"{words(90)} {passage} {words(60)}") for i in range(3)] + [(3, f"{words(9)}\n{passage}\n{words(9)} {passage.upper()}"), (4, words(150)), (5, None), (6, "")]
    rows += [(20 + i, f"{words(30)} {bytes_} {words(30)}") for i in range(2)] + [(30, passage + " " + bytes_), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in queries.op7_repeats(spark, str(tmp_path)).collect()}
    plain = {x.doc_id: x for x in repeats.digests(df).collect()}
    cut = {x.doc_id: x.text for x in repeats.kept_rows(df, words=51).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert tuple(got[i])[:5] == tuple(plain[i]) and got[i].text == cut[i]
        has = passage in (t or "")
        assert (got[i].n_passages, got[i].n_passage_bytes > 0) == (int(has), has) and passage not in (got[i].text or "")
        assert got[i].n_removed == (0 if bytes_ not in (t or "") else got[i].n_removed) and (bytes_ in (t or "")) == (got[i].n_removed >= 450)
    assert all(len(passage) <= got[i].n_passage_bytes < len(passage) + 40 for i in (0, 1, 2, 3, 30, None))
    assert got[4].text == rows[4][1] and got[5].text is None and got[6].text == ""


def test_pipeline_cuts_short_passages_of_many_words(spark):
    import corpus_pipeline as cp

    words = lambda k: " ".join(R.choices(VOCAB, k=k))
    passage, bytes_ = " ".join(x[:4] for x in words(55).split()), "y" * 450
    assert len(passage) < 400
    rows = [(i, f"{words(90)} {passage} {words(60)}", "en", "s", 1) for i in range(3)] + [(9, words(150), "en", "s", 1)] + [(20 + i, f"{words(30)} {bytes_} {words(30)}", "en", "s", 1) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x for x in cp.repeats_stage(spark, df, "").collect()}
    for i, t, *_ in rows:
        left = t.replace(passage, "").replace(f" {bytes_} ", "")
        assert got[i].n_chars == len(got[i].text) and abs(len(got[i].text) - len(left)) <= 8 and passage not in got[i].text and bytes_ not in got[i].text
    assert got[9].text == rows[3][1]


def test_dart_signatures_estimate_weighted_jaccard():
    g = np.random.default_rng(1)
    for n in (5, 60, 2000):
        a = {i: int(g.integers(1, 6)) for i in range(n)}
        b = {i: int(g.integers(1, 6)) if g.random() < 0.4 else v for i, v in a.items()}
        j = sum(min(a[i], b[i]) for i in a) / sum(max(a[i], b[i]) for i in a)
        el = tx.mix(np.tile(np.arange(n, dtype=np.uint64), 2))
        s = near_dup.signatures(np.repeat([0, 1], n), el, np.array([*a.values(), *b.values()]), 2, 1024)
        assert abs((s[0] == s[1]).mean() - j) < 0.07


def test_near_dup_equals_brute_force(spark, nothing):
    big = [f"w{i}" for i in range(3000)]
    base = R.choices(big, k=150)
    alt = base[:100] + R.choices(big, k=50)

    def changed(b, k):
        b = list(b)
        for i in R.sample(range(len(b)), k):
            b[i] = R.choice(big)
        return b

    texts = [changed(base, R.randint(0, 9)) for _ in range(60)] + [changed(alt, R.randint(0, 6)) for _ in range(30)] + [changed(base[: R.randint(90, 150)], 2) for _ in range(20)] + [["a"], ["a"], ["a", "b"]]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in texts]
    head = list(range(len(texts)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            head[max(x, y)] = min(x, y)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(500, None), (501, "")]
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == find(i) for i in range(len(texts))) and got[500] == 500 and got[501] == 501
    assert near_dup.classes(nothing).count() == 0


def test_near_dup_finds_texts_that_repeat_themselves(spark):
    texts = {}
    for g in range(12):
        line = " ".join(R.choices(VOCAB, k=300 if g % 2 else 60))
        for k, times in enumerate((1, 2, 3, 20)):
            texts[10 * g + k] = "\n".join([line] * times)
        texts[10 * g + 5] = " ".join([line] * 4 + ["other"])
    want = _classes(texts)
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) == 12


def test_near_dup_counts_all_links(spark, monkeypatch):
    big = [f"v{i}" for i in range(3000)]
    texts = {}
    for g, size in enumerate((3, 5, 40)):
        base = R.choices(big, k=150)
        for k in range(size):
            words = list(base)
            for i in R.sample(range(150), (g + 1) // 2 + k % 2):
                words[i] = R.choice(big)
            texts[100 * g + k] = " ".join(words[: 150 - k % 9])
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
    close = lambda a, b: a != b and len(a & b) >= 0.8 * len(a | b)
    different = {frozenset(x) for x in sets.values()}
    want = {i: sum(close(x, y) for y in different) for i, x in sets.items()}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").cache()
    assert max(want.values()) > 8
    for part in (512, 8):
        monkeypatch.setattr(near_dup, "PART", part, raising=False)
        got = {r.doc_id: (r.n_links, r.class_id) for r in near_dup.classes(df).collect()}
        assert {i: x[0] for i, x in got.items()} == want
        assert {i: x[1] for i, x in got.items()} == _classes(texts)


PAGE = '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/x">Menu</a></nav><div class="ad">Buy</div>{open}<h1>Title &amp; more</h1><p>First <b>bold</b> text that is long enough to count as an article, with more words in it.<br>Second&nbsp;line of the article, again with enough words to surge over the limit.<ul><li>one item of some length in the list<li>another item of some length in the list</ul><div class="comments"><p>Reader says hello to all of you, this is a comment.</p></div>{close}<form>Name <input></form><footer>&copy; x</footer><script>var a="<p>no</p>";</script></body></html>'
WANT = "Title & more\nFirst bold text that is long enough to count as an article, with more words in it.\nSecond line of the article, again with enough words to surge over the limit.\none item of some length in the list\nanother item of some length in the list"


def test_main_text(spark):
    for a, b in (("<article>", "</article>"), ("<div>", "</div>"), ("<div><p>", "</div>")):
        assert main_text.main_text(PAGE.replace("{open}", a).replace("{close}", b)) == WANT
    assert main_text.main_text(None) == "" and main_text.main_text("plain") == "plain"
    df = spark.createDataFrame([(1, "u", None, 5), (2, None, "<p>" + "a" * 100000, 5)], "page_id long, url string, html string, text int")
    assert [(r.page_id, r.n_chars) for r in main_text.extracted(df).collect()] == [(1, 0), (2, 100000)]


def test_main_text_searches_in_marked_elements(spark):
    said = ["This is a sentence of the article that is long enough to count.", "Here is one more sentence of it, with as many words in it again."]
    body = "".join(f"<p>{x}</p>" for x in said * 2)
    links = "".join(f'<div class="xq"><a href="/{i}">Another page {i}</a></div>' for i in range(6))
    for name in ("article", "main"):
        assert main_text.main_text(f"<body><{name}>{links}{body}{links}</{name}><p>Elsewhere.</p></body>") == "\n".join(said * 2)


def _random_page(r):
    """A page of random parts, and its article."""
    say = lambda k: " ".join(r.choices(VOCAB, k=k)).capitalize() + "."
    blocks, body = [], []
    for _ in range(r.randint(4, 14)):
        kind = r.random()
        if kind < 0.15:
            items = [say(r.randint(4, 12)) for _ in range(r.randint(1, 4))]
            body.append("<ul>" + "".join(f"<li>{x}" + "</li>" * r.randint(0, 1) for x in items) + "</ul>")
            blocks += items
        elif kind < 0.25:
            body.append(r.choice(['<p class="ad">Buy now', '<div class="ad">Buy now</div>', "<!-- <p>no</p> -->", '<aside><p>See this too.</p></aside>', '<script>"</p><p>"</script>', "<form>Your name <input></form>"]))
        else:
            a, b = say(r.randint(20, 60)), say(r.randint(1, 30))
            body.append(f"<p{r.choice(['', ' class=x', ' data-a=1>2' [:9], ' title=it\"s'])}>{a} &amp;  <a href=x\">{b}</a>\n" + "</p>" * r.randint(0, 1))
            blocks.append(f"{a} & {b}")
    wrap = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class=page>", "</div>"), ("<div><section id=related-work>", "</section></div>")])
    chrome = "<nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav><header>Site name</header>"
    after = '<div class="comments"><p>' + say(40) + "</div><footer>" + say(20) + "</footer>"
    return f"<!DOCTYPE html><html><head><title>{say(5)}</title><style>p{{}}</style></head><body>{chrome}{wrap[0]}{''.join(body)}{wrap[1]}{after}", "\n".join(blocks)


def test_main_text_of_random_pages_equals_their_article(spark):
    r = random.Random(4)
    pages = [_random_page(r) for _ in range(300)]
    for page, want in pages:
        assert main_text.main_text(page) == want
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(pages)]
    got = {x.page_id: x for x in main_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == w and got[i].n_chars == len(w) for i, (_, w) in enumerate(pages))
    assert main_text.extracted(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_main_text_without_article_elements(spark):
    for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        said = main_text.main_text(p.html)
        inside = re.search("<article>(.*)</article>", p.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", b))).strip() for b in re.split("<(?:/?p|/?h1|br)>", inside)]
        assert said == "\n".join(b for b in blocks if b)
        for other in ("", "div", "section"):
            assert main_text.main_text(re.sub("(</?)article>", rf"\1{other}>" if other else "", p.html)) == said


SAID = "This is a sentence of the article that is long enough to count. "


def test_main_text_keeps_lists_of_links_and_short_ends():
    links = lambda k, tag: "".join(f"<{tag}><a href=/{i}>Linked reference {i}</a></{tag}>" for i in range(k))
    names = lambda k: [f"Linked reference {i}" for i in range(k)]
    for k in range(1, 13):
        want = "\n".join([(SAID * 30).strip(), *names(k), "A closing paragraph."])
        assert main_text.main_text(f"<nav><a href=/>Home</a></nav><article><p>{SAID * 30}</p><ul>{links(k, 'li')}</ul><p>A closing paragraph.</p></article><div>Elsewhere there are other words.</div>") == want
        want = "\n".join([(SAID * 10).strip(), *names(k), SAID.strip() + " The end."])
        assert main_text.main_text(f"<body><div><p>{SAID * 10}</p>{links(k, 'p')}<p>{SAID} The end.</p></div><div>Imprint</div></body>") == want
    parts = "".join(f"<section><h2>Part {i}</h2><p>{SAID * n}</p></section>" for i, n in enumerate((20, 1, 1, 9, 1)))
    want = "\n".join(x for i, n in enumerate((20, 1, 1, 9, 1)) for x in (f"Part {i}", (SAID * n).strip()))
    assert main_text.main_text(f"<div id=top><a href=/>Home</a> <a href=/b>News</a></div><div id=content>{parts}</div><div>Imprint and contact</div>") == want


def test_main_text_marks_only_weigh():
    article = f"<h1>Title</h1><p>{SAID * 10}</p>"
    want = f"Title\n{(SAID * 10).strip()}"
    for mark in ("social", "share", "promo", "related", "toolbar"):  # an article's section all the same
        assert main_text.main_text(f'<article>{article}<div class="{mark}"><p>{SAID * 20}</p></div></article>') == f"{want}\n{(SAID * 20).strip()}"
        assert main_text.main_text(f'<article>{article}<div class="{mark}"><a href=/x>Post this</a> now</div></article>') == want
    for wrapper in ("content with-sidebar", "no-comments", "page newsletter ad-free"):
        for inner in ("sidebar", "comments", "ad"):
            assert main_text.main_text(f'<div class="{wrapper}">{article}<div class="{inner}"><p>{SAID * 2}</p></div></div>') == want
    for comments in ('<div class="comments">{}</div>', '<article class="comment">{}</article>', '<div><div>{}</div></div>', "<section>{}</section>"):
        said = comments.format("".join(f"<div><b>Reader {i}</b><p>{SAID * 3}</p></div>" for i in range(4)))
        assert main_text.main_text(f"<body><article>{article}</article>{said}</body>") == want
        assert main_text.main_text(f"<body><div>{article}{'<p>' + SAID * 20 + '</p>'}</div>{said}</body>") == f"{want}\n{(SAID * 20).strip()}"
    deep = '<div class="ad"><h1>x</h1>' * 20000
    assert main_text.main_text(f"{deep}<p>{SAID}")  # in linear time


def test_main_text_loses_nothing_to_odd_markup():
    said = "This is a sentence of the article that is long enough to count. Here is one more sentence of it."
    for page in (f'<p class="ad">Buy now<p>{said}', f'<body><a href=x">home</a><p>{said}', f'<div class="related">{"<p>" + said} {said} {said} {said}</div>', f"<p {'a=b ' * 5}'>{said}", f"<form><p>{said} {said} {said} {said}<input></form>", f"<p>{said}<div><b>x"):
        assert said in main_text.main_text(page)
    for many in ("<p>a", "<b>", "<div>", "<li>", "<!--", "<a ", "<td><b>", '<p x="'):
        main_text.main_text(many * 30000 + "</i></ul>" * 3000)
    tie = "<div><p>same words here</p></div>"
    assert main_text.main_text(tie * 3) == "same words here"


def test_audio_finds_shifted_and_noisy_recordings(spark):
    g = np.random.default_rng(3)
    tune = [g.normal(size=64) for _ in range(40)]
    pcm = lambda x: x.clip(-32000, 32000).astype("<i2").tobytes()
    play = audio.melody
    rows = [(i, pcm(play(v))) for i, v in enumerate(tune)]
    rows += [(100 + i, pcm(play(v) + g.normal(size=8192) * 300)) for i, v in enumerate(tune[:20])]
    rows += [(200 + i, pcm(play(v)[8 * audio.HOP :])) for i, v in enumerate(tune[20:30])] + [(300, pcm(play(tune[39]))), (301, None), (302, b""), (303, pcm(np.zeros(8192)))]
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, pcm binary"), audio.RATE)
    got = defaultdict(dict)
    for r in audio.aligned(prints, prints).collect():
        got[r.id][r.match] = r
    assert len(got) == len(rows) and sum(i in got[100 + i] for i in range(20)) >= 18
    assert all(got[200 + i][20 + i].offset == -8 and 200 + i in got[20 + i] for i in range(10))
    assert got[300][39].bit_errors == 0 and got[39][300].n_copies == 1
    assert list(got[301]) == list(got[302]) == [None] and got[301][None].n_copies == 0
    assert audio.aligned(prints.limit(0), prints.limit(0)).count() == 0


def test_audio_recall_against_all_offsets(spark):
    """Recordings with a few per cent of bit errors, against comparing every pair at every offset."""
    g = np.random.default_rng(5)
    tune = [audio.melody(g.normal(size=64)) for _ in range(30)]
    rows = [(i, x.clip(-32000, 32000).astype("<i2").tobytes()) for i, x in enumerate(tune)]
    rows += [(100 * k + i, (x + g.normal(size=len(x)) * 500 * k).clip(-32000, 32000).astype("<i2").tobytes()) for k in (1, 2, 3, 4) for i, x in enumerate(tune)]
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, pcm binary"), audio.RATE).cache()
    items = {r.id: np.array(r["items"], np.int32).view(np.uint32) for r in prints.collect()}
    bits = np.array([bin(i).count("1") for i in range(1 << 16)])
    want = set()
    for a, b in itertools.permutations(items, 2):
        x, y = items[a], items[b]
        for d in range(-len(y) + 1, len(x)):
            u, v = x[max(d, 0) :], y[max(-d, 0) :]
            n = min(len(u), len(v))
            if n >= 0.5 * min(len(x), len(y)):
                e = u[:n] ^ v[:n]
                if (bits[e & 0xFFFF] + bits[e >> 16]).sum() <= 0.1 * 32 * n:
                    want.add((a, b))
                    break
    got = {(r.id, r.match) for r in audio.aligned(prints, prints).collect() if r.match is not None}
    assert got <= want and len(want) > 100 and len(got) >= 0.9 * len(want), (len(got), len(want))


def test_audio_offsets_by_correlation_equal_those_item_by_item():
    g = np.random.default_rng(8)
    for n, m in ((300, 200), (50, 700), (1, 400)):
        x, y = (g.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) for k in (n, m))
        d = np.arange(-m + 1, n)
        length = np.minimum(n - np.maximum(d, 0), m - np.maximum(-d, 0))
        plain = [sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(x[max(k, 0) :], y[max(-k, 0) :])) for k in d.tolist()]
        assert audio._errors(x, y, d[:3], length[:3]).tolist() == plain[:3]
        many = np.repeat(d, 600)  # so many that they are correlated
        assert audio._errors(x, y, many, np.repeat(length, 600)).tolist()[::600] == plain


def test_audio_aligns_long_silence_in_linear_time(spark):
    import time

    quiet = lambda n, k: [7] * n + [k] * 40 + [7] * n
    rows = [(1, quiet(30_000, 123456)), (2, quiet(30_010, 123456)), (3, [7] * 60_000)]
    prints = spark.createDataFrame(rows, "id long, items array<int>")
    began = time.time()
    got = {(r.id, r.match): (r.offset, r.bit_errors, r.n_bits) for r in audio.aligned(prints, prints).collect()}
    assert time.time() - began < 60
    assert got[1, 2] == (-10, 0, 32 * 60_040) and got[2, 1] == (10, 0, 32 * 60_040)
    assert set(got) == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        docs = settle(stage(spark, docs, sf), name)
        assert docs.count() > 0
        if name != "packing":
            assert docs.columns == columns


def test_rows_without_a_key_stay(spark):
    clean = " ".join(R.choices(VOCAB, k=80))
    df = spark.createDataFrame([(None, clean, None, None, 1), (1, "short", "en", None, 2), (1, clean, "en", None, 3), (2, None, None, "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.n_chars for r in quality.kept_rows(df).collect()) == [1, 3]
    assert sorted(r.n_chars for r in near_dup.kept_rows(df.filter("n_chars <> 2")).collect()) == [1, 3, 4]
    assert repeats.kept_rows(df).count() == 4 and pii.redacted(df).count() == 4


CLASH = ["_row", "c0", "class_id", "_t", "_h", "_k", "_g", "kept", "n_words", "content", "cuts", "spans", "_key_and_text", "_salt", "h", "label"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and extra columns with the names that operators use inside."""
    r = random.Random(8)
    long_ = " ".join(r.choices(VOCAB, k=40000))
    texts = [None, "", long_, long_, "x" * 300_000, " " * 200_000, TEXTS[0], TEXTS[0], "mail a@b.example " * 3000]
    rows = [(i // 2 if i < 8 else None, t, None if i % 2 else "en", "s", *[str(i)] * len(CLASH)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


def test_extra_columns_and_odd_rows_survive(odd):
    for kept in (quality.kept_rows, near_dup.kept_rows, repeats.kept_rows, pii.redacted):
        out = kept(odd)
        assert out.columns == odd.columns
        rows = out.collect()
        assert len(rows) == 9 if kept in (repeats.kept_rows, pii.redacted) else 0 < len(rows) <= 9
    empty = odd.limit(0)
    for kept in (quality.kept_rows, near_dup.kept_rows, repeats.kept_rows, pii.redacted):
        assert kept(empty).count() == 0


def test_queries_take_odd_rows(spark, odd):
    assert kneser_ney.held_out_scores(odd).count() == 9 and pieces.digests(odd, queries.vocabulary("piece_bpe_32k.model")).count() == 9
    sounds = odd.selectExpr("doc_id AS id", "CASE WHEN length(text) < 20000 THEN encode(text, 'utf-8') END AS pcm", *(f"`{c}`" for c in CLASH))
    prints = audio.fingerprints(sounds, audio.RATE)
    assert prints.count() == 9 and {r.id for r in audio.aligned(prints, prints).collect()} == {0, 1, 2, 3, None}
    assert quality.judged(odd).count() == 9 and pii.spans(odd).count() == 9 and repeats.digests(odd).count() == 9
    assert near_dup.classes(odd).count() == 4  # different keys
    pieces_ = packing.packed(odd, queries.vocabulary("byte_bpe_50k.json")).collect()
    assert {p.doc_id for p in pieces_} == {0, 1, 2, 3, None} and all(0 < p.length <= 2048 for p in pieces_)
    pages = odd.select(odd.doc_id.alias("page_id"), odd.text.alias("url"), odd.text.alias("html"), *CLASH)
    assert urls.judged(pages).count() == 9 and main_text.extracted(pages).count() == 9


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def _classes(texts, similar=0.8):
    """Key -> least key of its chain of similar texts."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, t in texts.items() for w in [re.findall(WORD, t.lower())]}
    head = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both >= similar * (len(sets[a]) + len(sets[b]) - both) and head[a] != head[b]:
            low, high = sorted((head[a], head[b]))
            head = {i: low if h == high else h for i, h in head.items()}
    return head


def _vector(t):
    w = re.findall(WORD, t)
    chars, letters = max(1, sum(map(len, w))), max(1, sum(c.isascii() and c.isalpha() for c in t))
    last, again = {}, 0
    for i, x in enumerate(w):
        again += i - last.get(x, -100) <= quality.BACK
        last[x] = i
    marks, upper = sum(33 <= ord(c) < 127 and not c.isalnum() for c in t), sum("A" <= c <= "Z" for c in t)
    pairs = ((marks, chars), (upper, chars), (again, len(w)), (sum(len(x) <= quality.SHORT for x in w), len(w)), (sum(c in "aeiouAEIOU" for c in t), letters))
    return [math.log(chars / len(w)), *(math.sqrt((a + 0.375) / b) for a, b in pairs)]


def _robust(texts, core=0.75):
    """Key -> squared distance, for the texts of one group: plain loops over all vectors."""
    every = {i: (*_vector(t), len(re.findall(WORD, t))) for i, t in texts.items()}
    rows = np.array(sorted(set(every.values())))
    v, near = rows[:, :6], rows[:, 6] / (rows[:, 6] + quality.HALF)

    def held(s):
        """No variance is less than what chance gives."""
        return s + np.diag(quality.RIDGE + np.maximum(quality.CHANCE - np.diag(s), 0))

    def fit(k, scale=1.0):
        m = (near[k, None] * v[k]).sum(0) / near[k].sum()
        d = np.sqrt(near[k, None]) * (v[k] - m)
        return m, held(scale * d.T @ d / k.sum())

    def far(x, nr, m, s):
        return nr * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m)

    middle = lambda x: np.sort(x, 0)[math.ceil(len(x) / 2) - 1]
    med = middle(v)
    off = np.sqrt(near)[:, None] * (v - med)
    mad = 1.4826 * middle(abs(off)) + 1e-4
    u = off / mad
    u /= np.sqrt((u * u).sum(1) + 1e-12)[:, None]
    def step(m, s):
        d = np.floor(np.log2(far(v, near, m, s) + 1e-9) * quality.CLASSES)
        return fit(d <= np.sort(d)[math.ceil(core * len(v)) - 1])

    det, ends = lambda s: np.linalg.slogdet(s)[1], []
    for m, s in ((med, held(np.diag(mad**2))), fit(np.ones(len(v), bool)), (med, held(6 * (u.T @ u) / len(v) * np.outer(mad, mad)))):
        for _ in range(3):
            m, s = step(m, s)
        ends.append((det(s), len(ends), m, s))
    _, _, m, s = min(ends, key=lambda x: x[:2])
    lower = math.inf
    while lower >= 1e-3:
        was = det(s)
        m, s = step(m, s)
        lower = was - det(s)
    m, s = fit(far(v, near, m, s) <= quality._consistency(core) * quality._quantile(0.975), quality._consistency(0.975))
    x = np.array(list(every.values()))
    return dict(zip(every, far(x[:, :6], x[:, 6] / (x[:, 6] + quality.HALF), m, s)))


def _cut(texts, n=400):
    """Texts (of one byte a character) without what repeated strings of n cover."""
    seen = Counter(t[k : k + n] for t in texts.values() for k in range(len(t) - n + 1))
    out = {}
    for i, t in texts.items():
        hit = {x for k in range(len(t) - n + 1) if seen[t[k : k + n]] > 1 for x in range(k, k + n)}
        out[i] = "".join(c for x, c in enumerate(t) if x not in hit)
    return out


def _marked(t, found=()):
    spans = sorted([(m.start(), m.end(), k.upper()) for k in pii.KINDS for m in re.finditer(pii.SAYS[k], t) if _ok(k, m[0])] + [(t.find(v), t.find(v) + len(v), k) for k, v in found if v in t])
    out, at = "", 0
    for start, end, kind in spans:
        out += t[at:start] + f"[{kind}]" * (end > at)
        at = max(at, end)
    return out + t[at:]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    r = random.Random(5)
    words = lambda k: " ".join(r.choices(VOCAB, k=k))
    base = [words(150) for _ in range(30)]
    changed = base[2].split()
    changed[40], changed[90] = "other", "another"
    passage = words(110)
    card = lambda: next(h + str(k) for h in ["".join(r.choices("0123456789", k=15))] for k in range(10) if _ok("card", h + str(k)))
    rows = [(i, t, "de", "b") for i, t in enumerate(base)]
    rows += [(100 + i, " ".join(x + "&%$" for x in words(150).split()), "de", "b") for i in range(2)]  # outliers
    rows += [(200, base[0], "en", "a"), (201, base[1], "de", "b"), (202, " ".join(changed), "en", "a"), (203, words(10), "en", "a"), (204, " ".join([words(9)] * 9), "en", "a")]
    rows += [(210, None, "en", None), (211, "", None, "a"), (212, words(4000), None, None)]
    rows += [(300 + i, f"{words(90)} {passage} {words(60)}", "fr", None) for i in range(3)]
    rows += [(400 + i, f"{words(60)} please charge member card {card()} now {words(40)}", "es", f"s{i % 3}") for i in range(12)]
    rows += [(450, f"{words(60)} please charge member card AB-99-1234-Z now {words(40)}", "es", "s0"), (451, f"{words(30)} a.b@c.example {words(9)} 10.0.0.255 {words(9)} +1 (415) 555-0100 {words(30)}", "es", "s1")]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    fine = lambda c: c[0] >= 20 and 100 * c[4] <= 30 * c[0]
    texts = {i: t for i, t, *_ in rows if fine(_counts(t))}
    assert {203, 204, 210, 211}.isdisjoint(texts)
    # no source or language has enough different texts, so that all are one group
    assert len({tuple(_vector(t)) for t in texts.values()}) >= quality.LEAST > max(Counter(lang for i, _, lang, _ in rows if i in texts).values())
    far = _robust(texts)
    assert {i for i, d in far.items() if d > quality.CUTOFF} == {100, 101}
    texts = {i: t for i, t in texts.items() if far[i] <= quality.CUTOFF}
    head = _classes(texts)
    assert head[200] == 0 and head[201] == 1 and head[202] == 2
    texts = _cut({i: t for i, t in texts.items() if head[i] == i})
    assert not any(passage[20:-20] in t for t in texts.values())
    texts = {i: _marked(t, [("CARD", "AB-99-1234-Z")]) for i, t in texts.items()}
    assert sum("[CARD]" in t for t in texts.values()) == 13 and all(f"[{k}]" in texts[451] for k in ("EMAIL", "IP", "PHONE"))
    t = Tokenizer.from_str(queries.vocabulary("byte_bpe_50k.json").decode())
    ids = {i: t.encode(x, add_special_tokens=False).ids + [0] for i, x in texts.items()}

    got = cp.run(spark, str(tmp_path)).collect()
    pieces_, seqs = defaultdict(list), defaultdict(list)
    for x in got:
        assert x.ids_crc32 == zlib.crc32(np.array(ids[x.doc_id][x.start : x.start + x.length], "<u4").tobytes())
        pieces_[x.doc_id].append((x.piece, x.start, x.length))
        seqs[x.sequence_id].append((x.offset, x.length))
    assert set(pieces_) == set(ids)
    for i, v in pieces_.items():
        first = (len(ids[i]) - 1) % 2048 + 1
        assert sorted(v) == [(0, 0, first), *((k, first + 2048 * (k - 1), 2048) for k in range(1, (len(ids[i]) - first) // 2048 + 1))]
    for v in seqs.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [a for a, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(seqs) <= math.ceil(sum(map(len, ids.values())) / 2048) + 1
