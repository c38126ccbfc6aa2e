"""Requests in waves, turns of hosts, redirects, and the cache on disk."""

import random
import threading
import time
from collections import Counter
from heapq import heappop, heappush
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from linkloom.operators import cache, probe, schedule, verdicts
from linkloom.plans import frontier, judge
from linkloom.tables import Scratch


def _drained(make, items, slots, threads):
    with schedule.Drain(make, slots, threads) as d:
        for host, item in items:
            d.add(host, item)
        rows = []
        while d.open or d.found:
            rows += d.rows(1)
    return rows


def test_a_slow_host_does_not_delay_others():
    ends, at_once, most = {}, Counter(), Counter()
    lock, began = threading.Lock(), time.monotonic()

    def make(item):
        host, _ = item
        with lock:
            at_once[host] += 1
            most[host] = max(most[host], at_once[host])
        time.sleep(0.02 if host == "slow" else 0.001)
        with lock:
            at_once[host] -= 1
            ends[item] = time.monotonic() - began
        return item, None

    items = [("slow", ("slow", i)) for i in range(1000)] + [(f"h{i % 20}", (f"h{i % 20}", i)) for i in range(200)]
    assert Counter(_drained(make, items, 4, 8)) == Counter(x for _, x in items)
    assert most["slow"] == 4 and max(most.values()) <= 4
    slow = max(t for (h, _), t in ends.items() if h == "slow")
    assert slow > 4 and max(t for (h, _), t in ends.items() if h != "slow") < slow / 4


def test_waiting_for_another_attempt_costs_no_thread_and_no_slot():
    tries = Counter()

    def make(item):
        tries[item] += 1
        return (item, tries[item]), 0.5 if item < 40 and tries[item] < 3 else None

    began = time.monotonic()
    rows = _drained(make, [("one", i) for i in range(80)], 1, 1)
    assert time.monotonic() - began < 5  # 40 requests that wait twice, one thread
    assert Counter(i for i, _ in rows) == Counter({i: 3 if i < 40 else 1 for i in range(80)})
    assert [i for i, _ in rows[:80]] == list(range(80))  # those that wait let the others pass


def test_a_request_that_raises_ends_the_task():
    with pytest.raises(ZeroDivisionError):
        _drained(lambda _: 1 / 0, [("h", 1)], 4, 2)


def test_hosts_forget_those_that_are_idle():
    hosts = schedule.Hosts(2)
    for k in range(100):
        hosts.add(f"h{k}", k)
    taken = [hosts.take(0.0) for _ in range(100)]
    assert [t[2] for t in taken] == list(range(100)) and hosts.take(0.0) is None
    for host, slot, _ in taken:
        hosts.done(host, slot)
    assert not hosts.queues and not hosts.free
    hosts.add("later", 1, at=5.0)
    assert hosts.take(4.9) is None and hosts.wakes() == 5.0 and hosts.take(5.0)[2] == 1


def test_planned_schedule_equals_plain_simulation(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([0, 5, 50, None])) for i in range(400)]
    want = set()
    for host in {h for h, *_ in rows}:
        ends = [(0, s) for s in range(3)]
        for _, i, ms in [x for x in rows if x[0] == host]:
            start, slot = heappop(ends)
            want.add((i, start))
            heappush(ends, (start + (ms or 0), slot))
    found = schedule.planned(spark.createDataFrame(rows, "host string, url long, took_ms long"), 3)
    assert {(x.url, x.start_ms) for x in found.collect()} == want
    assert schedule.planned(found.limit(0).drop("slot", "start_ms")).count() == 0


def test_waits_between_attempts():
    seen = lambda **k: dict.fromkeys(("status", "error_kind", "retry_after")) | k
    now = 1_798_761_600.0  # 2027-01-01
    assert probe.again_after(seen(status=200), 0, 1.0, now) is None and probe.again_after(seen(status=404), 0, 1.0, now) is None
    assert [probe.again_after(seen(status=503), k, 1.0, now) for k in range(7)] == [1, 2, 4, 8, 16, 30, 30]
    assert probe.again_after(seen(error_kind="timeout"), 1, 1.0, now) == 2 and probe.again_after(seen(error_kind="dns"), 0, 1.0, now) is None
    for value, wait in (("7", 7), ("99", 30), ("Fri, 01 Jan 2027 00:00:09 GMT", 9), ("Fri, 1 Jan 2027 02:00:06 +0200", 6), ("Thu, 31 Dec 2026 00:00:00 GMT", 1), ("soon", 1), (None, 1)):
        assert probe.again_after(seen(status=429, retry_after=value), 0, 1.0, now) == wait


@pytest.fixture
def server():
    asked = Counter()

    class H(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.command, self.path] += 1
            name = self.path.split("/")[-1]
            status = 404 if "missing" in self.path or name == "gone" else 405 if name == "get-only" and self.command == "HEAD" else 503 if name == "flaky" and asked[self.command, self.path] < 2 else 200
            body = b"one two three four five" if status == 200 else b""
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        do_HEAD = do_GET

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_waves_ask_only_what_is_open(spark, server):
    base, asked = server
    links = spark.createDataFrame([(base + p,) for p in ("/ok", "/ok", "/gone", "/get-only", "/flaky", "/v1/x", "/skip/me", "/known")], "url string")
    row = (f"{base}/known", None, int(time.time()), 1)
    known = spark.createDataFrame([row], cache.SCHEMA)
    limits = frontier.Limits(("/skip/",), ("other.test",), known)
    with Scratch(spark) as own:
        seen, requests = frontier.observed(links, lambda wanted: probe.probe(wanted, base_s=0.01), own, limits)
        waves = Counter((r.wave, r.method, r.url.removeprefix(base)) for r in requests.collect() if "missing" not in r.url)
        assert waves == Counter({("head", "HEAD", p): 1 for p in ("/ok", "/gone", "/get-only", "/flaky", "/v1/x")} | {("get", "GET", p): 1 for p in ("/ok", "/get-only", "/flaky", "/v1/x")} | {("version", "GET", "/v2/x"): 1})
        said = {r.url.removeprefix(base): r.verdict and r.verdict.reason.kind for r in judge.judged(links, seen, own=own).collect()}
        assert said == {"/ok": None, "/gone": "http-status", "/get-only": None, "/flaky": None, "/v1/x": "version-drift", "/skip/me": None, "/known": None}
        # what was observed is not asked again
        again, more = frontier.observed(links, lambda wanted: probe.probe(wanted), own, limits, seen)
        assert more.count() == 0 and judge.judged(links, again, own=own).filter("verdict is not null").count() == 2
    assert not any("/skip" in p or "/known" in p for _, p in asked) and asked["HEAD", "/flaky"] == 2
    assert sum("missing" in p for _, p in asked) == 3  # ok, get-only, flaky


def test_a_cached_verdict_answers_for_a_raised_version(spark):
    row = lambda url, kind, detail: (url, None if kind is None else f'{{"confidence":"suspect","reason":{{"kind":"{kind}","detail":"{detail}"}},"evidence":[],"tier":1}}', 100, 1)
    base = "https://h.test/{}/v{}/x"
    known = spark.createDataFrame([row(base.format("a", 2), None, None), row(base.format("b", 2), "http-status", 404), row(base.format("c", 2), "far-past", ""), row(base.format("d", 2), "network-error", "dns")], cache.SCHEMA)
    links = spark.createDataFrame([(base.format(c, 1),) for c in "abcde"], "url string")
    answer = lambda wanted: wanted.select("url", "method", F.when(F.contains("url", F.lit("missing")), 404).otherwise(200).alias("status"), F.lit("text").alias("body"))
    with Scratch(spark) as own:
        now = F.lit(100).cast("timestamp")
        seen, asked = frontier.observed(links, answer, own, frontier.Limits(cache=known, ttl=10), now=now)
        assert [r.url for r in asked.filter("wave = 'version'").collect()] == [base.format("e", 2)]
        drift = [r.url for r in judge.judged(links, seen, now, own=own).filter("verdict.reason.kind = 'version-drift'").orderBy("url").collect()]
        assert drift == [base.format(c, 1) for c in "ace"]
        none, asked = frontier.observed(links.limit(0), answer, own, now=now)
        assert asked.count() == 0 and none.count() == 0


def test_no_body_is_shuffled(spark):
    seen = spark.createDataFrame([("https://h.test/", "GET", 0, 200, "a long body")], "url string, method string, attempt int, status int, body string")
    plan = judge.pivoted(seen)._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange") :]
    assert "body" in exchange and "body" not in plan[: plan.index("Exchange")]
    body = [line for line in exchange.splitlines() if "Project" in line][0]
    assert "xxhash64" in body


def test_redirects_of_several_targets_and_nulls(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "b"), (None, "x"), ("y", None), ("z", "a")], "url string, target string")
    got = {(r.start, r.hop, r.url, r.end) for r in verdicts.closures(edges).collect()}
    assert got == {("a", 0, "a", None), ("a", 1, "b", None), ("a", 2, "b", "loop"), ("b", 0, "b", None), ("b", 1, "b", "loop"), ("z", 0, "z", None), ("z", 1, "a", None), ("z", 2, "b", None), ("z", 3, "b", "loop")}
    assert verdicts.closures(edges.limit(0)).count() == 0


def _rows(df):
    return {r.url: (r.verdict_json, r.checked_at) for r in df.collect()}


def _cached(spark, *rows):
    return spark.createDataFrame([(u, None, t, 1) for u, t in rows], cache.SCHEMA)


def test_cache_updates_touch_their_buckets(spark, tmp_path):
    at = str(tmp_path / "c")
    assert cache.load(spark, at).count() == 0 and cache.update(_cached(spark), at) == 0
    first = [(f"u{i}", 1) for i in range(2000)]
    assert cache.update(_cached(spark, *first), at) == cache.BUCKETS
    old = cache.load(spark, at)
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert cache.update(_cached(spark, ("u1", 2), ("new", 2)), at, _cached(spark, ("u2", 0), ("new", 0)).select("url")) <= 3
    assert _rows(cache.load(spark, at)) == {u: (None, 1) for u, _ in first if u != "u2"} | {"u1": (None, 2), "new": (None, 2)}
    assert _rows(old) == {u: (None, 1) for u, _ in first}  # its files are still there
    more = {p for p in tmp_path.rglob("*.parquet")} - set(files)
    assert len(more) <= 3 and all(p.stat().st_mtime_ns == t for p, t in files.items())
    for k in range(3):
        cache.update(_cached(spark, ("u1", 3 + k)), at)
    assert len(list((tmp_path / "c").rglob("*.json"))) == 2 and _rows(cache.load(spark, at))["u1"] == (None, 5)
    assert cache.size(spark, at) > 0
    cache.clear(spark, at)
    assert cache.size(spark, at) == 0


@pytest.mark.parametrize("stop", ["put", "rename"])
def test_a_stopped_update_leaves_the_old_cache(spark, tmp_path, monkeypatch, stop):
    at = str(tmp_path / "c")
    cache.update(_cached(spark, ("a", 1), ("b", 1)), at)

    def fail(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(cache._Files, "put" if stop == "put" else "_no_options", fail)
        with pytest.raises((KeyboardInterrupt, cache.Conflict)):
            cache.update(_cached(spark, ("a", 2), ("c", 2)), at)
    assert _rows(cache.load(spark, at)) == {"a": (None, 1), "b": (None, 1)}
    cache.update(_cached(spark, ("a", 3)), at)
    assert _rows(cache.load(spark, at)) == {"a": (None, 3), "b": (None, 1)}


def test_the_later_of_two_updates_is_refused(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "c")
    cache.update(_cached(spark, ("a", 1)), at)
    put = cache._Files.put

    def late(self, version, manifest):
        monkeypatch.setattr(cache._Files, "put", put)
        cache.update(_cached(spark, ("b", 2)), at)
        put(self, version, manifest)

    monkeypatch.setattr(cache._Files, "put", late)
    with pytest.raises(cache.Conflict):
        cache.update(_cached(spark, ("c", 3)), at)
    assert _rows(cache.load(spark, at)) == {"a": (None, 1), "b": (None, 2)}
    cache.update(_cached(spark, ("c", 3)), at)
    assert set(_rows(cache.load(spark, at))) == {"a", "b", "c"}


def test_commands_ask_what_is_needed_and_leave_nothing(spark, tmp_path, monkeypatch, server, capsys):
    from linkloom.__main__ import main
    from linkloom.tables import shared

    base, asked = server
    monkeypatch.setenv("LINKLOOM_CACHE_DIR", str(tmp_path / "cache"))
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text(f"{base}/ok {base}/gone https://skip.test/1\n")
    (docs / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\xff\xfe\x80")
    before = set(__import__("os").listdir(shared(spark)))
    assert main(["scan", str(docs), "--exclude-domain", "skip.test", "--no-local"], spark) == 1
    once = dict(asked)
    assert once["HEAD", "/ok"] == 1 and once["HEAD", "/gone"] == 1 and once["GET", "/ok"] == 1 and len(once) == 4
    assert main(["scan", str(docs), "--exclude-domain", "skip.test", "--no-local"], spark) == 1
    assert dict(asked) == once  # the cache is fresh
    for bad in (["--exclude-url", "(["], ["--per-host", "0"], ["--max-concurrency", "0"], ["--fail-on", "maybe"], ["--min-confidence", "nope"]):
        assert main(["scan", str(docs), *bad], spark) == 2, bad
    assert set(__import__("os").listdir(shared(spark))) == before
    assert capsys.readouterr().out.count("gone") == 2
