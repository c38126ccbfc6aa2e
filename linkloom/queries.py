"""Registered queries of the link engine, each with the SQL that says the same.

The tables hold no HTTP observations; where a query needs one, its columns follow from the row's
key by plain arithmetic, in Spark and in SQL alike.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import text as tx
from linkloom.functions import urls as ux
from linkloom.operators import cache as cx
from linkloom.operators import commit, extract, fixes, local
from linkloom.operators import verdicts as vx
from linkloom.plans import config, report
from linkloom.sources import files
from linkloom.tables import Scratch, folder, mounted, remove

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _hrefs(spark, sf_dir) -> DataFrame:
    """page_id, page url, href: one row an occurrence."""
    return _pages(spark, sf_dir).select("page_id", F.col("url").alias("page_url"), F.explode(extract.hrefs(F.col("html"))).alias("href"))


HREF = "SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages"


def page_link_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links per page: all, different ones, and those to a path that no page has."""
    links = _hrefs(spark, sf_dir)
    catalogue = _pages(spark, sf_dir).select(ux.path(F.col("url")).alias("href")).distinct()
    distinct = links.groupBy("page_id", "href").agg(F.count("*").alias("n"))
    broken = distinct.join(catalogue.withColumn("there", F.lit(True)), "href", "left")
    return broken.groupBy("page_id").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_unique"), F.count_if(F.col("there").isNull()).alias("n_missing"))


PATH = "CASE WHEN regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
HOST = "nullif(lower(regexp_replace(regexp_replace(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '')"
Q["page_link_report"] = page_link_report
SQL["page_link_report"] = f"WITH h AS ({HREF}), d AS (SELECT page_id, href, count(*) n FROM h GROUP BY 1, 2), c AS (SELECT DISTINCT {PATH.format('url')} AS p FROM pages) SELECT page_id, sum(n)::BIGINT AS n_links, count(*) AS n_unique, count(*) FILTER (p IS NULL) AS n_missing FROM d LEFT JOIN c ON href = p GROUP BY 1"


@query(HREF)
def html_links(spark, sf_dir):
    """The fast path of HTML extraction, for quoted attributes."""
    return _hrefs(spark, sf_dir)


@query("""WITH p AS (SELECT page_id, html, string_split(html, 'href="') AS s FROM pages), e AS (SELECT page_id, html, s, unnest(range(2, len(s) + 1)) AS i FROM p),
x AS (SELECT page_id, array_to_string(s[1:i - 1], 'href="') || 'href="' AS prefix, string_split(s[i], '"')[1] AS href FROM e)
SELECT page_id, href, length(prefix) - length(replace(prefix, chr(10), '')) + 1 AS line, length(list_last(string_split(prefix, chr(10)))) + 1 AS col, strlen(prefix) AS start_byte, strlen(prefix) + strlen(href) AS end_byte FROM x""")
def link_positions(spark, sf_dir):
    """Location and byte span of every link, by the extractor itself."""
    docs = _pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("format"), F.encode("html", "utf-8").alias("content"))
    return extract.links(docs).select(F.col("path").cast("long").alias("page_id"), F.col("url").alias("href"), F.col("location.line").alias("line"), F.col("location.column").alias("col"), F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))


@query(f"WITH l AS (SELECT href AS u FROM ({HREF}) UNION ALL SELECT url FROM pages) SELECT CASE WHEN regexp_matches(u, '^https?://') THEN 'http' WHEN starts_with(u, '#') THEN 'anchor' WHEN NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'local' ELSE 'other' END AS kind, count(*) AS n FROM l GROUP BY 1")
def link_kinds(spark, sf_dir):
    """All links, and the pages' own URLs, by kind."""
    both = _hrefs(spark, sf_dir).select(F.col("href").alias("u")).unionByName(_pages(spark, sf_dir).select(F.col("url").alias("u")))
    return both.groupBy(ux.link_kind(F.col("u")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH h AS ({HREF}) SELECT (SELECT count(*) FROM h) AS n_links, (SELECT count(*) FROM (SELECT DISTINCT page_id, href FROM h)) AS n_local_groups, (SELECT count(DISTINCT href) FROM h) AS n_unique")
def unique_links(spark, sf_dir):
    """Occurrences, groups that local checks run on, and distinct links."""
    return _hrefs(spark, sf_dir).agg(F.count("*").alias("n_links"), F.countDistinct("page_id", "href").alias("n_local_groups"), F.countDistinct("href").alias("n_unique"))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, 'utm_[a-z]+=') AND NOT regexp_matches(url, '[.]html$')")
def url_regex_exclude(spark, sf_dir):
    return _pages(spark, sf_dir).filter(~ux.excluded_by_pattern(F.col("url"), ["utm_[a-z]+=", "[.]html$"])).select("page_id", "url")


@query(f"SELECT page_id, url FROM pages WHERE {HOST.format('url')} IS NULL OR NOT ({HOST.format('url')} = 'example.net' OR ends_with({HOST.format('url')}, '.example.net'))")
def domain_exclude(spark, sf_dir):
    return _pages(spark, sf_dir).filter(~ux.excluded_by_domain(F.col("url"), ["Example.net"])).select("page_id", "url")


@query("SELECT page_id, lower(regexp_extract(u, '^[a-z]+://[^/?]*')) || CASE WHEN regexp_matches(u, '^[a-z]+://[^/?]*/') THEN '' ELSE '/' END || substr(u, length(regexp_extract(u, '^[a-z]+://[^/?]*')) + 1) AS normalised FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)")
def normalised_urls(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", ux.normalised(F.col("url")).alias("normalised"))


@query(f"SELECT {HOST.format('url')} || CASE WHEN starts_with(url, 'https') THEN ':443' ELSE ':80' END AS host_key, count(*) AS n FROM pages GROUP BY 1")
def host_keys(spark, sf_dir):
    """URLs of each host, whose requests are limited together."""
    return _pages(spark, sf_dir).groupBy(ux.host_key(F.col("url")).alias("host_key")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id, 'https://' || {HOST.format('url')} || '/api/v' || (page_id % 9 + 1) || '/x' AS upgraded FROM pages")
def version_upgrades(spark, sf_dir):
    """Synthetic: a versioned URL of each host."""
    u = F.concat(F.lit("https://"), ux.host(F.col("url")), F.lit("/api/v"), (F.col("page_id") % 9).cast("string"), F.lit("/x"))
    return _pages(spark, sf_dir).select("page_id", ux.version_upgrade(u).alias("upgraded"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> ''))"


_JACCARD = "CASE WHEN len(a.w) < 3 OR len(b.w) < 3 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE END"


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT a.doc_id, {_JACCARD} AS similarity FROM d a JOIN d b ON b.doc_id = a.doc_id - a.doc_id % 2 + 1 - a.doc_id % 2) SELECT doc_id, similarity, similarity >= 0.9 AS soft_404 FROM p""")
def soft_404_pairs(spark, sf_dir):
    """Synthetic: each document is a page, and the one that shares its half key the sibling that should not exist."""
    d = table(spark, sf_dir, "documents").select("doc_id", tx.word_hashes(F.col("text")).alias("w"))
    k = F.col("doc_id")
    other = d.select(k.alias("sibling"), F.col("w").alias("v"))
    both = d.withColumn("sibling", k - k % 2 + 1 - k % 2).join(other, "sibling")
    alike = tx.similarity(F.col("w"), F.col("v"))
    return both.select("doc_id", alike.alias("similarity"), (alike >= vx.SIMILAR).alias("soft_404"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'this page is deprecated' WHEN 2 THEN 'this page has been archived' WHEN 3 THEN 'has been superseded' END AS phrase FROM documents""")
def staleness_banner(spark, sf_dir):
    """Synthetic: a phrase in capitals behind some documents."""
    said = F.when(F.col("doc_id") % 5 == 1, "THIS PAGE IS DEPRECATED").when(F.col("doc_id") % 5 == 2, "This Page Has Been Archived").when(F.col("doc_id") % 5 == 3, "it HAS BEEN superseded").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", tx.staleness(F.concat_ws(" ", "text", said)).alias("phrase"))


@query("SELECT event_id, date_trunc('second', ts) < TIMESTAMP '2027-01-01' - INTERVAL 730 DAY AS old FROM events")
def far_past(spark, sf_dir):
    """The events' times as headers, with one digit or two of the day, by zone or offset, and read again."""
    k, ts = F.col("event_id") % 3, F.date_trunc("second", F.col("ts"))
    said = F.when(k == 0, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 1, F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss '+0000'")).otherwise(F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "d MMM yyyy HH:mm:ss '+0200'"))
    return table(spark, sf_dir, "events").select("event_id", vx.far_past(vx.http_date(said), F.lit("2027-01-01").cast("timestamp")).alias("old"))


_STATUS = "[200, 404, 403, 500, 301, 410, 451, 401, 429, 204][(o_orderkey % 10)::INT + 1]"


def _status(key: str = "o_orderkey", shift: int = 0):
    return F.element_at(F.array(*(F.lit(x) for x in (200, 404, 403, 500, 301, 410, 451, 401, 429, 204))), ((F.col(key) + shift) % 10 + 1).cast("int"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'network-error' WHEN s NOT BETWEEN 200 AND 299 THEN 'http-status' END AS reason,
CASE WHEN o_orderkey % 13 = 0 THEN 'likely-dead' WHEN s BETWEEN 200 AND 299 THEN NULL WHEN s IN (401, 403) THEN 'auth-walled' WHEN s IN (404, 410, 451) THEN 'dead-certain' ELSE 'suspect' END AS confidence FROM (SELECT o_orderkey, {_STATUS} AS s FROM orders)""")
def status_verdicts(spark, sf_dir):
    """Synthetic status and errors by order key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", _status().alias("s"), F.when(F.col("o_orderkey") % 13 == 0, "timeout").alias("e"))
    reason = vx.outcome(F.col("s"), F.lit(None).cast("string"), F.col("e"))
    return o.select("o_orderkey", reason.alias("reason"), vx.confidence(reason, F.col("s")).alias("confidence"))


@query(f"SELECT o_orderkey, CASE WHEN s IN (403, 405, 501) THEN g ELSE s END AS status FROM (SELECT o_orderkey, {_STATUS} AS s, {_STATUS.replace('o_orderkey % 10', '(o_orderkey + 3) % 10')} AS g FROM orders)")
def head_get_fallback(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", vx.final_status(_status(), _status(shift=3)).alias("status"))


_EDGES = "SELECT 'u' || k AS url, 'u' || CASE WHEN k % 40 = 39 THEN k - 1 WHEN k % 40 = 0 THEN k + 1000000 ELSE k + 1 END AS target FROM (SELECT o_orderkey AS k FROM orders)"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), walk AS (SELECT url AS start, 0 AS hop, url, [url] AS seen, false AS looped FROM e UNION ALL
SELECT w.start, w.hop + 1, e.target, list_append(w.seen, e.target), list_contains(w.seen, e.target) FROM walk w JOIN e ON w.url = e.url WHERE w.hop < 11 AND NOT w.looped),
l AS (SELECT *, max(hop) OVER (PARTITION BY start) AS last FROM walk) SELECT start, hop, url, CASE WHEN hop = last THEN CASE WHEN looped THEN 'loop' WHEN hop > 10 THEN 'limit' ELSE 'terminal' END END AS "end" FROM l""")
def redirect_closure(spark, sf_dir):
    """Synthetic redirects along all order keys: chains of up to 39 keys that end in a terminal or a loop."""
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(F.concat(F.lit("u"), k.cast("string")).alias("url"), F.concat(F.lit("u"), F.when(k % 40 == 39, k - 1).when(k % 40 == 0, k + 1000000).otherwise(k + 1).cast("string")).alias("target"))
    return vx.closures(e)


def _chains(spark, sf_dir):
    """Synthetic: page_id, status, hops of two redirects."""
    p = _pages(spark, sf_dir)
    code = lambda k: F.when((F.col("page_id") + k) % 3 == 0, 302).otherwise(301)
    where = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://sso."), ux.host(F.col("url")), F.lit("/x"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://h.test/SignIn?p="), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("https://h.test/p/"), F.col("page_id").cast("string")))
    hop = lambda s, u: F.struct(s.cast("int").alias("status"), u.alias("url"))
    return p.select("page_id", F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("status"), F.array(hop(code(0), where), hop(code(F.col("page_id") % 2), F.lit("https://h.test/end"))).alias("hops"))


@query("SELECT page_id, page_id % 5 <> 0 AND page_id % 3 <> 0 AND (page_id + page_id % 2) % 3 <> 0 AS permanent FROM pages")
def permanent_redirects(spark, sf_dir):
    return _chains(spark, sf_dir).select("page_id", vx.permanent_redirect(F.col("status"), F.col("hops")).alias("permanent"))


@query("SELECT page_id, page_id % 4 IN (0, 1) AS wall FROM pages")
def login_walls(spark, sf_dir):
    return _chains(spark, sf_dir).select("page_id", vx.login_wall(F.col("hops")).alias("wall"))


@query("""SELECT page_id, CASE WHEN page_id % 4 IN (0, 1) THEN 'login-wall' WHEN page_id % 5 <> 0 AND page_id % 3 <> 0 AND (page_id + page_id % 2) % 3 <> 0 THEN 'permanent-redirect' WHEN page_id % 5 = 0 THEN NULL
WHEN page_id % 7 = 0 THEN 'far-past' WHEN page_id % 11 = 0 THEN 'staleness-banner' WHEN page_id % 2 = 0 THEN 'version-drift' WHEN page_id % 3 = 0 THEN 'soft-404' END AS reason FROM pages""")
def rule_cascade(spark, sf_dir):
    """All heuristics in order, on synthetic observations."""
    c = _chains(spark, sf_dir)
    k = F.col("page_id")
    now = F.lit("2027-01-01").cast("timestamp")
    modified = F.when(k % 7 == 0, F.lit("2020-01-01").cast("timestamp"))
    body = F.when(k % 11 == 0, "This page is DEPRECATED").otherwise("text")
    reason = vx.cascade(F.concat(F.lit("https://h.test/v1/"), k.cast("string")), F.col("status"), F.col("hops"), modified, tx.staleness(body), F.when(k % 2 == 0, 200).otherwise(404), F.when(k % 3 == 0, 200).otherwise(404), F.lit(1.0), now)
    return c.select("page_id", reason.alias("reason"))


@query(f"""SELECT o_orderkey, a AS attempt, CASE WHEN s = 429 THEN greatest(least(30000, (o_orderkey % 50) * 1000), least(30000, 1000 * pow(2, a))) ELSE least(30000, 1000 * pow(2, a)) END::BIGINT AS wait_ms
FROM (SELECT o_orderkey, {_STATUS} AS s, unnest(range(0, 6))::INT AS a FROM orders) WHERE s >= 500 OR s IN (408, 429)""")
def retry_schedule(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", _status().alias("s")).filter(vx.retryable(F.col("s")))
    each = o.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return each.select("o_orderkey", "attempt", vx.wait_ms(F.col("s"), F.col("attempt"), F.col("o_orderkey") % 50).alias("wait_ms"))


@query(f"""SELECT o_orderkey, CASE WHEN NOT (s IN (401, 403) OR o_orderkey % 17 = 0 OR (s IN (429, 503) AND o_orderkey % 3 = 0)) THEN 1 WHEN s IN (401, 403) OR (s IN (403, 429, 503) AND o_orderkey % 6 = 0) THEN 3 ELSE 2 END AS tier FROM (SELECT o_orderkey, {_STATUS} AS s FROM orders)""")
def tier_escalation(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", _status().alias("s"))
    up = vx.escalates_to_cookies(F.col("s"), F.when(k % 17 == 0, "login-wall"), F.when(k % 3 == 0, "github.com").otherwise("h.test"))
    more = vx.escalates_to_browser(vx.confidence(F.when(F.col("s") != 429, "http-status"), F.col("s")), F.col("s"), F.when(k % 6 == 0, "a CAPTCHA"))
    return o.select("o_orderkey", F.when(~up, 1).when(more, 3).otherwise(2).alias("tier"))


_COOKIES = [("example.net", False, "/", False, None, "a", "1"), (".example.org", False, "/en", False, None, "b", "2"), ("example.com", True, "/", False, None, "c", "3"), ("example.com", False, "/de/", True, None, "d", "4"), ("example.net", False, "/", False, 5, "old", "x")]
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else f"'{v}'" for v in c) + ")" for c in _COOKIES)


@query(f"""WITH c AS (SELECT * FROM (VALUES {_VALUES}) t(domain, host_only, p, secure, expires, name, v)), u AS (SELECT page_id, url, {HOST.format('url')} AS h, {PATH.format('url')} AS path FROM pages)
SELECT page_id, string_agg(name || '=' || v, '; ' ORDER BY name) AS cookie FROM u JOIN c ON (h = ltrim(domain, '.') OR (NOT host_only AND ends_with(h, '.' || ltrim(domain, '.')))) AND (path = p OR (starts_with(path, p) AND (ends_with(p, '/') OR substr(path, length(p) + 1, 1) = '/')))
AND (NOT secure OR starts_with(url, 'https:')) AND (expires IS NULL OR expires > 1000) GROUP BY page_id""")
def cookie_headers(spark, sf_dir):
    """The Cookie header of each page from a short list of cookies (a setting, so broadcast), joined on domain suffixes."""
    c = spark.createDataFrame(_COOKIES, "domain string, host_only boolean, cookie_path string, secure boolean, expires long, name string, v string")
    u = _pages(spark, sf_dir).select("page_id", ux.host(F.col("url")).alias("h"), ux.path(F.col("url")).alias("path"), (ux.scheme(F.col("url")) == "https").alias("https"))
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = u.select("*", F.explode(suffixes).alias("d"))
    fit = each.join(F.broadcast(c.withColumn("d", F.ltrim(F.lower("domain"), F.lit(".")))), "d").filter(vx.cookie_applies(F.col("h"), F.col("path"), F.col("https"), F.lit(1000)))
    return fit.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "v"))), lambda x: F.concat(x["name"], F.lit("="), x["v"])), "; ").alias("cookie"))


@query("WITH u AS (SELECT page_id::VARCHAR AS url FROM pages WHERE page_id % 3 = 0), n AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS n FROM u) SELECT url, CASE WHEN n < 25 THEN (n % 4)::INT END AS slot, n >= 25 AS exhausted FROM n")
def browser_budget(spark, sf_dir):
    """The first 25 escalations of a run, dealt to four slots; the others get the verdict of an exhausted budget."""
    urls = _pages(spark, sf_dir).filter("page_id % 3 = 0").select(F.col("page_id").cast("string").alias("url"))
    said = F.when(F.col("slot").isNull(), vx.exhausted())
    return vx.budgeted(urls).select("url", "slot", F.coalesce(said["evidence"][0]["kind"] == "tier-3-budget-exhausted", F.lit(False)).alias("exhausted"))


def _cache(spark, sf_dir):
    """Synthetic cache rows for two of three pages."""
    k = F.col("page_id")
    verdict = F.when(k % 5 == 0, "{bad").when(k % 5 == 1, '{"confidence":"auth-walled"}').when(k % 5 == 2, '{"confidence":"suspect"}')
    return _pages(spark, sf_dir).filter(k % 3 != 0).select(F.concat(ux.normalised(F.col("url")), F.lit("|"), k.cast("string")).alias("url"), verdict.alias("verdict_json"), (100000 - (k % 10) * 10).alias("checked_at"), (k % 3).cast("int").alias("tier"))


def _looked(spark, sf_dir):
    urls = _pages(spark, sf_dir).select("page_id", F.concat(ux.normalised(F.col("url")), F.lit("|"), F.col("page_id").cast("string")).alias("url"))
    return cx.lookup(urls, _cache(spark, sf_dir), now=100000, ttl=60, cap=2)


_HIT = "page_id % 3 <> 0 AND (page_id % 10) * 10 <= 60 AND page_id % 5 <> 0 AND (page_id % 5 <> 1 OR page_id % 3 >= 2)"


@query(f"SELECT page_id, {_HIT} AS hit FROM pages")
def cache_lookup(spark, sf_dir):
    return _looked(spark, sf_dir).select("page_id", "hit")


@query(f"SELECT count(*) FILTER ({_HIT}) AS hits, count(*) FILTER (NOT ({_HIT})) AS misses, count(*) FILTER (page_id % 3 <> 0) AS entries FROM pages")
def cache_stats(spark, sf_dir):
    return cx.stats(_looked(spark, sf_dir), _cache(spark, sf_dir))


@query("SELECT page_id % 100 AS k, max(page_id) AS checked_at FROM pages GROUP BY 1")
def cache_upsert(spark, sf_dir):
    """Pages as cache rows of 100 URLs: the newest stays."""
    rows = _pages(spark, sf_dir).select((F.col("page_id") % 100).cast("string").alias("url"), F.lit(None).cast("string").alias("verdict_json"), F.col("page_id").alias("checked_at"), F.lit(1).alias("tier"))
    return cx.upsert(rows.filter("checked_at % 2 = 0"), rows.filter("checked_at % 2 = 1")).select(F.col("url").cast("long").alias("k"), "checked_at")


@query(f"WITH h AS ({HREF}), c AS (SELECT DISTINCT {PATH.format('url')} AS p FROM pages), f AS (SELECT p FROM c UNION SELECT regexp_replace(p, '/[^/]*$', '') FROM c) SELECT page_id, href FROM (SELECT DISTINCT page_id, href FROM h) ANTI JOIN f ON href = p")
def local_missing(spark, sf_dir):
    """Rooted links to what is neither a page's path nor a folder of one."""
    links = _hrefs(spark, sf_dir).select(F.concat(F.lit("/#"), F.col("page_id").cast("string")).alias("path"), F.col("href").alias("url"))
    catalogue = _pages(spark, sf_dir).select(ux.path(F.col("url")).alias("path"))
    return local.missing(links, catalogue).select(F.substring("path", 3, 20).cast("long").alias("page_id"), F.col("url").alias("href"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower('Part #' || p_partkey || ': Über_das  ' || p_partkey % 7), '[^\\p{L}\\p{N}\\s_-]', '', 'g'), '\\s', '-', 'g') AS slug FROM part")
def heading_slugs(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", tx.slug(F.concat(F.lit("Part #"), k.cast("string"), F.lit(": Über_das  "), (k % 7).cast("string"))).alias("slug"))


@query("SELECT page_id, '/d' || page_id % 20 || '#a' || page_id % 7 AS url FROM pages WHERE page_id % 7 >= 5")
def anchor_missing(spark, sf_dir):
    """Synthetic: 20 documents with anchors a0 to a4, and links to a0 to a6."""
    k = F.col("page_id")
    links = _pages(spark, sf_dir).select(k.cast("string").alias("path"), F.concat(F.lit("/d"), (k % 20).cast("string"), F.lit("#a"), (k % 7).cast("string")).alias("url"))
    docs = spark.range(20).select(F.concat(F.lit("/d"), F.col("id").cast("string")).alias("path"))
    anchors = docs.select("path", F.explode(F.array(*(F.lit(f"a{i}") for i in range(5)))).alias("anchor"))
    return local.missing(links, docs, anchors).select(F.col("path").cast("long").alias("page_id"), "url")


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'bad' WHEN 1 THEN 'ok' WHEN 2 THEN 'bad' WHEN 3 THEN 'ok' WHEN 4 THEN 'bad' ELSE 'bad' END AS verdict FROM pages")
def mailto_tel_syntax(spark, sf_dir):
    u = F.element_at(F.array(*(F.lit(x) for x in ("mailto:a@b", "MAILTO:a@b.test", "mailto:a b@c.test", "tel:+1 (2) 3-4", "TEL:12x", "mailto:@x.y"))), (F.col("page_id") % 6 + 1).cast("int"))
    links = _pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("path"), u.alias("url"))
    bad = local.contacts(links).select(F.col("path").cast("long").alias("page_id"), F.lit("bad").alias("v"))
    return _pages(spark, sf_dir).select("page_id").join(bad, "page_id", "left").select("page_id", F.coalesce("v", F.lit("ok")).alias("verdict"))


@query("SELECT page_id, CASE WHEN page_id % 6 = 3 THEN 'https://h.test/' || page_id WHEN page_id % 3 = 1 THEN 'https://h.test/v2/' || page_id END AS replacement_url, CASE WHEN page_id % 6 = 3 THEN 'redirect-target' WHEN page_id % 3 = 1 THEN 'version-upgrade' END AS origin FROM pages")
def suggested_fixes(spark, sf_dir):
    k = F.col("page_id")
    e = lambda kind, d: F.struct(F.lit(kind).alias("kind"), d.alias("detail"))
    evidence = F.array(e("redirect-chain", F.lit("a -> b")), e("redirect-target", F.when(k % 2 == 0, "ftp://x").otherwise(F.concat(F.lit("https://h.test/"), k.cast("string")))), e("redirect-target", F.lit("https://second.test/")), e("version-upgrade", F.concat(F.lit("https://h.test/v2/"), k.cast("string"))))
    fix = fixes.suggested(F.when(k % 3 == 0, "permanent-redirect").when(k % 3 == 1, "version-drift").otherwise("far-past"), evidence)
    return _pages(spark, sf_dir).select("page_id", fix["replacement_url"].alias("replacement_url"), fix["origin"].alias("origin"))


@query("SELECT page_id % 10 AS doc, count(*) AS n FROM pages WHERE page_id % 4 >= 2 AND page_id % 10 <> 1 AND page_id % 2 = 0 GROUP BY 1")
def fix_selection(spark, sf_dir):
    """Synthetic findings: those certain enough, without PDFs and redirects, by document."""
    k = F.col("page_id")
    f = _pages(spark, sf_dir).select(F.col("url").alias("replacement_url"), (k % 10).alias("doc"), F.when(k % 10 == 1, "pdf").otherwise("html").alias("format"), F.when(k % 2 == 0, "version-upgrade").otherwise("redirect-target").alias("origin"), (k % 4).alias("rank"))
    return fixes.selected(f, 2, ["pdf", "redirect"]).groupBy("doc").agg(F.count("*").alias("n"))


@query("SELECT (page_id % 50)::VARCHAR AS path, (page_id % 5)::VARCHAR AS old FROM pages GROUP BY 1, 2 HAVING count(DISTINCT page_id % 3) > 1")
def fix_conflicts(spark, sf_dir):
    k = F.col("page_id")
    return fixes.conflicts(_pages(spark, sf_dir).select((k % 50).cast("string").alias("path"), (k % 5).cast("string").alias("old"), (k % 3).cast("string").alias("new")))


@query("""WITH e AS (SELECT l_orderkey AS path, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity::BIGINT AS e FROM lineitem), w AS (SELECT *, max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e) SELECT path, s AS start, e AS "end" FROM w WHERE s < b""")
def edit_overlaps(spark, sf_dir):
    """Line items as edits of their order, held against all that start before them."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber").cast("long") * 10).alias("start"), (F.col("l_linenumber").cast("long") * 10 + F.col("l_quantity").cast("long")).alias("end"))
    return fixes.overlaps(e)


REASONS = ["http-status", "network-error", "soft-404", "login-wall", "permanent-redirect", "staleness-banner", "version-drift", "far-past", "anomalous-response", "local-missing", "syntax-invalid"]
NETWORK = ["dns", "tls", "timeout", "conn-refused", "other"]


def _pick(values: list, key):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def _list(values: list, key: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({key} % {len(values)})::INT + 1]"


def _findings(spark, sf_dir) -> DataFrame:
    """Synthetic findings of the orders, of every reason: path, format, url, line, column, reason, detail, confidence."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("doc "), (k % 97).cast("string"), F.lit(".md")).alias("path"), F.lit("markdown").alias("format"), F.concat(F.lit("https://h.test/"), k.cast("string")).alias("url"), F.when(k % 2 == 0, k % 31 + 1).alias("line"), F.when(k % 2 == 0, k % 7 + 1).alias("column"), _pick(REASONS, k).alias("reason"), _status().alias("s"), k.alias("k"))
    detail = F.when(F.col("reason") == "http-status", F.col("s").cast("string")).when(F.col("reason") == "network-error", _pick(NETWORK, F.col("k")))
    return o.select("path", "format", "url", "line", "column", "reason", detail.alias("detail"), vx.confidence(F.col("reason"), F.col("s")).alias("confidence"))


_FIND = f"""SELECT 'doc ' || o_orderkey % 97 || '.md' AS path, 'https://h.test/' || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 31 + 1 END AS line, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 + 1 END AS col, r, s, n,
CASE WHEN r = 'http-status' THEN CASE WHEN s IN (401, 403) THEN 'auth-walled' WHEN s IN (404, 410, 451) THEN 'dead-certain' ELSE 'suspect' END WHEN r IN ('network-error', 'soft-404') THEN 'likely-dead' WHEN r = 'login-wall' THEN 'auth-walled'
WHEN r IN ('permanent-redirect', 'staleness-banner', 'version-drift') THEN 'outdated' WHEN r IN ('far-past', 'anomalous-response') THEN 'suspect' ELSE 'dead-certain' END AS confidence
FROM (SELECT o_orderkey, {_STATUS} AS s, {_list(REASONS, 'o_orderkey')} AS r, {_list(NETWORK, 'o_orderkey')} AS n FROM orders)"""
_NAMES = "CASE r " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.SARIF_NAME.items()) + " END"
_IDS = "CASE r " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.SARIF_ID.items()) + " END"
_SHOWN = "CASE r WHEN 'http-status' THEN 'HTTP ' || s WHEN 'network-error' THEN 'NetworkError(' || CASE n " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.NETWORK_NAME.items()) + " END || ')' " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.TABLE_NAME.items()) + " END"
_ORDER = "CASE confidence WHEN 'dead-certain' THEN 0 WHEN 'likely-dead' THEN 1 WHEN 'outdated' THEN 2 WHEN 'auth-walled' THEN 3 ELSE 4 END"


@query(f"SELECT {_ORDER} AS \"order\", upper(confidence) AS confidence, url, CASE WHEN line IS NULL THEN path ELSE path || ':' || line || ':' || col END AS source, {_SHOWN} AS reason FROM ({_FIND})")
def report_rows(spark, sf_dir):
    return report.rows(_findings(spark, sf_dir))


@query(f"SELECT {', '.join(f"count(*) FILTER (confidence = '{c}' AND {_ORDER} <= 3) AS {c.replace('-', '_')}" for c in report.COUNTS)} FROM ({_FIND})")
def confidence_counts(spark, sf_dir):
    """After the least confidence to report."""
    return report.counts(report.filtered(_findings(spark, sf_dir), "auth-walled"))


@query(f"SELECT (count(*) FILTER (confidence = 'dead-certain') > 0)::INT AS exit_code FROM ({_FIND})")
def exit_codes(spark, sf_dir):
    return report.exit_code(_findings(spark, sf_dir), "dead-certain")


@query(f"SELECT DISTINCT {_IDS} AS id, {_NAMES} AS name FROM ({_FIND})")
def sarif_rules(spark, sf_dir):
    return report.sarif_rules(_findings(spark, sf_dir))


@query(f"SELECT {_IDS} AS rule_id, CASE {_ORDER} WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'warning' ELSE 'note' END AS level, (100.0 - 20 * {_ORDER})::DOUBLE AS rank, {_NAMES} || ': ' || url AS message, replace(path, ' ', '%20') AS uri, url, line, col AS \"column\" FROM ({_FIND})")
def sarif_results(spark, sf_dir):
    return report.sarif_results(_findings(spark, sf_dir))


_WIDE = f"SELECT upper(confidence) AS a, url AS b, CASE WHEN line IS NULL THEN path ELSE path || ':' || line || ':' || col END AS c, {_SHOWN} AS d FROM ({_FIND})"


@query(f"""WITH r AS ({_WIDE}), w AS (SELECT greatest(10, max(length(a))) AS a, greatest(3, max(length(b))) AS b, greatest(6, max(length(c))) AS c, greatest(6, max(length(d))) AS d FROM r)
SELECT rtrim(rpad(r.a, w.a::INT, ' ') || '  ' || rpad(r.b, w.b::INT, ' ') || '  ' || rpad(r.c, w.c::INT, ' ') || '  ' || r.d) AS line FROM r, w UNION ALL SELECT rpad('CONFIDENCE', a::INT, ' ') || '  ' || rpad('URL', b::INT, ' ') || '  ' || rpad('SOURCE', c::INT, ' ') || '  REASON' FROM w""")
def report_table(spark, sf_dir):
    """The lines of the aligned table, its head among them."""
    whole = report.table_document(_findings(spark, sf_dir))
    return whole.objects.select(F.col("text").alias("line")).unionByName(spark.createDataFrame([(whole.head,)], "line string"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 70 WHEN o_orderkey % 3 = 0 THEN 30 WHEN o_orderkey % 2 = 0 THEN 20 ELSE 4 END AS per_host, (CASE WHEN o_orderkey % 2 = 0 THEN 90 ELSE 20 END)::DOUBLE AS timeout_s,
concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'flag.test' END, CASE WHEN o_orderkey % 3 = 0 THEN 'env.test' WHEN o_orderkey % 2 = 0 THEN 'file.test,b.test' END) AS domains FROM orders""")
def config_precedence(spark, sf_dir):
    """Settings of an order each, loaded with or without a flag, an environment and a file: the first that is there counts, lists of flags are added."""
    at = mounted(folder(spark, "settings"))
    for name in ("with", "without"):
        os.makedirs(f"{at}/{name}")
    with open(f"{at}/with/{config.FILE}", "w") as f:
        f.write('[network]\nper-host = 20\ntimeout = "1m 30s"\n[ignore]\nexclude-domain = ["file.test", "b.test"]\n')
    with open(f"{at}/without/{config.FILE}", "w") as f:
        f.write("")

    k = F.col("o_orderkey")
    flags = F.when(k % 7 == 0, json.dumps({"network_per_host": 70, "ignore_exclude_domain": ["flag.test"]}))
    env = F.when(k % 3 == 0, json.dumps({"LINKLOOM_NETWORK_PER_HOST": "30", "LINKLOOM_IGNORE_EXCLUDE_DOMAIN": " env.test, "}))
    start = F.when(k % 2 == 0, f"{at}/with").otherwise(f"{at}/without")
    kept = Scratch(spark)
    found = config.loaded(table(spark, sf_dir, "orders").select("o_orderkey", flags.alias("flags"), start.alias("start"), env.alias("env")), kept)
    of = F.col("settings")
    out = kept.settle(found.select("o_orderkey", of["network_per_host"].alias("per_host"), of["network_timeout"].alias("timeout_s"), F.array_join(of["ignore_exclude_domain"], ",").alias("domains")), "loaded")
    kept.keep(out)
    kept.drop(*kept.tables())
    remove(spark, f"file://{at}")
    return out


@query("SELECT count(*) FILTER (page_id % 3 = 0) AS n_written, count(*) FILTER (page_id % 3 = 1) AS n_failed, count(*) FILTER (page_id % 3 = 2) AS n_refused, (count(*) FILTER (page_id % 3 > 0) > 0)::INT AS exit_code FROM pages")
def fix_outcome(spark, sf_dir):
    """What a run of fixes counts: written, failed and refused, and the exit code."""
    p = _pages(spark, sf_dir)
    done = p.filter("page_id % 3 < 2").select(F.col("url").alias("path"), F.when(F.col("page_id") % 3 == 1, "exists").alias("error"))
    return commit.outcome(done, p.filter("page_id % 3 = 2").select(F.col("url").alias("path"), F.lit("signed").alias("reason")))


_SETTINGS = ["retries", "timeout", "exclude", "include", "per-host", "user-agent"]


@query(f"""WITH k AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(_SETTINGS))}) t(i, name)), b AS (SELECT page_id, name, (page_id // 6) % length(name) AS cut FROM (SELECT page_id, {_list(_SETTINGS, 'page_id')} AS name FROM pages)),
w AS (SELECT page_id, substr(name, 1, cut) || CASE WHEN page_id % 2 = 0 THEN '' ELSE 'x' END || substr(name, cut + 2) AS bad FROM b) SELECT page_id, bad, arg_min(name, levenshtein(bad, name) * 100 + i) AS meant FROM w, k GROUP BY page_id, bad""")
def did_you_mean(spark, sf_dir):
    """Names of settings with a letter lost or changed, one a page, and the nearest known one."""
    k = F.col("page_id")
    name = _pick(_SETTINGS, k)
    cut = (F.floor(k / 6) % F.length(name)).cast("int")
    bad = F.concat(F.substring(name, F.lit(1), cut), F.when(k % 2 == 0, "").otherwise("x"), F.substring(name, cut + 2, F.lit(99)))
    keys = _pages(spark, sf_dir).select("page_id", bad.alias("key"))
    meant = config.suggested(keys.select("key").distinct(), _SETTINGS)
    return keys.join(meant, "key").select("page_id", F.col("key").alias("bad"), "meant")


def _zip_of(*names: str) -> bytes:
    """A fixed small archive."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(zipfile.ZipInfo(n), "x")
    return out.getvalue()


@query("""SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'pdf' WHEN 1 THEN 'markdown' WHEN 2 THEN 'html' WHEN 3 THEN 'text' WHEN 4 THEN 'docx' WHEN 6 THEN 'docx' WHEN 7 THEN 'xlsx' WHEN 8 THEN 'pptx' WHEN 9 THEN 'text' END AS format FROM pages WHERE page_id % 12 NOT IN (5, 10, 11) AND NOT (page_id % 12 = 3 AND page_id % 24 = 3)""")
def detect_formats(spark, sf_dir):
    """Synthetic files: magic over members over extension over content; other binaries, content that is not UTF-8, and unknown files over 2 MiB, are left out."""
    k = F.col("page_id") % 12
    name = _pick(["a.txt", "b.MD", "c.html", "noext", "d.docx", "e.bin", "f.txt", "g", "h.html", "i.txt", "j.dat", "k.bin"], F.col("page_id"))
    zips = {6: _zip_of("word/a.xml"), 7: _zip_of("xl/a.xml"), 8: _zip_of("ppt/a.xml"), 9: _zip_of("other/a"), 10: _zip_of("other/a")}
    body = F.when(F.col("page_id") % 24 == 3, F.unhex(F.lit("89504E47FFFE80"))).when(k == 0, F.encode(F.lit("%PDF-1.7"), "utf-8")).when(k == 5, F.unhex(F.lit("000102030405")))
    for i, z in zips.items():
        body = body.when(k == i, F.lit(bytearray(z)))
    body = body.otherwise(F.encode(F.lit("plain text"), "utf-8"))
    size = F.when(k == 11, files.UNKNOWN_LIMIT + 1).otherwise(F.length(body)).cast("long")
    f = _pages(spark, sf_dir).select(F.concat(F.col("page_id").cast("string"), F.lit("/"), name).alias("path"), size.alias("length"), body.alias("content"))
    return files.detected(f).select(F.substring_index("path", "/", 1).cast("long").alias("page_id"), "format")


@query(f"SELECT page_id, href, CASE WHEN length(href) % 2 = 0 THEN 'dead-certain' ELSE 'suspect' END AS confidence FROM ({HREF})")
def fan_out(spark, sf_dir):
    """One verdict a distinct link, joined back to every occurrence."""
    links = _hrefs(spark, sf_dir)
    verdicts = links.select("href").distinct().withColumn("confidence", F.when(F.length("href") % 2 == 0, "dead-certain").otherwise("suspect"))
    return links.join(verdicts, "href").select("page_id", "href", "confidence")


def _generated(spark, sf_dir, kind: str, body) -> DataFrame:
    docs = _pages(spark, sf_dir).select(F.concat(F.col("page_id").cast("string"), F.lit("." + kind)).alias("path"), F.lit(kind).alias("format"), F.encode(body, "utf-8").alias("content"))
    return extract.links(docs).select("path", "url", F.col("location.line").alias("line"), F.col("location.column").alias("col"), "start", "end")


@query("SELECT page_id || '.markdown' AS path, CASE i WHEN 1 THEN url ELSE 'https://ref.test/' || page_id END AS url, CASE i WHEN 1 THEN 1 ELSE 3 END::BIGINT AS line, CASE i WHEN 1 THEN 10 ELSE 6 END::BIGINT AS col, CASE i WHEN 1 THEN 9 ELSE 26 + strlen(url) END AS start, CASE i WHEN 1 THEN 9 + strlen(url) ELSE 26 + strlen(url) + strlen('https://ref.test/' || page_id) END AS \"end\" FROM pages, (VALUES (1), (2)) t(i)")
def markdown_links(spark, sf_dir):
    """Generated: an inline link, and a reference with its definition."""
    return _generated(spark, sf_dir, "markdown", F.concat(F.lit("A [link]("), F.col("url"), F.lit(") [Ref][r]\n\n[r]: https://ref.test/"), F.col("page_id").cast("string"), F.lit("\n")))


@query("SELECT page_id || '.text' AS path, 'https://t.test/' || page_id AS url, 2::BIGINT AS line, 5::BIGINT AS col, 12::BIGINT AS start, 12 + strlen('https://t.test/' || page_id) AS \"end\" FROM pages")
def text_links(spark, sf_dir):
    """Generated: a URL behind letters of two bytes, and before a full stop."""
    return _generated(spark, sf_dir, "text", F.concat(F.lit("Intro\nüé: https://t.test/"), F.col("page_id").cast("string"), F.lit(". https://. end")).substr(F.lit(1), F.lit(500)))


@query(f"SELECT page_url AS path, href AS url, 'local-missing' AS reason, 'resolved path does not exist: ' || href AS detail, 'dead-certain' AS confidence, 0 AS tier FROM ({HREF})")
def html_documents_scan(spark, sf_dir):
    """The whole scan of the pages as documents: none of their rooted links is a document's path."""
    from linkloom.plans.scan import flat, scan

    out = scan(files.pages_as_documents(_pages(spark, sf_dir)))
    return flat(out.findings).select("path", "url", "reason", "detail", "confidence", "tier")


def queries() -> dict:
    from linkloom import document_queries  # noqa: F401  (registers its own)

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    from linkloom import document_queries  # noqa: F401

    return dict(SQL)
