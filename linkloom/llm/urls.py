"""Operator 4: URL filters whose rules are indexed by their rarest literal token.

Rules come as a list on the driver (a parameter, so of bounded size). Every literal token of a
rule that a matching URL must hold whole is counted over all URLs; the rule is filed under the
rarest, in a hash table that goes to all tasks as one constant. A URL's own tokens fetch the rules filed under them,
and only fetched rules are tried: host rules by comparing, patterns by regular expression. Rules
without such a token are tried on every URL. A URL is judged where it is read: nothing is joined or shuffled. DataFrame functions only.

Pattern syntax: ``||`` at the start: after ``://``, at the host or a subdomain; ``|`` at the
start or end: there the URL starts or ends; ``^``: a separator (not a letter, digit, or one of
``_-.%``) or the end; ``*``: anything. Letters match in either case (A-Z).

Defined results: a null URL or one without ``://`` has an empty host and path; no rule fits it,
and the verdict is allow; of rules that fit, the longest host rule wins, of equal ones the first, then an allow pattern
over block patterns, of equal ones the first; repeated rows are judged alike, URLs of any length whole; an empty table gives no
rows; columns that are not named are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host rule (``pattern`` is host and path) or a pattern; ``action`` is allow or block."""

    action: str
    pattern: str
    host: bool = False


HOST_RULES = (Rule("block", "net/", True), Rule("allow", "example.net/en/", True), Rule("block", "example.com/de/", True), Rule("allow", "org/fr/", True))
#: Used where no host rule fits. Allow patterns win over block patterns.
PATTERNS = (
    Rule("block", "||ads.*^"), Rule("block", "||adserver.*^"), Rule("block", "||track.*^"), Rule("block", "||login.*^"),
    Rule("block", "/login^"), Rule("block", "/signin^"), Rule("block", "/cart^"), Rule("block", "/checkout^"), Rule("block", "/wp-admin/"),
    Rule("block", "/cgi-bin/"), Rule("block", "?replytocom="), Rule("block", "&replytocom="), Rule("block", "^sessionid="), Rule("block", "^phpsessid="),
    Rule("block", "^utm_source=ad^"), Rule("block", "/search?"), Rule("block", "/tag/*/page/"), Rule("block", "/print/|"), Rule("block", "^casino^"), Rule("block", "^porn^"),
    Rule("allow", "||docs.*^"), Rule("allow", "/login/help^"),
)


def tokens_of(rule: Rule) -> list[str]:
    """Literal tokens that any URL fitting the rule holds between separators."""
    text = rule.pattern.translate(str.maketrans(UPPER, LOWER))
    if rule.host:
        text = f"||{text}*"  # its path is a prefix
    out = []
    for m in re.finditer("[a-z0-9]+", text):
        before, after = text[: m.start()][-1:], text[m.end() :][:1]
        if before and before != "*" and after and after != "*":
            out.append(m[0])
    return out


def regex_of(pattern: str) -> str:
    """A regular expression (the same in Java and RE2) of a pattern, for lower-case URLs."""
    text = pattern.translate(str.maketrans(UPPER, LOWER))
    head = tail = ""
    if text.startswith("||"):
        head, text = "^[^:]*://([^/?#]*[.])?", text[2:]
    elif text.startswith("|"):
        head, text = "^", text[1:]
    if text.endswith("|"):
        tail, text = "$", text[:-1]
    body = "".join("(?s:.*)" if c == "*" else "(?:[^a-z0-9_.%-]|$)" if c == "^" else c if c.isalnum() else f"[{c}]" if c not in "\\[]^" else f"\\{c}" for c in text)
    return head + body + tail


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower(F.coalesce(url, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def index(urls: DataFrame, column: str, rules: tuple[Rule, ...]) -> list[tuple[str, Rule]]:
    """(token, rule), each rule under its token that is rarest in the URLs; "" if it has none."""
    spark = urls.sparkSession
    wanted = sorted({t for r in rules for t in tokens_of(r)})
    if not wanted:
        return [("", r) for r in rules]
    known = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "token string"))  # as many as the rules name
    counts = urls.select(F.explode(url_tokens(F.col(column))).alias("token")).join(known, "token", "left_semi").groupBy("token").count()
    n = dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in counts.collect()}
    return [(min(t, key=lambda x: (n[x], -len(x), x)) if (t := tokens_of(r)) else "", r) for r in rules]


_RULE = "struct<token:string,is_host:boolean,pattern:string,action:string,r_host:string,r_path:string,regex:string,rank:int>"


def _table(urls: DataFrame, filed: list[tuple[str, Rule]]) -> tuple[Column, int]:
    """The rules as an array of buckets by crc32 of their token, and the number of buckets."""
    size = max(1, 2 * len(filed))
    buckets: list[list[tuple]] = [[] for _ in range(size)]
    for i, (token, r) in enumerate(filed):
        host, slash, path = r.pattern.partition("/") if r.host else ("", "", "")
        buckets[zlib.crc32(token.encode()) % size].append((token, r.host, r.pattern, r.action, host, slash + path, "" if r.host else regex_of(r.pattern), i))
    return urls.sparkSession.createDataFrame([(buckets,)], f"buckets array<array<{_RULE}>>").scalar(), size


def judged(pages: DataFrame, hosts: tuple[Rule, ...] = HOST_RULES, patterns: tuple[Rule, ...] = PATTERNS, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule (the longest host rule that fits), verdict, pattern (the method's deciding pattern)."""
    table, size = _table(pages, index(pages, url, hosts + patterns))
    host, path = host_path(F.col(url))
    # the empty token fetches the rules that have none
    tokens = F.array_append(url_tokens(F.col(url)), F.lit(""))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), host.alias("host"), path.alias("path"), tokens.alias("tokens"), table.alias("table"))
    bucket = lambda t: F.element_at("table", (F.crc32(t.cast("binary")) % size + 1).cast("int"))
    fetched = F.flatten(F.transform("tokens", lambda t: F.filter(bucket(t), lambda r: r["token"] == t)))
    rows = rows.select("k", "u", "host", "path", fetched.alias("fetched"))
    on_host = lambda r: r["is_host"] & ((F.col("host") == r["r_host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["r_host"]))) & F.startswith(F.col("path"), r["r_path"])
    low = lower(F.col("u"))
    fits = lambda r: ~r["is_host"] & F.regexp_like(low, r["regex"])
    by_host = F.array_max(F.transform(F.filter("fetched", on_host), lambda r: F.struct(F.length(r["pattern"]).alias("n"), (-r["rank"]).alias("rank"), r["pattern"].alias("pattern"), r["action"].alias("action"))))
    by_pattern = F.array_max(F.transform(F.filter("fetched", fits), lambda r: F.struct((r["action"] == "allow").alias("allows"), (-r["rank"]).alias("rank"), r["pattern"].alias("pattern"), r["action"].alias("action"))))
    rows = rows.select("k", "host", "path", by_host.alias("by_host"), F.when(F.instr("u", "://") > 0, by_pattern).alias("by_pattern"))
    verdict = F.coalesce("by_host.action", "by_pattern.action", F.lit("allow"))
    return rows.select(F.col("k").alias(key), "host", "path", F.col("by_host.pattern").alias("rule"), verdict.alias("verdict"), F.when(F.col("by_host").isNull(), F.col("by_pattern.pattern")).alias("pattern"))


def oracle(hosts: tuple[Rule, ...] = HOST_RULES, patterns: tuple[Rule, ...] = PATTERNS) -> str:
    """The same by trying every rule on every URL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    h = ", ".join(f"({q(r.pattern)}, {q(r.action)}, {q(r.pattern.partition('/')[0])}, {q('/' + r.pattern.partition('/')[2])})" for r in hosts)
    p = ", ".join(f"({i}, {q(r.pattern)}, {q(r.action)}, {q(regex_of(r.pattern))})" for i, r in enumerate(patterns))
    return f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT r, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT * FROM (VALUES {h}) t(rule, action, h, p)),
p AS (SELECT * FROM (VALUES {p}) t(i, pattern, action, regex)),
hm AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM s JOIN h ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
pm AS (SELECT r, arg_min(pattern, (CASE action WHEN 'allow' THEN 0 ELSE 1000 END) + i) AS pattern, arg_min(action, (CASE action WHEN 'allow' THEN 0 ELSE 1000 END) + i) AS action FROM s JOIN p ON instr(url, '://') > 0 AND regexp_matches(translate(url, '{UPPER}', '{LOWER}'), regex) GROUP BY r)
SELECT page_id, host, path, hm.rule AS rule, coalesce(hm.action, pm.action, 'allow') AS verdict, CASE WHEN hm.rule IS NULL THEN pm.pattern END AS pattern
FROM s LEFT JOIN hm USING (r) LEFT JOIN pm USING (r)"""
