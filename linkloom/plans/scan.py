"""The whole audit: documents, links, one check of each distinct link, findings at every occurrence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls as ux
from linkloom.operators import cache as cx
from linkloom.operators import extract, fixes, local
from linkloom.operators import verdicts as vx
from linkloom.plans import judge
from linkloom.tables import Scratch

FINDING = ["path", "format", "url", "resolved_url", "location", "start", "end", "verdict", "fix"]


@dataclass(frozen=True)
class Scan:
    """findings: a row an occurrence, with verdict and suggested fix; run: one row of counts.

    cache: rows to put over the cache, and stale: the URLs whose rows there are malformed. ``close`` removes the tables behind them.
    """

    findings: DataFrame
    run: DataFrame
    cache: DataFrame | None
    stale: DataFrame | None
    tables: Scratch

    def close(self) -> None:
        self.tables.drop(*self.tables.tables())


def read(docs: DataFrame, own: Scratch, mode: str = "failfast") -> DataFrame:
    """Links and anchors of docs (path, format, content), read once."""
    return own.settle(extract.read(docs, mode), "links")


def web_urls(read: DataFrame) -> DataFrame:
    """The different http URLs of read documents."""
    return read.filter(F.col("url").isNotNull() & (ux.link_kind(F.col("url")) == "http")).select("url").distinct()


def local_verdict(reason: Column, detail: Column) -> Column:
    return vx.verdict(reason, None, "local-link", detail, 0)


def scan(docs: DataFrame, observations: DataFrame | None = None, exclude_urls=(), exclude_domains=(), mode: str = "failfast", check_local: bool = True, auth: str = "cookies", now: Column | None = None, cache: DataFrame | None = None, ttl: int = 24 * 3600, refresh: bool = False, files: DataFrame | None = None, own: Scratch | None = None, links: DataFrame | None = None) -> Scan:
    """docs: path, format, content. observations: see ``judge.judged``. links: docs as ``read`` gives them, if they were read before.

    files: the walked paths (path), if more than docs (unknown formats are counted too). cache:
    verdicts of earlier scans (cache.SCHEMA); fresh ones are used in place of observations, unless
    ``refresh``. Documents are read once: their links and anchors are settled and read from there.
    Tables belong to ``own``, or to the scan, which removes them when it is closed.
    """
    now = F.current_timestamp() if now is None else now
    cap = judge.CAPS[auth]
    own = own or Scratch(docs.sparkSession)
    whole = read(docs, own, mode) if links is None else links
    found = whole.filter("url is not null")
    keep = ~ux.excluded_by_pattern(F.col("url"), list(exclude_urls)) & ~ux.excluded_by_domain(F.col("url"), list(exclude_domains))
    links = found.filter(keep).select("path", "format", "url", "location", "start", "end", ux.link_kind(F.col("url")).alias("kind"))
    parts = []
    if check_local:
        near = links.filter(F.col("kind").isin("local", "anchor"))
        anchors = whole.filter("has_anchors").select("path", "anchor")
        bad = local.missing(near, docs if files is None else files, anchors).unionByName(local.contacts(links.filter(F.col("kind").isin("mailto", "tel"))))
        said = bad.select("path", "url", local_verdict(F.col("reason"), F.col("detail")).alias("verdict"))
        parts.append(links.join(said, ["path", "url"]))
    web = links.filter("kind = 'http'")
    urls = web.select("url").distinct()
    kept = stale = None
    if observations is not None or cache is not None:
        rows = urls.withColumns({"hit": F.lit(False), "verdict_json": F.lit(None).cast("string")})
        if cache is not None and not refresh:
            rows = cx.lookup(urls.withColumn("key", ux.normalised(F.col("url"))), cache, F.unix_timestamp(now), ttl, cap, "key").select("url", "hit", "verdict_json")
            stale = cache.join(urls.select(ux.normalised(F.col("url")).alias("url")).distinct(), "url", "left_semi").join(cx.wellformed(cache).select("url"), "url", "left_anti").select("url")
        rows = own.settle(rows, "urls")
        verdicts = rows.filter("hit").select("url", F.lit(True).alias("checked"), F.from_json("verdict_json", vx.VERDICT).alias("verdict"), F.lit(False).alias("fresh"))
        if observations is not None:
            verdicts = verdicts.unionByName(judge.judged(rows.filter("NOT hit"), observations, now, auth, own).withColumn("fresh", F.lit(True)))
        verdicts = own.settle(verdicts, "verdicts")
        parts.append(web.join(verdicts.filter("verdict is not null").select("url", "verdict"), "url"))
        if cache is not None:
            kept = verdicts.filter("fresh AND checked").select(ux.normalised(F.col("url")).alias("url"), F.to_json("verdict").alias("verdict_json"), F.unix_timestamp(now).alias("checked_at"), F.coalesce("verdict.tier", F.lit(cap)).alias("tier"))
    findings = None
    for part in parts:
        one = part.select("path", "format", "url", F.lit(None).cast("string").alias("resolved_url"), "location", "start", "end", F.col("verdict").withField("checked_at", now).alias("verdict"))
        findings = one if findings is None else findings.unionByName(one)
    if findings is None:
        findings = links.limit(0).select("path", "format", "url", F.lit(None).cast("string").alias("resolved_url"), "location", "start", "end", F.lit(None).cast(vx.VERDICT).withField("checked_at", now).alias("verdict"))
    findings = findings.withColumn("fix", fixes.suggested(F.col("verdict.reason.kind"), F.col("verdict.evidence")))
    unit = F.when(F.col("kind") == "http", F.struct(F.lit("").alias("path"), "url")).when(F.lit(check_local) & F.col("kind").isin("local", "anchor", "mailto", "tel"), F.struct("path", "url"))
    counted = links.agg(F.countDistinct(unit).alias("links_unique"), F.count("*").alias("links"))
    walked = (docs if files is None else files).agg(F.count("*").alias("files_scanned"))
    run = counted.join(walked).select("files_scanned", F.col("links_unique").alias("links_checked"), "links_unique", "links")  # one row each
    return Scan(findings.select(*FINDING), run, kept, stale, own)


def flat(findings: DataFrame) -> DataFrame:
    """Findings with the columns that reports and filters read."""
    v = F.col("verdict")
    detail = F.coalesce(v["reason"]["detail"], F.get(v["evidence"], F.lit(0))["detail"])
    return findings.select("path", "format", "url", F.col("location.line").alias("line"), F.col("location.column").alias("column"), "start", "end", v["reason"]["kind"].alias("reason"), detail.alias("detail"), v["confidence"].alias("confidence"), v["tier"].alias("tier"))
