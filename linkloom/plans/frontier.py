"""Which requests to make, in waves: each asks only what the ones before it left open.

HEAD of the links that are neither excluded, nor known from the cache, nor observed before; GET of
those that were clean or refused; the raised version of those that no earlier rule settled;
the sibling that should not exist of those that are still open; at last refused ones with cookies.
The requests of a wave are settled before they are made, and so is what they show: a lost
executor repeats requests of its wave only.

Defined results: a URL is asked once by a method, however many links and waves name it; a raised
version or sibling that is excluded is not asked, and its rule says nothing; a raised version
whose verdict is in the cache is not asked either, the verdict tells whether it is there; no
links give no requests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls as ux
from linkloom.operators import cache as cx
from linkloom.operators import verdicts as vx
from linkloom.plans import judge
from linkloom.tables import Scratch

WAVES = ("head", "get", "version", "sibling", "cookie")
#: Reasons of cached verdicts whose page answered with success.
ANSWERED = ("login-wall", "permanent-redirect", "far-past", "staleness-banner", "version-drift", "soft-404")


@dataclass(frozen=True)
class Limits:
    """What is never asked: URLs by pattern or domain, and those whose verdict is in the cache."""

    exclude_urls: tuple = ()
    exclude_domains: tuple = ()
    cache: DataFrame | None = None
    ttl: int = 24 * 3600
    refresh: bool = False

    def allowed(self, url: Column) -> Column:
        return ~ux.excluded_by_pattern(url, list(self.exclude_urls)) & ~ux.excluded_by_domain(url, list(self.exclude_domains))

    def looked(self, urls: DataFrame, now: Column, cap: int) -> DataFrame:
        """urls with hit and verdict_json, by their normalised form."""
        if self.cache is None or self.refresh:
            return urls.withColumns({"hit": F.lit(False), "verdict_json": F.lit(None).cast("string")})
        return cx.lookup(urls.withColumn("_key", ux.normalised(F.col("url"))), self.cache, F.unix_timestamp(now), self.ttl, cap, "_key").drop("_key", "checked_at", "tier")


def told(rows: DataFrame, method: str) -> DataFrame:
    """Observations that verdicts of the cache stand for: a status, as far as the verdict tells one."""
    v = F.from_json("verdict_json", vx.VERDICT)
    kind = v["reason"]["kind"]
    status = F.when(F.col("verdict_json").isNull() | kind.isin(*ANSWERED), 200).when(kind == "http-status", v["reason"]["detail"].try_cast("int"))
    return rows.select("url", F.lit(method).alias("method"), F.lit(0).alias("attempt"), status.cast("int").alias("status"), F.when(status.isNull(), "other").alias("error_kind"))


def planned(wave: str, urls: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """(url, method) that a wave asks for on behalf of urls (url), by what was found (judge.pivoted)."""
    rows = judge.known(urls, found)
    head, get = F.col("head"), F.col("get")
    if wave == "head":
        return rows.filter(head.isNull()).select("url", F.lit("HEAD").alias("method"))
    if wave == "get":
        return rows.filter(head.isNotNull() & get.isNull() & (vx.observed(head).isNull() | judge.refused(head))).select("url", F.lit("GET").alias("method"))
    if wave == "cookie":
        said = judge.first(rows, now)
        return said.filter(vx.escalates(F.col("verdict"), 1, ux.host(F.col("url"))) & F.col("second").isNull()).select("url", F.lit("COOKIE").alias("method"))
    open_ = rows.filter(judge.answered(get) & judge.first_clean(now))
    near = "up" if wave == "version" else "beside"
    return open_.filter(F.col(near).isNotNull() & F.col(f"{near}_get").isNull()).select(F.col(near).alias("url"), F.lit("GET").alias("method")).distinct()


def observed(urls: DataFrame, ask: Callable[[DataFrame], DataFrame], own: Scratch, limits: Limits = Limits(), seen: DataFrame | None = None, now: Column | None = None, auth: str = "cookies", cookies: bool = False) -> tuple[DataFrame, DataFrame]:
    """(observations, requests): of urls (url), what is known after all waves, and (wave, url, method) of what was asked.

    ``ask`` makes the requests of a wave (wave, url, method) and gives observations. seen: those of
    earlier runs. The tables belong to ``own``.
    """
    now = F.current_timestamp() if now is None else now
    cap = judge.CAPS[auth]
    links = urls.select("url").distinct().filter(limits.allowed(F.col("url")))
    links = own.settle(limits.looked(links, now, cap).filter("NOT hit").select("url"), "links")
    every = judge.noted(seen) if seen is not None else None
    asked = None
    for wave in WAVES if cookies and cap >= judge.CAPS["cookies"] else WAVES[:-1]:
        found = judge.pivoted(every) if every is not None else judge.pivoted(judge.noted(links.select("url").limit(0)))
        found = own.settle(found, "found")
        wanted = planned(wave, links, found, now)
        if wave in ("version", "sibling"):
            wanted = own.settle(limits.looked(wanted.filter(limits.allowed(F.col("url"))), now, cap), "wanted")
            known = judge.noted(told(wanted.filter("hit"), "GET"))
            every = known if every is None else every.unionByName(known)
            wanted = wanted.filter("NOT hit").select("url", "method")
        wanted = own.settle(wanted.select(F.lit(wave).alias("wave"), "url", "method"), "requests")
        own.drop(found)
        made = own.settle(judge.noted(ask(wanted)), "observations")
        every = made if every is None else every.unionByName(made)
        asked = wanted if asked is None else asked.unionByName(wanted)
    return every, asked
