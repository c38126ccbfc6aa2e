"""Verdicts of URLs from recorded observations: what the status says, heuristics on clean pages, tiers of access.

Bodies are read where observations are noted, and only what rules ask of them goes on: hashes of
their words, the phrase that says a page is out of date, the signs of a wall. No body is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as tx
from linkloom.functions import urls as ux
from linkloom.operators import verdicts as vx
from linkloom.tables import Scratch

CAPS = {"off": 1, "cookies": 2, "browser": 3}
#: Columns of an observation that verdicts read; those a table lacks are null.
READ = {"hops": "array<struct<status:int,url:string>>", "status": "int", "final_url": "string", "termination": "string", "error_kind": "string", "error_message": "string", "last_modified": "string"}
#: What is noted of a body.
NOTED = {"words": "array<bigint>", "stale": "string", "walled": "boolean"}
METHODS = {"HEAD": "head", "GET": "get", "COOKIE": "second", "PAGE": "page"}


def noted(observations: DataFrame) -> DataFrame:
    """(url, method, attempt, o) of observations, with notes in place of bodies; noted ones stay as they are."""
    have = set(observations.columns)
    if "o" in have:
        return observations.select("url", "method", "attempt", "o")
    fields = [(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in READ.items()]
    body = F.col("body") if "body" in have else F.lit(None).cast("string")
    notes = (tx.word_hashes(body), tx.staleness(body), vx.page_signs(body))
    fields += [n.cast(k).alias(c) for n, (c, k) in zip(notes, NOTED.items())]
    method = F.col("method") if "method" in have else F.lit("HEAD")
    attempt = F.col("attempt").cast("int") if "attempt" in have else F.lit(0)
    return observations.select("url", method.alias("method"), attempt.alias("attempt"), F.struct(*fields).alias("o"))


def pivoted(observations: DataFrame) -> DataFrame:
    """A row a URL: head, get, second (with cookies) and page (as a browser shows it), each of the last attempt; null if there was none."""
    last = [F.max_by(F.when(F.col("method") == m, F.col("o")), F.when(F.col("method") == m, F.col("attempt"))).alias(name) for m, name in METHODS.items()]
    return noted(observations).groupBy("url").agg(*last)


def known(urls: DataFrame, found: DataFrame) -> DataFrame:
    """urls (url) with what was found (pivoted) of them, of their raised version (up, up_get) and of a sibling that should not exist (beside, beside_get)."""
    rows = urls.select("url").distinct().withColumns({"up": ux.version_upgrade(F.col("url")), "beside": ux.sibling(F.col("url"))}).join(found, "url", "left")
    gets = found.filter("get is not null")
    for near in ("up", "beside"):
        rows = rows.join(gets.select(F.col("url").alias(near), F.col("get").alias(f"{near}_get")), near, "left")
    return rows


def refused(head: Column) -> Column:
    """Whether a HEAD's status asks for a GET in its place."""
    return F.coalesce(head["status"].isin(*vx.FALLBACK) & head["error_kind"].isNull() & head["termination"].isNull(), F.lit(False))


def answered(o: Column) -> Column:
    return F.coalesce(o["status"].between(200, 299) & o["error_kind"].isNull() & o["termination"].isNull(), F.lit(False))


def _clean(now: Column) -> Column:
    return vx.heuristic(F.col("url"), F.col("get"), F.col("up_get"), F.col("beside_get"), now)


def first_clean(now: Column) -> Column:
    """Whether no rule says anything of the GET so far."""
    return _clean(now).isNull()


def first(rows: DataFrame, now: Column) -> DataFrame:
    """rows (known) with checked (an observation is there) and verdict, without cookies."""
    head, get = F.col("head"), F.col("get")
    said = F.when(refused(head) & get.isNotNull(), F.coalesce(vx.observed(get), _clean(now))).otherwise(F.coalesce(vx.observed(head), _clean(now)))
    return rows.select("url", "second", "page", (head.isNotNull() | get.isNotNull()).alias("checked"), said.alias("verdict"))


def judged(urls: DataFrame, observations: DataFrame, now: Column | None = None, auth: str = "cookies", own: Scratch | None = None) -> DataFrame:
    """urls (url) with checked (an observation is there) and verdict (null: clean).

    observations: url, method (HEAD, GET; COOKIE: a GET with cookies; PAGE: as a browser shows
    it), attempt, body and the columns of READ, or noted ones. The HEAD decides, a GET where the HEAD is
    refused, then the heuristics on the GET; refused URLs go on to the tiers that ``auth`` allows.
    Observations are gathered once, into a table of ``own`` (without it, one that stays for the result).
    """
    now = F.current_timestamp() if now is None else now
    tables = own or Scratch(urls.sparkSession)
    found = tables.settle(pivoted(observations), "found")
    if own is None:
        tables.keep(found)
    rows = first(known(urls, found), now)
    cap = CAPS[auth]
    host = ux.host(F.col("url"))
    if cap >= 2:
        tried = vx.escalates(F.col("verdict"), 1, host) & F.col("second").isNotNull() & F.col("second.error_kind").isNull()
        rows = rows.withColumn("tried", tried).withColumn("verdict", F.when(F.col("tried"), vx.by_cookies(F.col("second"))).otherwise(F.col("verdict")))
    if cap >= 3:
        rows = rows.withColumn("asks", F.col("tried") & vx.escalates(F.col("verdict"), 2, host))
        slots = vx.budgeted(rows.filter("asks")).withColumn("asked", F.lit(True))
        rows = rows.join(slots, "url", "left")
        seen = F.col("page").isNotNull() & F.col("page.error_kind").isNull()
        third = F.when(F.col("slot").isNull(), vx.exhausted()).when(seen, vx.by_page(F.col("page"))).otherwise(F.col("verdict"))
        rows = rows.withColumn("verdict", F.when(F.col("asked"), third).otherwise(F.col("verdict")))
    return rows.select("url", "checked", "verdict")
