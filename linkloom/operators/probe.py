"""Observing URLs over HTTP: one row an attempt, kept apart from judging.

Persist what it gives, and judge that. A repeated task repeats its requests, so keep speculation
off for this stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import urls as ux
from linkloom.operators.schedule import Drain
from linkloom.sources.cookies import header

OBSERVATION = "url string, method string, attempt int, hops array<struct<status:int,url:string>>, status int, final_url string, termination string, error_kind string, error_message string, last_modified string, retry_after string, body string"
BODY_LIMIT, HOPS = 262_144, 10
#: Longest wait before another attempt, in seconds.
LONGEST = 30.0
#: URLs that a task reads ahead.
AHEAD = 1 << 16


def _error(e: Exception) -> tuple[str, str]:
    import socket
    import ssl
    from urllib.error import URLError

    why = e.reason if isinstance(e, URLError) and isinstance(e.reason, Exception) else e
    kind = "timeout" if isinstance(why, (TimeoutError, socket.timeout)) else "conn-refused" if isinstance(why, ConnectionRefusedError) else "tls" if isinstance(why, ssl.SSLError) else "dns" if isinstance(why, socket.gaierror) else "other"
    return kind, str(why)


def observe(url: str, method: str, timeout: float, agent: str, cookies: list[tuple] | None = None) -> dict:
    """One request, its redirects followed by hand; cookies: sent where they fit, at every hop."""
    from urllib.error import HTTPError
    from urllib.parse import urljoin
    from urllib.request import HTTPRedirectHandler, Request, build_opener

    class Stay(HTTPRedirectHandler):
        def redirect_request(self, *_):
            return None

    opener, hops, at, seen = build_opener(Stay), [], url, {url}
    out = dict.fromkeys(("status", "termination", "error_kind", "error_message", "last_modified", "retry_after", "body"))
    while True:
        try:
            sent = {"User-Agent": agent}
            if cookies and (fit := header(cookies, at)):
                sent["Cookie"] = fit
            answer = opener.open(Request(at, method=method, headers=sent), timeout=timeout)
        except HTTPError as e:
            answer = e
        except Exception as e:
            out["error_kind"], out["error_message"] = _error(e)
            break
        status, target = answer.getcode(), answer.headers.get("Location")
        if 300 <= status < 400 and target:
            hops.append({"status": status, "url": urljoin(at, target)})
            at = hops[-1]["url"]
            if at in seen:
                out["termination"] = "redirect loop detected"
                break
            if len(hops) > HOPS:
                out["termination"] = "redirect limit exhausted"
                break
            seen.add(at)
            continue
        out |= {"status": status, "last_modified": answer.headers.get("Last-Modified"), "retry_after": answer.headers.get("Retry-After"), "body": answer.read(BODY_LIMIT).decode("utf-8", "replace") if method == "GET" else None}
        break
    return out | {"url": url, "method": method, "hops": hops, "final_url": at}


def asked_wait(value: str | None, now: float) -> float | None:
    """Seconds that a Retry-After header asks for: a number, or a date yet to come."""
    from email.utils import parsedate_to_datetime

    if value is None:
        return None
    if value.isascii() and value.isdigit():
        return float(value)
    try:
        left = parsedate_to_datetime(value).timestamp() - now
    except ValueError:
        return None
    return left if left >= 0 else None


def again_after(seen: dict, attempt: int, base_s: float, now: float) -> float | None:
    """Seconds to wait before another attempt; null: this one stands."""
    status = seen["status"]
    if seen["error_kind"] not in ("timeout", "conn-refused") and not (status is not None and (status >= 500 or status in (408, 429))):
        return None
    wait = base_s * 2**attempt
    if status == 429:
        wait = max(wait, asked_wait(seen["retry_after"], now) or 0.0)
    return min(LONGEST, wait)


def probe(requests: DataFrame, per_host: int = 4, limit: int = 128, timeout: float = 20.0, retries: int = 2, agent: str = "linkloom", base_s: float = 1.0, cookies: DataFrame | None = None) -> DataFrame:
    """requests (url, method: HEAD, GET, or COOKIE for a GET with cookies) to observations, a row an attempt.

    All requests of a host meet in one task, ``per_host`` at a time; over the run, ``limit`` at a
    time. A task reads its hosts' requests in turn, so that a slow host, or one that waits for its
    next attempt, holds up its own only. cookies: a user's own (sources.cookies), a setting that goes to every task.
    """
    spark = requests.sparkSession
    held = [tuple(r) for r in cookies.collect()] if cookies is not None else None
    names = [x.split()[0] for x in OBSERVATION.split(", ")]
    most = max(1, min(limit, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    threads = max(1, limit // max(1, min(most, spark.sparkContext.defaultParallelism)))

    def work(batches: Iterator[pd.DataFrame]):
        import time

        tries: dict[tuple, int] = {}

        def make(item: tuple) -> tuple[dict, float | None]:
            url, method = item
            attempt = tries.get(item, 0)
            tried = method == "COOKIE"
            seen = observe(url, "GET" if tried else method, timeout, agent, held if tried else None) | {"attempt": attempt, "method": method}
            again = again_after(seen, attempt, base_s, time.time()) if attempt < retries and not tried else None
            if again is None:
                tries.pop(item, None)
            else:
                tries[item] = attempt + 1
            return seen, again

        with Drain(make, per_host, threads) as drain:
            for pdf in batches:
                for host, url, method in zip(pdf["_host"], pdf["url"], pdf["method"]):
                    drain.add(host, (url, method))
                    while drain.open >= AHEAD:
                        yield pd.DataFrame(drain.rows(AHEAD), columns=names)
            while drain.open or drain.found:
                yield pd.DataFrame(drain.rows(1), columns=names)

    turn = F.row_number().over(Window.partitionBy("_host").orderBy("url", "method"))
    dealt = requests.select("url", "method", F.coalesce(ux.host_key(F.col("url")), F.lit("")).alias("_host")).distinct().repartition(most, "_host")
    return dealt.withColumn("_turn", turn).sortWithinPartitions("_turn", "_host").mapInPandas(work, OBSERVATION)
