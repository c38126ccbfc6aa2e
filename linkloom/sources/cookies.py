"""Cookies from a JSON file, and the header that they give a request."""

from __future__ import annotations

import json
import time
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "domain string, host_only boolean, cookie_path string, secure boolean, expires long, name string, value string"


def read(spark: SparkSession, file: str) -> DataFrame:
    """A file of objects (domain, host_only, path, secure, expires, name, value), or of triples (domain, name, value) that hold for the host and all paths."""
    text = "\n".join(r.value for r in spark.read.text(file, wholetext=True).collect())  # one file, a setting
    return spark.createDataFrame(parsed(text), SCHEMA)


def parsed(text: str) -> list[tuple]:
    out = []
    for x in json.loads(text):
        if isinstance(x, dict):
            out.append((x["domain"], bool(x.get("host_only", not x["domain"].startswith("."))), x.get("path", "/"), bool(x.get("secure", False)), x.get("expires"), x["name"], x["value"]))
        else:
            domain, name, value = x
            out.append((domain, not domain.startswith("."), "/", False, None, name, value))
    return out


def header(cookies: list[tuple], url: str, now: float | None = None) -> str:
    """The Cookie header of a request; empty if none fits."""
    at, now = urlsplit(url), time.time() if now is None else now
    host, path, fit = (at.hostname or "").lower(), at.path or "/", []
    for domain, host_only, own, secure, expires, name, value in cookies:
        d = domain.lstrip(".").lower()
        near = host == d or (not host_only and host.endswith("." + d))
        under = path == own or (path.startswith(own) and (own.endswith("/") or path[len(own)] == "/"))
        if near and under and (at.scheme == "https" or not secure) and (expires is None or expires > now):
            fit.append(f"{name}={value}")
    return "; ".join(fit)
