"""Settings: flags over environment over a TOML file over defaults; unknown keys are errors."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.tables import Scratch

FILE = "linkloom.toml"


@dataclass
class Settings:
    """One field a setting, named section_key."""

    network_max_concurrency: int = 128
    network_per_host: int = 4
    network_timeout: float = 20.0
    network_retries: int = 2
    network_user_agent: str = "linkloom"
    cache_ttl: float = 24 * 3600.0
    cache_dir: str = ""
    auth_auth: str = "cookies"
    auth_browser: str = "auto"
    ignore_local_links: bool = False
    ignore_exclude: tuple = ()
    ignore_exclude_url: tuple = ()
    ignore_exclude_domain: tuple = ()
    fix_write: bool = False
    fix_backup: bool = False
    fix_copy: bool = False
    output_fail_on: str = "suspect"


DURATIONS = ("network_timeout", "cache_ttl")
LISTS = ("ignore_exclude", "ignore_exclude_url", "ignore_exclude_domain")
UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def distance(a: str, b: str) -> int:
    """Edits between the bytes of two words."""
    a, b = a.encode(), b.encode()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggestion(key: str, known: list[str]) -> str:
    """The nearest known key, the first of equals."""
    return min(known, key=lambda k: distance(key, k))


def suggested(keys: DataFrame, known: list[str]) -> DataFrame:
    """(key, meant) of a column of unknown keys; known: a short list. Edits between characters."""
    each = F.array(*(F.struct(F.levenshtein(F.col("key"), F.lit(k)).alias("far"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(known)))
    return keys.select("key", F.array_min(each)["name"].alias("meant"))


def duration(text: str) -> float:
    """Seconds of 500ms, 30s, 5m, 2h, 1d, or several of them; a number alone is seconds."""
    found = re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]*)", text.strip())
    if not found or "".join(re.findall(r"\S", text)) != "".join(n + u for n, u in found) or any(u not in UNITS and u for _, u in found):
        raise ValueError(f"invalid duration {text!r}")
    return sum(float(n) * UNITS.get(u, 1) for n, u in found)


def said(seconds: float) -> str:
    """A duration as text, from the largest unit down."""
    left, out = round(seconds * 1000), []
    for unit, size in (("d", 86400), ("h", 3600), ("m", 60), ("s", 1)):
        n, left = divmod(left, size * 1000)
        if n:
            out.append(f"{n}{unit}")
    return " ".join([*out, *([f"{left}ms"] if left else [])]) or "0s"


def words(text: str) -> list[str]:
    """A comma-separated list, blanks and empty parts left out."""
    return [x.strip() for x in text.split(",") if x.strip()]


def _value(name: str, kind: type, value):
    if name in DURATIONS:
        return value if isinstance(value, (int, float)) else duration(value)
    if name in LISTS:
        return tuple(words(value) if isinstance(value, str) else value)
    if kind is bool:
        if isinstance(value, str):
            if value.lower() not in ("true", "false", "1", "0"):
                raise ValueError(f"invalid {name}: {value!r}")
            return value.lower() in ("true", "1")
        return bool(value)
    return kind(value)


def read(start: str) -> dict:
    """The settings of the nearest file above a path; unknown sections and keys are errors with the nearest known one."""
    kinds = {f.name for f in fields(Settings)}
    sections = sorted({k.split("_")[0] for k in kinds})
    at = Path(start).resolve()
    for folder in [at if at.is_dir() else at.parent, *at.parents]:
        if not (folder / FILE).is_file():
            continue
        out = {}
        for section, content in tomllib.loads((folder / FILE).read_text()).items():
            if section not in sections or not isinstance(content, dict):
                raise ValueError(f"unknown section {section!r}; did you mean {suggestion(section, sections)!r}?")
            known = sorted(k[len(section) + 1 :].replace("_", "-") for k in kinds if k.startswith(section + "_"))
            for key, value in content.items():
                if key not in known:
                    raise ValueError(f"unknown key {section}.{key}; did you mean {section}.{suggestion(key, known)}?")
                out[f"{section}_{key.replace('-', '_')}"] = value
        return out
    return {}


def load(flags: dict, start: str = ".", prefix: str = "LINKLOOM_", env: dict | None = None) -> Settings:
    """Lists to exclude are joined: those of flags come with those of environment or file."""
    env = os.environ if env is None else env
    found = read(start)
    out = {}
    for f in fields(Settings):
        given = env.get(prefix + f.name.upper(), found.get(f.name))
        flag = flags.get(f.name)
        if f.name in LISTS:
            out[f.name] = (*(_value(f.name, tuple, flag) if flag else ()), *(_value(f.name, tuple, given) if given else ()))
        elif flag is not None or given is not None:
            out[f.name] = _value(f.name, type(f.default), flag if flag is not None else given)
    return Settings(**out)


_KINDS = {int: ("int", pa.int32()), float: ("double", pa.float64()), str: ("string", pa.string()), bool: ("boolean", pa.bool_()), tuple: ("array<string>", pa.list_(pa.string()))}


def loaded(rows: DataFrame, own: Scratch, flags: str = "flags", start: str = "start", env: str = "env", prefix: str = "LINKLOOM_") -> DataFrame:
    """rows with ``settings``: what ``load`` gives for a row's flags and environment (JSON objects as text; null: none) and path.

    Rows that ask for the same are loaded once, and joined; the table of what was loaded belongs to ``own``.
    """
    given, of = [flags, start, env], [(f.name, _KINDS[type(f.default)]) for f in fields(Settings)]
    kind = pa.struct([(name, arrow) for name, (_, arrow) in of])

    def run(batches):
        for batch in batches:
            keys = [c.to_pylist() for c in batch.columns]
            out = [vars(load(json.loads(f or "{}"), at, prefix, json.loads(e or "{}"))) for f, at, e in zip(*keys)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=["_f", "_s", "_e", "settings"])

    said = ", ".join(f"{name}: {sql}" for name, (sql, _) in of)
    once = own.settle(rows.select(*given).distinct().mapInArrow(run, f"_f string, _s string, _e string, settings struct<{said}>"), "settings")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(given, ("_f", "_s", "_e"))]
    return rows.join(once, same).drop("_f", "_s", "_e")
