"""A file tree as a Spark data source: folders are listed by the tasks that they are dealt to.

The upper folders are opened until there are enough to deal out, each below them is walked by
one task; the folders whose ignore files hold go down with it, and each task reads their rules. Only
folders' names of the upper levels are ever kept in one place, and the paths of files nowhere but in rows. The files of an
upper folder are listed by a task for every ``SHARE`` of them, those of a folder below by the task that walks it.

Options: ``tops`` and ``files`` (JSON lists of folders and of files that bypass all rules), ``include`` and
``exclude`` (JSON lists of globs), ``ignore`` (JSON boolean), ``parts`` (JSON number: folders to deal out at least).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linkloom.sources.files import IGNORE, glob_regex

Base = tuple[str, tuple[str, ...]]  # a folder, and the names of its ignore files that count

#: Files of one folder that a task lists, about.
SHARE = 100_000


class Rules:
    """What a folder's ignore files state. Rules without wildcards are found by a file's name or path, others are tried in turn."""

    def __init__(self, base: str, names: tuple[str, ...] = IGNORE):
        self.base = base
        self.plain: dict[tuple[bool, str], list[tuple[int, bool] | None]] = {}  # (by path, text): the last rule, the last one that is not of folders only
        self.globs: list[tuple[int, re.Pattern, bool, bool]] = []  # place, expression, negated, folders only
        place = 0
        for name in names:
            file = os.path.join(base, name)
            if not os.path.isfile(file):
                continue
            with open(file, encoding="utf-8", errors="replace") as f:
                for line in map(str.rstrip, f):
                    if not line or line.startswith("#"):
                        continue
                    place += 1
                    negated, line = line.startswith("!"), line.lstrip("!")
                    only, line = line.endswith("/"), line.rstrip("/")
                    by_path, line = "/" in line, line.lstrip("/")
                    if not any(c in line for c in "*?["):
                        last = self.plain.setdefault((by_path, line), [None, None])
                        last[0] = (place, negated)
                        if not only:
                            last[1] = (place, negated)
                        continue
                    expression = glob_regex(line)
                    if by_path and expression.startswith("(?:^|/)"):
                        expression = "^" + expression[7:]
                    self.globs.append((place, re.compile(expression), negated, only))

    def __bool__(self) -> bool:
        return bool(self.plain or self.globs)

    def said(self, path: str, is_folder: bool) -> bool | None:
        """Whether the last rule that fits leaves a path out; None if none fits."""
        inside = path[len(self.base) :].lstrip("/") if path.startswith(self.base) else ""
        if not inside:
            return None
        best, out = 0, None
        for k in ((True, inside), (False, inside.rpartition("/")[2])):
            if (last := self.plain.get(k)) and (hit := last[0 if is_folder else 1]) and hit[0] > best:
                best, out = hit[0], not hit[1]
        for place, expression, negated, only in reversed(self.globs):
            if place < best:
                break
            if (is_folder or not only) and expression.search(inside):
                return not negated
        return out


def inherited(folder: str) -> list[Base]:
    """Whose rules hold of the folders above: all their .ignore files, and .gitignore files up to the one that holds .git."""
    above, at = [], os.path.abspath(folder)
    inside = not os.path.exists(os.path.join(at, ".git"))
    while (up := os.path.dirname(at)) != at:
        above.append((up, inside))
        inside = inside and not os.path.exists(os.path.join(up, ".git"))
        at = up
    held = not inside  # a .gitignore counts only within a repository
    return [(up, IGNORE if within and held else IGNORE[1:]) for up, within in reversed(above)]


@dataclass
class Part(InputPartition):
    """Folders (name, whose rules hold in it, whether what is below belongs to it, which of how many shares of its files), or files named one by one."""

    folders: list[tuple[str, list[Base], bool, int, int]]
    files: list[str]

    def __init__(self, folders, files):
        self.folders, self.files, self.value = folders, files, None


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        said = lambda k, other: json.loads(options.get(k, json.dumps(other)))
        self.tops, self.files, self.ignore, self.parts = said("tops", []), said("files", []), said("ignore", True), said("parts", 1)
        self.include, self.exclude = ([glob_regex(g) for g in said(k, [])] for k in ("include", "exclude"))

    def _opened(self, folder: str, bases: list[Base], known: dict[Base, Rules]) -> tuple[list[Base], list[str], Callable[[str, bool], bool], Iterator[os.DirEntry]]:
        """Whose rules hold in a folder, the folders below that are not left out, what is left out, and the folder's files, none judged yet.

        The folders below are known when the files have been read. known: rules that were read before.
        """
        rules = []
        if self.ignore:
            bases = bases + [(folder, IGNORE)]
            for b in bases:
                if b not in known:
                    known[b] = Rules(*b)
            bases = [b for b in bases if known[b]]
            rules = [known[b] for b in reversed(bases)]

        def out(path: str, is_folder: bool) -> bool:
            """The rules of the nearest folder that say something decide."""
            return next((x for r in rules if (x := r.said(path, is_folder)) is not None), False)

        below: list[str] = []

        def files() -> Iterator[os.DirEntry]:
            with os.scandir(folder) as entries:
                for e in entries:
                    if not e.is_dir(follow_symlinks=False):
                        yield e
                    elif e.name != ".git" and not out(e.path, True):
                        below.append(e.path)

        return bases, below, out, files()

    def partitions(self) -> list[Part]:
        level = [(top.rstrip("/") or "/", inherited(top) if self.ignore else []) for top in dict.fromkeys(self.tops)]
        done: list[tuple[str, list[Base], bool, int, int]] = []
        known: dict[Base, Rules] = {}
        while level and len(level) < self.parts:
            after = []
            for folder, bases in level:
                own, below, _, files = self._opened(folder, bases, known)
                shares = 1 + sum(1 for _ in files) // SHARE
                done += [(folder, bases, False, i, shares) for i in range(shares)]
                after += [(b, own) for b in below]
            level = after
        every = done + [(folder, bases, True, 0, 1) for folder, bases in level]
        n = max(1, min(len(every), self.parts))
        return [Part(every[i::n], []) for i in range(n) if every[i::n]] + ([Part([], self.files)] if self.files else [])

    def read(self, part: Part) -> Iterator[tuple]:
        want, no = ([re.compile(g) for g in x] for x in (self.include, self.exclude))
        for path in part.files:
            yield path, os.path.getsize(path)
        stack, known = list(part.folders), {}
        while stack:
            folder, bases, deep, i, shares = stack.pop()
            bases, below, out, own = self._opened(folder, bases, known)
            for e in own:
                if (shares == 1 or crc32(os.fsencode(e.name)) % shares == i) and e.is_file() and not out(e.path, False):
                    if (not want or any(g.search(e.path) for g in want)) and not any(g.search(e.path) for g in no):
                        yield e.path, e.stat().st_size
            if deep:
                stack += [(b, bases, True, 0, 1) for b in below]


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linkloom_tree"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def listed(spark: SparkSession, paths: list[str], include: list[str] = (), exclude: list[str] = (), ignore: bool = True, parts: int | None = None) -> DataFrame:
    """(path, length) of the files under folders, each path once, sorted by path components; contents are not read.

    Hidden files are included; ignore files (``files.IGNORE``) leave out what they name. Files named
    one by one bypass globs and ignore files. The folders must be mounted alike on all machines.
    """
    spark.dataSource.register(Tree)
    named = list(dict.fromkeys(p for p in paths if os.path.isfile(p)))
    said = {"tops": [p for p in paths if p not in set(named)], "files": named, "include": list(include), "exclude": list(exclude), "ignore": ignore, "parts": parts or 4 * spark.sparkContext.defaultParallelism}
    rows = spark.read.format("linkloom_tree").options(**{k: json.dumps(v) for k, v in said.items()}).load()
    return rows.dropDuplicates(["path"]).orderBy(F.split("path", "/"))
