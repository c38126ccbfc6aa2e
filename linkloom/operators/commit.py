"""Files written in two phases, with a journal between them.

``staged`` writes every new file beside its target and notes what it found and made; the
journal is settled before anything else happens. ``committed`` puts the staged files in place by renaming.
Both may be repeated, by lost executors, by speculation or after a stop, without harm: a target
that is as the journal wants it is done, one that is as it was found is replaced, any other was
changed by somebody else and is left alone. ``restored`` puts the old files back, ``cleared``
removes what is left beside the targets.

Targets must be files that all executors mount alike.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from linkloom.operators.batches import made, pieces
from linkloom.tables import Scratch

JOURNAL = "path string, target string, staged string, kept string, old string, new string, error string"
_COLUMNS = [x.split()[0] for x in JOURNAL.split(", ")]


def _digest(path: str) -> str | None:
    """SHA-256 of a file; null if there is none."""
    found = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while part := f.read(1 << 20):
                found.update(part)
    except FileNotFoundError:
        return None
    return found.hexdigest()


def _put(path: str, body: bytes, like: str | None = None) -> None:
    """A whole file at path, with the permissions of another; tasks that write the same one do not meet."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(body)
        f.flush()
        os.fsync(f.fileno())
    if like:
        os.chmod(own, os.stat(like).st_mode)
    os.replace(own, path)


def _linked(path: str, to: str) -> None:
    """A second name of a file, in place of what had it; nothing is written again."""
    own = f"{to}.{uuid.uuid4().hex}"
    os.link(path, own)
    os.replace(own, to)
    if os.path.lexists(own):  # it was a name of the same file before, by another attempt
        os.remove(own)


def copy_of(path: str) -> str:
    """stem.fixed.ext"""
    return re.sub(r"^(.*/)?([^/]+?)(\.[^./]*)?$", r"\1\2.fixed\3", path)


def staged(files: DataFrame, run: str, copy: bool = False) -> DataFrame:
    """files (path, content) to JOURNAL: each new file beside its target, which is the path, or a new file beside it if ``copy``. run: names this update."""

    def work(batches):
        for part in pieces(batches):
            rows = []
            for path, body in zip(part["path"], part["content"]):
                target = copy_of(path) if copy else path
                own, kept = f"{target}.{run}.new", f"{target}.{run}.old"
                old, new, error = _digest(target), hashlib.sha256(body).hexdigest(), None
                try:
                    if copy and old is not None:
                        error = "exists"
                    else:
                        _put(own, body, path if os.path.exists(path) else None)
                        if _digest(own) != new:
                            error = "not as written"
                except OSError as e:
                    error = str(e)
                rows.append((path, target, own, kept, old, new, error))
            yield made(rows, pa.schema([(c, pa.string()) for c in _COLUMNS]))

    return files.select("path", "content").mapInArrow(work, JOURNAL)


def _replaced(r, backup: bool) -> str | None:
    """Puts one staged file in place; gives what went wrong."""
    now = _digest(r.target)
    if now == r.new:
        return None  # by an earlier attempt, or nothing was to be changed
    if now != r.old:
        return "changed meanwhile"
    try:
        if now is not None:
            if not os.path.exists(r.kept):
                os.link(r.target, r.kept)  # the old file, until the update is cleared
                if _digest(r.kept) != r.old:  # another attempt may have replaced it
                    os.remove(r.kept)
            if backup and os.path.exists(r.kept):
                _linked(r.kept, f"{r.target}.bak")
        os.replace(r.staged, r.target)
    except FileNotFoundError:  # another attempt was faster
        pass
    except OSError as e:
        return str(e)
    return None if _digest(r.target) == r.new else "not as written"


def _each(journal: DataFrame, act) -> DataFrame:
    def work(batches):
        for pdf in batches:
            done = [(r.path, r.target, act(r)) for r in pdf.itertuples()]
            yield pd.DataFrame([(p, t if e is None else None, e) for p, t, e in done], columns=["path", "written", "error"])

    return journal.mapInPandas(work, "path string, written string, error string")


def committed(journal: DataFrame, backup: bool = False) -> DataFrame:
    """(path, written, error) of a settled journal; backup: the old file stays as ``.bak``."""
    return _each(journal, lambda r: r.error if r.error is not None else _replaced(r, backup))


def restored(journal: DataFrame) -> DataFrame:
    """(path, written, error): the targets that the journal's update replaced are as they were."""

    def back(r) -> str | None:
        if r.error is not None or _digest(r.target) != r.new or r.new == r.old:
            return None
        try:
            if r.old is None:
                os.remove(r.target)
            else:
                os.replace(r.kept, r.target)
        except FileNotFoundError:
            pass
        return None if _digest(r.target) == r.old else "not restored"

    return _each(journal, back)


def cleared(journal: DataFrame) -> DataFrame:
    """(path, written, error): nothing of the update is left beside the targets."""

    def clear(r) -> None:
        for name in (r.staged, r.kept):
            try:
                os.remove(name)
            except FileNotFoundError:
                pass

    return _each(journal, clear)


def write(files: DataFrame, own: Scratch, copy: bool = False, backup: bool = False) -> DataFrame:
    """(path, written, error) of files (path, content), written in place or as copies; tables belong to ``own``.

    A file that could not be written has its old one; the others stay written.
    """
    run = uuid.uuid4().hex[:12]
    # a file's time is that of its disk, whatever its size: files are dealt out by number, as parts by size would be few
    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    journal = own.settle(staged(files.select("path", "content").repartition(n), run, copy), "journal")
    done = own.settle(committed(journal.repartition(n), backup), "written")
    failed = done.filter("error = 'not as written'").select("path")
    if not failed.isEmpty():
        own.drop(own.settle(restored(journal.join(failed, "path")), "restored"))
    own.drop(own.settle(cleared(journal.repartition(n)), "cleared"))
    return done


def outcome(written: DataFrame, refused: DataFrame) -> DataFrame:
    """One row: n_written, n_failed, n_refused, exit_code (1 if anything was refused or failed)."""
    both = written.selectExpr("int(error is null) AS w", "int(error is not null) AS f", "0 AS r").unionByName(refused.selectExpr("0 AS w", "0 AS f", "1 AS r"))
    return both.selectExpr("coalesce(sum(w), 0) AS n_written", "coalesce(sum(f), 0) AS n_failed", "coalesce(sum(r), 0) AS n_refused").selectExpr("*", "int(n_failed + n_refused > 0) AS exit_code")
