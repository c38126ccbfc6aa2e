"""Documents as rows: file trees, explicit paths, and adapters of tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkloom.operators.batches import BYTES, ROWS, made

#: Extension to format.
EXTENSIONS = {"md": "markdown", "markdown": "markdown", "htm": "html", "html": "html", "txt": "text", "text": "text", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx"}
PROBE, UNKNOWN_LIMIT = 8 << 10, 2 << 20


def glob_regex(pattern: str) -> str:
    """A path glob (``*`` within a name, ``**`` over folders, ``?``, ``[..]``) as a regular expression of the path's end."""
    import re

    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i:]:
            j = pattern.index("]", i)
            out, i = out + "[" + pattern[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return ("^" if "/" in pattern.rstrip("/") and pattern.startswith("/") else "(?:^|/)") + out.lstrip("/") + "$"


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    keep = F.lit(not include)
    for g in include:
        keep = keep | path.rlike(glob_regex(g))
    for g in exclude:
        keep = keep & ~path.rlike(glob_regex(g))
    return keep


#: Files that name what a walk leaves out, a pattern a line.
IGNORE = (".gitignore", ".ignore")


def contents(spark: SparkSession, walked: DataFrame) -> DataFrame:
    """(path, length, content) of listed files, read where they are needed: by a folder that all executors share."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    def read(batches):
        rows, size = [], 0
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(path, "rb") as f:
                    head = f.read(PROBE)
                    known = path.rpartition(".")[2].lower() in EXTENSIONS if "." in path.rpartition("/")[2] else False
                    if known or length <= UNKNOWN_LIMIT or head.startswith((b"%PDF-", b"PK\x03\x04")):
                        rows.append((path, length, head + f.read()))
                        size += len(rows[-1][2])
                if len(rows) >= ROWS or size >= BYTES:
                    yield made(rows, schema)
                    rows, size = [], 0
        if rows:
            yield made(rows, schema)

    return walked.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(read, "path string, length long, content binary")


def walk(spark: SparkSession, folders: list[str], files: list[str] = (), include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(path, length, content), each path once, of any file system that Spark reads. Files named one by one bypass the globs.

    Paths and lengths alone are made distinct; contents are read after, and are not shuffled.
    """
    parts = []
    for source, chosen in ((folders, True), (files, False)):
        if source:
            rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(source))
            name = F.regexp_replace("path", "^file:/*", "/")
            rows = rows.filter(selected(name, list(include), list(exclude))) if chosen else rows
            parts.append(rows.select(name.alias("path"), "length", "content"))
    if not parts:
        return spark.createDataFrame([], "path string, length long, content binary")
    if len(parts) == 1:
        return parts[0]
    return parts[0].join(parts[1].select("path").distinct(), "path", "left_anti").unionByName(parts[1])


def extension_format(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return _cases(ext)


def _cases(ext: Column) -> Column:
    out = None
    for name, kind in EXTENSIONS.items():
        out = F.when(ext == name, kind) if out is None else out.when(ext == name, kind)
    return out


@F.pandas_udf(StringType())
def zip_format(content: pd.Series) -> pd.Series:
    """docx, xlsx or pptx by a ZIP's member folders."""
    out = []
    for body in content:
        try:
            names = zipfile.ZipFile(io.BytesIO(body)).namelist()
        except (zipfile.BadZipFile, TypeError):
            out.append(None)
            continue
        out.append(next((k for p, k in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")) if any(n.startswith(p) for n in names)), None))
    return pd.Series(out, dtype=object)


def text_like(content: Column) -> Column:
    """Valid UTF-8, and at most 1 % control bytes (but line feeds, returns and tabs) in the first 8 KiB."""
    head = F.hex(F.substring(content, 1, PROBE))
    controls = F.regexp_count(F.regexp_replace(head, "(..)", "$1 "), F.lit("(?:0[0-8BCEF]|1[0-9A-F]|7F) "))
    return F.is_valid_utf8(content.cast("string")) & (controls * 100 <= F.least(F.length(content), F.lit(PROBE)))


def detected(files: DataFrame) -> DataFrame:
    """files (path, length, content) with format; unknown files over 2 MiB and other binaries are left out."""
    magic = F.substring("content", 1, 5)
    is_pdf = magic == F.lit(b"%PDF-")
    is_zip = F.substring("content", 1, 4) == F.lit(b"PK\x03\x04")
    known = extension_format(F.col("path"))
    gate = known.isNotNull() | is_pdf | is_zip | (F.col("length") <= UNKNOWN_LIMIT)
    inside = zip_format(F.when(is_zip & ~is_pdf, F.col("content")))  # one pass: nothing is sent for other files
    kind = F.when(is_pdf, "pdf").otherwise(F.coalesce(F.col("_zip"), known, F.when(~is_zip & text_like(F.col("content")), "text")))
    return files.filter(gate).withColumn("_zip", inside).withColumn("format", kind).drop("_zip").filter("format is not null")


def pages_as_documents(pages: DataFrame) -> DataFrame:
    """A table of page HTML as documents (path, format, content)."""
    return pages.select(F.col("url").alias("path"), F.lit("html").alias("format"), F.encode("html", "utf-8").alias("content"))
