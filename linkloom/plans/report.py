"""Findings as sorted tables, JSON and SARIF.

Every form is a document whose objects, or lines, are written by tasks and joined as streams.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from linkloom.operators.verdicts import RANK, rank
from linkloom.tables import folder, remove

#: Fixed values of the report forms, by reason.
SARIF_ID = {"http-status": "SL0001", "network-error": "SL0002", "soft-404": "SL0003", "login-wall": "SL0101", "permanent-redirect": "SL0201", "staleness-banner": "SL0202", "version-drift": "SL0203", "far-past": "SL0204", "anomalous-response": "SL0301", "local-missing": "SL0401", "syntax-invalid": "SL0402"}
SARIF_NAME = {"http-status": "HTTP status", "network-error": "Network error", "soft-404": "Soft 404", "login-wall": "Login wall", "permanent-redirect": "Permanent redirect", "staleness-banner": "Staleness banner", "version-drift": "Version drift", "far-past": "Far-past last modified", "anomalous-response": "Anomalous response", "local-missing": "Missing local target", "syntax-invalid": "Invalid link syntax"}
TABLE_NAME = {"soft-404": "Soft404", "login-wall": "LoginWall", "permanent-redirect": "PermanentRedirect", "staleness-banner": "StalenessBanner", "version-drift": "VersionDrift", "far-past": "FarPastLastModified", "anomalous-response": "AnomalousResponse", "local-missing": "LocalMissing", "syntax-invalid": "SyntaxInvalid"}
NETWORK_NAME = {"dns": "Dns", "tls": "Tls", "timeout": "Timeout", "conn-refused": "ConnRefused", "other": "Other"}
JSON_KIND = {"far-past": "far-past-last-modified"}
SARIF_LEVEL = {"dead-certain": "error", "likely-dead": "warning", "outdated": "warning", "auth-walled": "note", "suspect": "note"}
SARIF_RANK = {"dead-certain": 100.0, "likely-dead": 80.0, "outdated": 60.0, "auth-walled": 40.0, "suspect": 20.0}
HEADERS = ("CONFIDENCE", "URL", "SOURCE", "REASON")
COUNTS = ("dead-certain", "likely-dead", "auth-walled", "outdated", "suspect")


def mapped(c: Column, table: dict, other: Column | None = None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out if other is None else out.otherwise(other)


def filtered(findings: DataFrame, least: str) -> DataFrame:
    return findings.filter(rank(F.col("confidence")) >= RANK[least])


def exit_code(findings: DataFrame, fail_on: str) -> DataFrame:
    """One row: 1 if any finding, before filtering, is as certain as ``fail_on``, else 0."""
    return findings.agg(F.coalesce(F.max((rank(F.col("confidence")) >= RANK[fail_on]).cast("int")), F.lit(0)).alias("exit_code"))


def counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*(F.count_if(F.col("confidence") == c).alias(c.replace("-", "_")) for c in COUNTS))


def reason_text(reason: Column, detail: Column) -> Column:
    network = F.concat(F.lit("NetworkError("), mapped(detail, NETWORK_NAME, F.lit("Other")), F.lit(")"))
    return F.when(reason == "http-status", F.concat(F.lit("HTTP "), detail)).when(reason == "network-error", network).otherwise(mapped(reason, TABLE_NAME, reason))


def rows(findings: DataFrame) -> DataFrame:
    """The table's rows in report order: most certain first, then the row itself."""
    where = F.when(F.col("line").isNotNull(), F.concat_ws(":", "path", "line", "column")).otherwise(F.col("path"))
    out = findings.select((5 - rank(F.col("confidence"))).alias("order"), F.upper("confidence").alias("confidence"), "url", where.alias("source"), reason_text(F.col("reason"), F.col("detail")).alias("reason"))
    return out.orderBy("order", "confidence", "url", "source", "reason")


@dataclass(frozen=True)
class Document:
    """A report as text: head, objects (DataFrame of ``text``, in order, to be joined by ``between``), tail; ``empty`` without objects."""

    head: str
    objects: DataFrame
    tail: str
    empty: str
    between: str = ",\n"

    def text(self) -> str:
        """The whole report, for short ones."""
        body = [r.text for r in self.objects.toLocalIterator()]
        return self.head + "\n" + self.between.join(body) + self.tail if body else self.empty

    def write(self, path: str) -> None:
        """The whole report as a file of this machine, or the old one if writing fails.

        The objects are written by the tasks that made them, in shards by order; the shards are
        joined by the file system's streams, so that no object comes to the driver's memory.
        """
        spark = self.objects.sparkSession
        jvm = spark._jvm
        shards, own = folder(spark, "report"), f"{os.path.abspath(path)}.{os.getpid()}.tmp"
        at = jvm.org.apache.hadoop.fs.Path(shards)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        try:
            self.objects.write.option("lineSep", self.between).text(shards)
            fs = at.getFileSystem(conf)
            parts = sorted((x.getPath().getName(), x.getLen()) for x in fs.listStatus(at) if x.getPath().getName().startswith("part-") and x.getLen())
            out = jvm.java.io.FileOutputStream(own)
            try:
                out.write(bytearray((self.head + "\n" if parts else self.empty).encode()))
                block = spark.sparkContext._gateway.new_array(jvm.byte, 1 << 20)
                for name, size in parts:
                    shard = fs.open(jvm.org.apache.hadoop.fs.Path(at, name))
                    # nothing stands between the last object and the tail
                    jvm.org.apache.commons.io.IOUtils.copyLarge(shard, out, 0, size - (len(self.between) if name == parts[-1][0] else 0), block)
                    shard.close()
                if parts:
                    out.write(bytearray(self.tail.encode()))
            finally:
                out.close()
            os.replace(own, path)
        finally:
            remove(spark, shards)
            if os.path.exists(own):
                os.remove(own)


    def show(self, out) -> None:
        """The whole report into a text stream, by way of a file."""
        import shutil
        import tempfile

        with tempfile.TemporaryDirectory() as at:
            self.write(f"{at}/report")
            with open(f"{at}/report", encoding="utf-8") as f:
                shutil.copyfileobj(f, out)


#: Lists of reports, and how many blanks deep their objects stand.
LISTS = {"findings": 4, "results": 8}


def objects(spark: SparkSession, path: str, name: str) -> tuple[dict, DataFrame]:
    """A written report again: the whole with its list ``name`` empty, and the list's objects (``text``), in no order.

    The file is split between objects, so that a task holds a few of them and never the report. Only
    what stands around the list comes to the driver. Files in another layout than ``Document.write``'s are refused.
    """
    pad = "\n" + " " * LISTS[name]
    first, end = f'"{name}": [{pad}{{', pad + "}"
    rows = spark.read.option("lineSep", f"{end},{pad}{{").text(path)
    is_first, value = F.startswith("value", F.lit("{")), F.col("value")
    at = F.instr(value, F.lit(first))
    body = F.when(~is_first, value).when(at > 0, F.substring(value, at + len(first), F.length(value)))
    head = F.when(is_first, F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise(value))
    split = rows.select(head.alias("head"), body.alias("body"))
    last = F.instr("body", F.lit(end))
    tail = F.when(last > 0, F.substring("body", last + len(end), F.length("body")))
    edges = split.select("head", tail.alias("tail")).filter("head is not null or tail is not null").take(3)
    heads, tails = ([r[k] for r in edges if r[k] is not None] for k in ("head", "tail"))
    try:
        if len(heads) != 1 or len(tails) > 1:
            raise ValueError("its parts are not where they should be")
        whole = json.loads(f'{heads[0]}"{name}": [{tails[0]}' if tails else heads[0])
    except ValueError as e:
        raise ValueError(f"{path} is no report with a list of {name} as this module writes it: {e}") from e
    inner = F.when(last > 0, F.substring("body", F.lit(1), last - 1)).otherwise(F.col("body"))
    return whole, split.filter("body is not null").select(F.concat(F.lit("{"), inner, F.lit(end)).alias("text"))


def width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


@F.pandas_udf(IntegerType())
def shown(texts: pd.Series) -> pd.Series:
    """Columns that a terminal gives each text."""
    return pd.Series([width(t or "") for t in texts], dtype="int32")


def table_document(findings: DataFrame) -> Document:
    """The aligned text table; nothing without findings. Only the four columns' widths come to the driver."""
    names = ("confidence", "url", "source", "reason")
    got = rows(findings)
    wide = got.select(*(F.max(shown(F.coalesce(n, F.lit("")))).alias(n) for n in names)).first()
    if wide["confidence"] is None:
        return Document("", got.select(F.lit("").alias("text")).limit(0), "", "", "\n")
    wide = [max(width(h), wide[n]) for h, n in zip(HEADERS, names)]
    head = "  ".join(h + " " * (w - width(h)) for h, w in zip(HEADERS, wide)).rstrip()
    cells = [F.concat(F.coalesce(n, F.lit("")), F.repeat(F.lit(" "), F.lit(w) - shown(F.coalesce(n, F.lit(""))))) for n, w in zip(names, wide)]
    return Document(head, got.select(F.rtrim(F.concat_ws("  ", *cells)).alias("text")), "\n", "", "\n")


def table(findings: DataFrame) -> str:
    return table_document(findings).text()


def _json(*columns: Column) -> Column:
    """An object with nulls written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def location_json(l: Column) -> Column:
    """Only the fields of the location's own kind."""
    fields = {"text": ("line", "column"), "pdf": ("page", "annotation"), "docx": ("paragraph",), "xlsx": ("sheet", "cell"), "pptx": ("slide",)}
    out = None
    for kind, names in fields.items():
        body = _json(l["type"].alias("type"), *(l[n].alias(n) for n in names))
        out = F.when(l["type"] == kind, body) if out is None else out.when(l["type"] == kind, body)
    return out


def reason_json(reason: Column) -> Column:
    """Status as a number, a network error's kind as text, no detail for the others."""
    kind = mapped(reason["kind"], JSON_KIND, reason["kind"])
    status = _json(kind.alias("kind"), reason["detail"].try_cast("int").alias("detail"))
    return F.when(reason["kind"] == "http-status", status).when(reason["kind"] == "network-error", _json(kind.alias("kind"), reason["detail"].alias("detail"))).otherwise(_json(kind.alias("kind")))


def _time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def json_rows(findings: DataFrame) -> DataFrame:
    """(path, line, column, url, json) of a scan's findings: an object each, to the schema of report version 1."""
    v, f, l = F.col("verdict"), F.col("fix"), F.col("location")
    inner = lambda whole: F.substring(whole, F.lit(2), F.length(whole) - 2)
    span = F.when(F.col("start").isNotNull(), _json(F.col("start"), F.col("end"))).otherwise("null")
    source = F.concat(F.lit("{"), inner(_json(F.col("path"), F.col("format"))), F.lit(',"location":'), location_json(l), F.lit(',"byte_span":'), span, F.lit("}"))
    verdict = F.concat(F.lit("{"), inner(_json(v["confidence"].alias("confidence"))), F.lit(',"reason":'), reason_json(v["reason"]), F.lit(","), inner(_json(v["evidence"].alias("evidence"), _time(v["checked_at"]).alias("checked_at"), v["tier"].alias("tier"))), F.lit("}"))
    able = F.when(f["fixable"]["kind"] == "refused", _json(f["fixable"]["kind"].alias("kind"), f["fixable"]["reason"].alias("reason"))).otherwise(_json(f["fixable"]["kind"].alias("kind")))
    fix = F.when(f.isNull(), "null").otherwise(F.concat(F.lit("{"), inner(_json(f["replacement_url"].alias("replacement_url"), f["origin"].alias("origin"))), F.lit(',"fixable":'), able, F.lit("}")))
    whole = F.concat(F.lit("{"), inner(_json(F.col("url"), F.col("resolved_url"))), F.lit(',"source":'), source, F.lit(',"verdict":'), verdict, F.lit(',"fix":'), fix, F.lit("}"))
    return findings.select("path", l["line"].alias("line"), l["column"].alias("column"), "url", whole.alias("json"))


def _document(whole: dict, found: DataFrame, depth: int) -> Document:
    """whole: the report with an empty list as its innermost last value; the objects stand ``depth`` blanks deep."""
    empty = json.dumps(whole, indent=2) + "\n"
    at = empty.rindex("[]")
    return Document(empty[: at + 1], found, "\n" + " " * (depth - 2) + empty[at + 1 :], empty)


def _formed(findings: DataFrame, make: Callable[[dict, str], dict], depth: int) -> DataFrame:
    """The findings' objects as text, in report order."""
    order = ["path", "line", "column", "url", "json"]
    rows = json_rows(findings).orderBy(*order).select("json", artifact_uri(F.col("path")).alias("uri"))

    def run(batches):
        blank = "\n" + " " * depth
        for batch in batches:
            texts = [" " * depth + json.dumps(make(json.loads(j), u), indent=2).replace("\n", blank) for j, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    return rows.mapInArrow(run, "text string")


def json_document(findings: DataFrame, run: dict, duration_ms: int = 0) -> Document:
    """The report of a scan's findings, version 1; run: files_scanned, links_checked, links_unique."""
    n = counts(findings.select(F.col("verdict.confidence").alias("confidence"))).first().asDict()
    head = {k: run[k] for k in ("files_scanned", "links_checked", "links_unique")} | {"findings_by_confidence": n, "duration_ms": duration_ms}
    return _document({"schema_version": 1, "run": head, "findings": []}, _formed(findings, lambda x, _: x, 4), 4)


def json_report(findings: DataFrame, run: dict, duration_ms: int = 0) -> str:
    return json_document(findings, run, duration_ms).text()


def sarif_rules(findings: DataFrame) -> DataFrame:
    """id, name of the rules that findings (reason) name, by id."""
    return findings.select(mapped(F.col("reason"), SARIF_ID).alias("id"), mapped(F.col("reason"), SARIF_NAME).alias("name")).distinct().orderBy("id")


def sarif_results(findings: DataFrame) -> DataFrame:
    c = F.col("confidence")
    message = F.concat(mapped(F.col("reason"), SARIF_NAME), F.lit(": "), "url")
    return findings.select(mapped(F.col("reason"), SARIF_ID).alias("rule_id"), mapped(c, SARIF_LEVEL).alias("level"), mapped(c, SARIF_RANK).alias("rank"), message.alias("message"), artifact_uri(F.col("path")).alias("uri"), "url", "line", "column")


def artifact_uri(path: Column) -> Column:
    """file: URI of an absolute path, else the percent-encoded relative one."""
    safe = F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.lit("file://"), safe)).otherwise(safe)


def sarif_result(x: dict, uri: str) -> dict:
    """The SARIF result of a finding's object."""
    v, source = x["verdict"], x["source"]
    back = {JSON_KIND.get(k, k): k for k in SARIF_ID}
    reason, sure = back[v["reason"]["kind"]], v["confidence"]
    text = source["format"] in ("markdown", "html", "text")
    place = {"artifactLocation": {"uri": uri}}
    if source["location"]["type"] == "text":
        place["region"] = {"startLine": source["location"]["line"], "startColumn": source["location"]["column"]}
    more = {"url": x["url"], "resolved_url": x["resolved_url"]} | {k: v[k] for k in ("reason", "confidence", "evidence", "checked_at", "tier")}
    if not text:
        more["source_location"] = source["location"]
    one = {"ruleId": SARIF_ID[reason], "level": SARIF_LEVEL[sure], "rank": SARIF_RANK[sure], "message": {"text": f"{SARIF_NAME[reason]}: {x['url']}"}, "locations": [{"physicalLocation": place}], "properties": more}
    if text and x["fix"] and source["byte_span"]:
        new, span = x["fix"]["replacement_url"], source["byte_span"]
        change = {"deletedRegion": {"byteOffset": span["start"], "byteLength": span["end"] - span["start"]}, "insertedContent": {"text": new}}
        one["fixes"] = [{"description": {"text": f"Replace with {new}"}, "artifactChanges": [{"artifactLocation": place["artifactLocation"], "replacements": [change]}]}]
    return one


def sarif_document(findings: DataFrame, code: int = 0) -> Document:
    """SARIF 2.1.0 of a scan's findings; the rules that they name (as many as there are reasons at most) stand before them."""
    rules = sarif_rules(findings.select(F.col("verdict.reason.kind").alias("reason"))).collect()
    known = [{"id": r["id"], "name": r["name"], "shortDescription": {"text": r["name"]}} for r in rules]
    run = {"tool": {"driver": {"name": "linkloom", "version": "0.2.0", "rules": known}}, "invocations": [{"executionSuccessful": True, "exitCode": code}], "results": []}
    return _document({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, _formed(findings, sarif_result, 8), 8)


def sarif(findings: DataFrame, code: int = 0) -> str:
    return sarif_document(findings, code).text()


def use_color(choice: str, terminal: bool, env: dict | None = None) -> bool:
    """always, never, or auto: on a terminal, unless NO_COLOR is set."""
    env = os.environ if env is None else env
    return choice == "always" or (choice == "auto" and terminal and "NO_COLOR" not in env)
