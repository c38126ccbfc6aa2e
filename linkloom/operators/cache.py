"""Verdict cache: a table by normalised URL, with time to live and tier rules.

On disk a cache is a folder of buckets by hash of the URL, and of manifests that say where each
bucket is. An update reads and writes the buckets it touches only, into a folder of its own, and
becomes the cache when its manifest is put in place, as the last step: stopped before, it leaves the old cache as it
was; readers keep the files of the manifest they read for one more update.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "url string, verdict_json string, checked_at long, tier int"


def reusable(tier: Column, confidence: Column, cap: int) -> Column:
    """A verdict of that tier serves a scan up to ``cap``, unless it found a wall that the scan could climb."""
    return (tier <= cap) & ((F.coalesce(confidence, F.lit("")) != "auth-walled") | (tier >= cap))


def lookup(urls: DataFrame, cache: DataFrame, now: int | Column, ttl: int, cap: int, key: str = "url") -> DataFrame:
    """urls with hit, verdict_json; a malformed verdict is a miss, a null one a clean verdict."""
    c = cache.select(F.col("url").alias(key), F.col("verdict_json"), "checked_at", "tier")
    parsed = F.get_json_object("verdict_json", "$.confidence")
    fresh = ((now if isinstance(now, Column) else F.lit(now)) - F.col("checked_at")) <= ttl
    clean = F.col("verdict_json").isNull() & (F.col("tier") <= cap)
    hit = F.col("checked_at").isNotNull() & fresh & (clean | (parsed.isNotNull() & reusable(F.col("tier"), parsed, cap)))
    return urls.join(c, key, "left").withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("verdict_json", F.when(F.col("hit"), F.col("verdict_json")))


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row of each URL; new rows win ties."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("url").orderBy(F.desc("checked_at"), F.desc("_new"), F.desc("tier"))
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")


def stats(looked: DataFrame, cache: DataFrame) -> DataFrame:
    """hits, misses, entries."""
    both = looked.select("hit", F.lit(0).alias("entry")).unionByName(cache.select(F.lit(None).cast("boolean").alias("hit"), F.lit(1).alias("entry")))
    return both.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.sum("entry").alias("entries"))


#: Of the columns above and the layout. A cache of another version is read as empty.
VERSION = 2
BUCKETS = 256


class Conflict(OSError):
    """Another update was put in place meanwhile."""


def wellformed(cache: DataFrame) -> DataFrame:
    """Without rows whose verdict is not one; they were misses and are not kept."""
    return cache.filter(F.col("verdict_json").isNull() | F.get_json_object("verdict_json", "$.confidence").isNotNull())


def bucket(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


class _Files:
    """The folder of a cache, through the file system that holds it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, f"{path.rstrip('/')}/v{VERSION}"
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.at(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self.names("manifests") if (m := re.fullmatch(r"([0-9]{12})\.json", n)))

    def manifest(self, version: int) -> dict[str, str]:
        """Bucket -> folder of its rows."""
        with_ = self.fs.open(self.at(f"manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(with_)).decode())
        finally:
            with_.close()

    def put(self, version: int, manifest: dict[str, str]) -> None:
        """Written beside, then renamed, which fails if that version is there."""
        own, name = self.at(f"manifests/.{uuid.uuid4().hex}"), self.at(f"manifests/{version:012d}.json")
        out = self.fs.create(own)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs = self.jvm.org.apache.hadoop.fs
        try:
            fs.FileContext.getFileContext(own.toUri(), self.conf).rename(own, name, self._no_options())
        except Exception as e:
            self.fs.delete(own, False)
            raise Conflict(f"{name} is there already") from e

    def _no_options(self):
        from pyspark import SparkContext

        return SparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)


def _read(spark: SparkSession, files: _Files, manifest: dict[str, str], only: set[str] | None = None) -> DataFrame:
    paths = [f"{files.root}/data/{where}/bucket={b}" for b, where in sorted(manifest.items()) if only is None or b in only]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The cache of a folder; empty if there is none of this version."""
    files = _Files(spark, path)
    versions = files.versions()
    return _read(spark, files, files.manifest(versions[-1]) if versions else {})


def update(new: DataFrame, path: str, gone: DataFrame | None = None) -> int:
    """Puts new rows (SCHEMA) over those of the cache in a folder; gone (url): rows that go unless they are new. Gives the number of buckets written.

    At most BUCKETS names of buckets come to the driver. Raises Conflict if another update came between; the cache is
    whole in any case, and the update may be tried again.
    """
    spark = new.sparkSession
    files = _Files(spark, path)
    versions = files.versions()
    now = files.manifest(versions[-1]) if versions else {}
    columns = ["url", "verdict_json", "checked_at", "tier"]
    named = new.select("url") if gone is None else new.select("url").unionByName(gone.select("url"))
    touched = {str(r[0]) for r in named.select(bucket(F.col("url"))).distinct().collect()}
    if not touched:
        return 0
    old = wellformed(_read(spark, files, now, touched))
    if gone is not None:
        old = old.join(gone.select("url").distinct(), "url", "left_anti")
    rows = upsert(old, new.select(columns)).select(*columns, bucket(F.col("url")).alias("bucket"))
    own = uuid.uuid4().hex
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{files.root}/data/{own}")
    written = {n.partition("=")[2] for n in files.names(f"data/{own}") if n.startswith("bucket=")}
    manifest = {b: where for b, where in now.items() if b not in touched} | dict.fromkeys(written, own)
    files.put(versions[-1] + 1 if versions else 1, manifest)
    _sweep(files)
    return len(touched)


def _sweep(files: _Files) -> None:
    """Removes what neither the last manifest nor the one before it names; an update that lost its files so can't be put in place any more."""
    versions = files.versions()
    held = {where for v in versions[-2:] for where in files.manifest(v).values()}
    for v in versions[:-2]:
        files.fs.delete(files.at(f"manifests/{v:012d}.json"), False)
    for where in set(files.names("data")) - held:
        files.fs.delete(files.at(f"data/{where}"), True)


def clear(spark: SparkSession, path: str) -> None:
    """Deletes the cache, of all versions."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a cache's files, of all versions; 0 without any."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return int(fs.getContentSummary(at).getLength()) if fs.exists(at) else 0
