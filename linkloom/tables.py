"""Tables that cut lineage, in the folder that the session names as shared, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine, a folder of this session. On a cluster it must be set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    own = spark.conf.get("linkloom.shared.dir", None)
    if not own:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("linkloom.shared.dir", own)
    return own


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The path by which any executor opens the shared folder's files."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"files that tasks open themselves need a mounted shared folder in spark.checkpoint.dir, not {path}")
    Path(url.path).mkdir(parents=True, exist_ok=True)
    return url.path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def _clean(spark: SparkSession):
    """Shuffle files of the actions inside go when each ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


class Scratch:
    """The tables of one call. As a context, it removes at its end all that were not kept.

    Everything settled is whole in the shared folder before a later step reads it, so that lost
    executors cost their running tasks only.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: dict[int, tuple[DataFrame, str, str | None]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.tables())

    def settle(self, df: DataFrame, name: str = "table") -> DataFrame:
        """The rows written to the shared folder and read from there: computed once."""
        path = folder(self.spark, name)
        with _clean(self.spark):
            df.write.parquet(path)
        return self._hold(self.spark.read.schema(df.schema).parquet(path), path)

    def bucketed(self, df: DataFrame, key: str, name: str = "table") -> DataFrame:
        """Like ``settle``, dealt by ``key`` into as many buckets as shuffles have partitions: joins by key read it without shuffling it."""
        path = folder(self.spark, name)
        table = f"linkloom_{path.rsplit('-', 1)[1]}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with _clean(self.spark):
            df.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        return self._hold(self.spark.table(table), path, table)

    def _hold(self, df: DataFrame, path: str, table: str | None = None) -> DataFrame:
        self.held[id(df)] = (df, path, table)
        return df

    def tables(self) -> list[DataFrame]:
        return [df for df, *_ in self.held.values()]

    def keep(self, *tables: DataFrame) -> DataFrame:
        """These tables stay when the call ends, as what it returns reads them; gives the first."""
        for df in tables:
            self.held.pop(id(df), None)
        return tables[0]

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for df in tables:
            _, path, table = self.held.pop(id(df))
            if table:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove(self.spark, path)


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """A settled table that stays."""
    own = Scratch(df.sparkSession)
    return own.keep(own.settle(df, name))
