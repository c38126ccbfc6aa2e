"""Following a folder of documents: the batch operators in micro-batches. An addition, not a feature of the audit itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators import extract
from linkloom.sources import files


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Links of every document that arrives in the folder, as Parquet, one folder a micro-batch: a repeated batch overwrites its own."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    docs = spark.readStream.format("binaryFile").schema(schema).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        extract.links(files.detected(batch.select(F.col("path"), "length", "content")), "permissive").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
