"""Sets of records compared by one value, and their order by record.

A record is its columns as text, joined by the character 31, with an empty text for null. The
digest of a multiset is the sum, modulo 2^64, of either half of its records' MD5, and so is
the same in any order, summed in parts; equal records count each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.tables import Scratch


def record(columns: list[str]) -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def _half(md5: Column, start: int) -> Column:
    """16 hexadecimal digits as an exact number."""
    return F.conv(F.substring(md5, start, 16), 16, 10).cast("decimal(20,0)")


def _folded(total: str) -> Column:
    """An exact sum modulo 2^64 as 16 hexadecimal digits."""
    left = F.expr(f"CAST(mod({total}, {1 << 64}BD) AS DECIMAL(20,0))")
    return F.lower(F.lpad(F.conv(left.cast("string"), 10, 16), 16, "0"))


def digested(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, n, digest (32 hexadecimal digits) of the rows' records."""
    md5 = F.md5(record(columns).cast("binary"))
    sums = rows.select(*by, md5.alias("_m")).groupBy(by).agg(F.count("*").alias("n"), F.sum(_half(F.col("_m"), 1)).alias("_high"), F.sum(_half(F.col("_m"), 17)).alias("_low"))
    return sums.select(*by, "n", F.concat(_folded("_high"), _folded("_low")).alias("digest"))


def numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with place (from 1) in the order of their records: sorted in ranges, which are numbered by their sizes; equal records in any order."""
    own = Scratch(rows.sparkSession)
    name = "_record"
    ordered = rows.withColumn(name, record(columns)).orderBy(name).withColumn("_at", F.monotonically_increasing_id())
    ordered = own.keep(own.settle(ordered.drop(name), "ordered"))
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()  # one row a range
    before, total = {}, 0
    for r in sizes:
        before[r["_part"]] = total - (r["_part"] << 33) + 1
        total += r["_n"]
    shift = F.create_map(*(F.lit(x) for p, s in before.items() for x in (p, s)))[part] if before else F.lit(0)
    return ordered.withColumn("place", F.col("_at") + shift).drop("_at")
