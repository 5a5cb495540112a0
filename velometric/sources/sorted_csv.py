"""Sorted CSV with a range index, so that a range of months reads the part files that can hold it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velometric.functions.columns import trip_time, yyyymm
from velometric.sinks.writers import csv_sort_columns
from velometric.sources.files import read_trip_csv

RANGES = "_ranges"
_SCHEMA = "file string, first timestamp_ntz, last timestamp_ntz, rows bigint"


def _start(header: Sequence[str]) -> str:
    return trip_time(f"`{csv_sort_columns(header)[0]}`")


def index_sorted_csv(spark: SparkSession, path: str, header: Sequence[str]) -> DataFrame:
    """First and last start and the rows of every part file, kept beside the files; returns it.

    Read back from what was written, so the index describes the files and not what was meant for them. A file with a row
    without a start has null bounds and is read for every range.
    """
    lines = read_trip_csv(spark, path, header)
    starts = lines.select(F.col("_metadata.file_name").alias("file"), F.expr(_start(header)).alias("at"))
    known = F.count("at") == F.count(F.lit(1))
    files = starts.groupBy("file").agg(
        F.when(known, F.min("at")).alias("first"), F.when(known, F.max("at")).alias("last"), F.count(F.lit(1)).alias("rows")
    )
    files.coalesce(1).write.mode("overwrite").parquet(f"{path}/{RANGES}")
    return spark.read.schema(_SCHEMA).parquet(f"{path}/{RANGES}")


def files_of_months(spark: SparkSession, path: str, header: Sequence[str], first: int, last: int) -> list[str]:
    """Part files that can hold a start in the months `first` to `last`; the driver sees one row a file.

    Files that the index does not know, or lacks, make it an error: they were written after it.
    """
    index = spark.read.schema(_SCHEMA).parquet(f"{path}/{RANGES}")
    meets = (yyyymm(F.col("first")) <= last) & (yyyymm(F.col("last")) >= first)
    rows = index.select("file", "rows", F.coalesce(meets, F.lit(True)).alias("meets")).collect()
    there = {f.rsplit("/", 1)[-1] for f in spark.read.schema("line string").csv(path).inputFiles()}
    known = {r["file"] for r in rows}
    # Files of a header alone have no row to be known by.
    if known - there:
        raise ValueError(f"the range index of {path} names files that are gone: {sorted(known - there)[:3]}")
    if unknown := sorted(there - known):
        if read_trip_csv(spark, [f"{path}/{f}" for f in unknown], header).limit(1).count():
            raise ValueError(f"{path} holds files that its range index does not know: {unknown[:3]}")
    return sorted(f"{path}/{r['file']}" for r in rows if r["meets"])


def read_csv_months(
    spark: SparkSession, path: str, header: Sequence[str], first: int, last: int, spread: bool = False
) -> DataFrame:
    """Raw trips that start in the months `first` to `last`, both included, from an indexed sorted CSV."""
    files = files_of_months(spark, path, header, first, last)
    if not files:
        return read_trip_csv(spark, path, header).limit(0)
    start = F.expr(_start(header))
    return read_trip_csv(spark, files, header, spread=spread).where(yyyymm(start).between(first, last))
