"""Delimited and Parquet ride files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velometric.operators.conform import nulls_from_tokens
from velometric.schema import KNOWN_BAD_PARTS


def read_trip_csv(
    spark: SparkSession, paths: str | Sequence[str], header: Sequence[str], spread: bool = False
) -> DataFrame:
    """Plain or gzipped CSV of one header era as text columns.

    The header line of every file is checked against `header`. Gzip files cannot be split: `spread` rebalances the rows
    after the scan, which is worth its shuffle when few large gzip files would leave later work to few tasks.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(paths)
    )
    if spread:
        raw = raw.hint("rebalance")
    return nulls_from_tokens(raw)


def read_rides(
    spark: SparkSession, root: str, months: Sequence[int] | None = None, month_column: str = "stop_ym"
) -> DataFrame:
    """Partitioned ride table, restricted to month partitions."""
    rides = spark.read.parquet(root)
    return rides if months is None else rides.where(F.col(month_column).isin(list(months)))


def without_known_bad_parts(rides: DataFrame) -> DataFrame:
    """Leave out the parts that only hold a near-copy of another row."""
    for src, start, stop in KNOWN_BAD_PARTS:
        bad = (F.col("src_ym") == src) & (F.col("start_ym") == start) & (F.col("stop_ym") == stop)
        rides = rides.where(~bad)
    return rides


def with_source_part(rides: DataFrame) -> DataFrame:
    """`file` tag naming the source, start and stop month a row came from."""
    return rides.withColumn(
        "file", F.format_string("%d/%d_%d", F.col("src_ym"), F.col("start_ym"), F.col("stop_ym"))
    )


def read_stem_parquet(spark: SparkSession, glob: str) -> DataFrame:
    """Files laid out as `{src}/{start}_{stop}.parquet`; the months come from the path."""
    path = F.col("_metadata.file_path")
    pattern = r"/(\d{6})/(\d{6})_(\d{6})\.parquet$"
    df = spark.read.option("basePath", glob.split("*")[0].rsplit("/", 1)[0]).parquet(glob)
    return df.withColumns(
        {
            "src_ym": F.regexp_extract(path, pattern, 1).cast("int"),
            "start_ym": F.regexp_extract(path, pattern, 2).cast("int"),
            "stop_ym": F.regexp_extract(path, pattern, 3).cast("int"),
        }
    )


def read_month_files(spark: SparkSession, glob: str, pattern: str = r"(\d{6})\.parquet$") -> DataFrame:
    """One file per month; the month in the file name becomes `ym`."""
    name = F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)
    return spark.read.parquet(glob).withColumn("ym", name.cast("int"))
