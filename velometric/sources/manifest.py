"""Manifests of source files: what is new, what changed, which months are complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velometric.functions.columns import yyyymm
from velometric.schema import FIRST_MONTH


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size and a change tag of every file; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.col("length").alias("size"), "modificationTime")
    )
    tag = F.concat_ws("-", F.col("size"), F.unix_micros("modificationTime"))
    return files.select("path", tag.alias("etag"), "size")


def region_available(ym: Column, region: Column) -> Column:
    """Whether a region published data in a month."""
    known = F.lit(False)
    for name, first in FIRST_MONTH.items():
        known = known | ((region == name) & (ym >= first))
    return known


def choose_keys(manifest: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Keys matching one include or not matching one exclude pattern."""
    if include and exclude:
        raise ValueError("give include or exclude, not both")
    if include:
        return manifest.where(F.col("path").rlike(include))
    return manifest.where(~F.col("path").rlike(exclude)) if exclude else manifest


def manifest_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Status of every path: new, changed, same or gone."""
    old = stored.select("path", F.col("etag").alias("old_etag"))
    new = current.select("path", F.col("etag").alias("new_etag"))
    status = (
        F.when(F.col("old_etag").isNull(), F.lit("new"))
        .when(F.col("new_etag").isNull(), F.lit("gone"))
        .when(F.col("old_etag") != F.col("new_etag"), F.lit("changed"))
        .otherwise(F.lit("same"))
    )
    return old.join(new, "path", "full").withColumn("status", status)


def to_import(diff: DataFrame) -> DataFrame:
    """Paths to read again."""
    return diff.where(F.col("status").isin("new", "changed")).select("path")


def changed_months(diff: DataFrame) -> list[int]:
    """Source months whose files are new, changed or gone; the month is the first six digits of a file's name."""
    name = F.element_at(F.split("path", "/"), -1)
    month = F.regexp_extract(name, r"(\d{6})", 1)
    found = diff.where((F.col("status") != "same") & (month != "")).select(month.cast("int").alias("ym")).distinct()
    return sorted(r["ym"] for r in found.collect())


def month_regions(manifest: DataFrame) -> DataFrame:
    """Per month: regions present, regions expected, and whether the month is complete."""
    expected = sum((F.col("ym") >= first).cast("int") for first in FIRST_MONTH.values())
    valid = manifest.where(region_available(F.col("ym"), F.col("src_region")))
    present = valid.groupBy("ym").agg(F.count_distinct("src_region").alias("regions"))
    return present.withColumn("expected", expected).withColumn("complete", F.col("regions") >= F.col("expected"))


def latest_month(months: DataFrame) -> int:
    """Last usable month of a `month_regions` table; only the final month may be incomplete."""
    last = months.orderBy(F.desc("ym")).limit(2).collect()
    if last and last[0]["complete"]:
        return last[0]["ym"]
    if len(last) == 2 and last[1]["complete"]:
        return last[1]["ym"]
    raise RuntimeError(f"regions missing from {', '.join(str(r['ym']) for r in last) or 'all months'}")


def rides_after(rides: DataFrame, table: DataFrame, month: str = "ym") -> DataFrame:
    """Rides whose stop month lies past the last month of an existing table.

    The bound is one number fetched from the small table, so it prunes partitions of the rides.
    """
    last = table.agg(F.max(month)).first()[0]
    if last is None:
        return rides
    column = F.col("stop_ym") if "stop_ym" in rides.columns else yyyymm(F.col("Stop Time"))
    return rides.where(column > last)
