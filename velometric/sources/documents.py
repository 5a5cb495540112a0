"""JSON documents: objects keyed by id, nested count maps, record arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATION_MAP = "map<string, struct<name: string, lat: double, lng: double, ends: bigint>>"
PAIR_MAP = "map<string, map<string, bigint>>"
RECORD_SCHEMA = (
    "Year int, Month int, Region string, `User Type` string, `Rideable Type` string, "
    "Gender int, Count bigint, Duration bigint"
)


# Text that is not what is asked for is an error, never a row that vanishes.
_STRICT = {"mode": "FAILFAST"}


def _objects(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """Text of JSON objects, one a row: of entry lines, or of whole files.

    Entry-per-line files (what the sinks write) start with a lone `{` line and separate entries by
    a leading comma, so each line can be parsed on its own and files are split freely. A file in any other
    layout is one object for one task.
    """
    if whole:
        return spark.read.text(path, wholetext=True).where(F.trim("value") != "").select(F.col("value").alias("doc"))
    lines = spark.read.text(path).where(~F.col("value").isin("{", "}", ""))
    entry = F.regexp_replace("value", r"^,", "")
    return lines.select(
        F.when(entry.startswith("{"), entry).otherwise(F.concat(F.lit("{"), entry, F.lit("}"))).alias("doc")
    )


def _parsed(schema: str) -> Column:
    parsed = F.from_json("doc", schema, _STRICT)
    start = F.concat(F.lit("no JSON object: "), F.substring("doc", 1, 80))
    return F.explode(F.coalesce(parsed, F.raise_error(start).cast(schema)))


def read_station_json(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Stations from an object keyed by id: an entry (or an object) per line, or `whole` files in any layout.

    A line or file that does not parse is an error.
    """
    parsed = _objects(spark, path, whole).select(_parsed(STATION_MAP).alias("id", "s"))
    return parsed.select("id", "s.name", "s.lat", "s.lng", "s.ends")


def read_pair_json(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Start/end index counts from a nested map, laid out as in `read_station_json`."""
    starts = _objects(spark, path, whole).select(_parsed(PAIR_MAP).alias("sidx", "ends"))
    pairs = starts.select("sidx", F.explode("ends").alias("eidx", "count"))
    return pairs.select(F.col("sidx").cast("bigint"), F.col("eidx").cast("bigint"), "count")


def parse_pair_maps(maps: DataFrame) -> DataFrame:
    """Long rows from one-map-per-start rows."""
    parsed = maps.select("sidx", F.explode(F.from_json("ends", "map<string, bigint>")).alias("eidx", "count"))
    return parsed.select("sidx", F.col("eidx").cast("bigint").alias("eidx"), "count")


def read_records(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Dashboard records, as JSON lines or as one array per file."""
    return spark.read.schema(RECORD_SCHEMA).option("multiLine", array).json(path)
