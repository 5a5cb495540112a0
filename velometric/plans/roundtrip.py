"""Write derived tables to the shared scratch folder and read them back through the sources."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velometric.functions.columns import yyyymm
from velometric.operators.backfill import write_backfilled
from velometric.operators.conform import conform, union_regions
from velometric.operators.dedupe import ride_key
from velometric.operators.rollup import dashboard_records, key_columns, rollup
from velometric.operators.snapshots import snapshot_changes as compare
from velometric.operators.stations import (
    pair_counts,
    pair_maps,
    station_index,
    stations,
)
from velometric.plans.deltas import apply_changes
from velometric.plans.lattice import answer, write_lattice
from velometric.plans.monthly import (
    all_time_stations,
    build_rides,
    build_rollups,
    build_sorted_csvs,
    build_station_states,
)
from velometric.plans.publishing import both_member_types, mixed_layouts, publish
from velometric.schema import FIRST_MONTH
from velometric.session import scratch_path
from velometric.sinks.writers import (
    PART_KEYS,
    repartition_snapshot,
    save,
    stored,
    write_by_month,
    write_pair_json,
    write_records,
    write_ride_parts,
    write_sorted_csv,
    write_station_json,
)
from velometric.sources.archives import read_archives
from velometric.sources.documents import read_pair_json, read_records, read_station_json
from velometric.sources.files import read_rides, read_trip_csv
from velometric.sources.manifest import changed_months, manifest_diff, rides_after
from velometric.sources.sorted_csv import index_sorted_csv, read_csv_months


def _as_text(raw: DataFrame) -> DataFrame:
    return raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns])


def csv_ingest(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """Plain CSV out, typed and conformed rides back."""
    path = scratch_path(spark, "csv")
    _as_text(raw).write.option("header", True).csv(path)
    return conform(read_trip_csv(spark, path, raw.columns), region_column="src_region")


def sorted_csv(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """Sorted gzipped CSV out, conformed rides back."""
    path = scratch_path(spark, "sorted-csv")
    write_sorted_csv(_as_text(raw), path)
    return conform(read_trip_csv(spark, path, raw.columns, spread=True), region_column="src_region")


def csv_months(spark: SparkSession, raw: DataFrame, first: int, last: int) -> DataFrame:
    """Sorted gzipped CSV out with its range index, conformed rides of some start months back."""
    path = scratch_path(spark, "sorted-csv")
    text = _as_text(raw)
    write_sorted_csv(text, path)
    index_sorted_csv(spark, path, raw.columns)
    return conform(read_csv_months(spark, path, raw.columns, first, last, spread=True), region_column="src_region")


def zip_ingest(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """Zip archives of several layouts, then listed, chosen, streamed and conformed."""
    return conform(read_archives(publish(spark, raw, mixed_layouts())), region_column="src_region")


def zip_name_types(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """What each preference reads of a month that is there both in parts and as one file."""
    paths = publish(spark, raw.where("src_region = 'NYC'"), both_member_types())
    sides = []
    for name_type in (1, 2):
        ids = read_archives(paths, name_type).select(F.col("Ride ID").cast("bigint").alias("id"))
        sides.append(ids.agg(F.lit(name_type).alias("name_type"), F.count("id").alias("n"), F.sum("id").alias("ids")))
    return sides[0].unionAll(sides[1])


def zip_to_csv(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """Archives rewritten as one sorted CSV set per month and region, read back and conformed."""
    root = scratch_path(spark, "csvs")
    written = build_sorted_csvs(publish(spark, raw, mixed_layouts()), root)
    frames = [conform(read_trip_csv(spark, path, header, spread=True), region) for path, region, header in written]
    return union_regions(*frames)


def snapshot_scan(spark: SparkSession, new: DataFrame, old: DataFrame, month: int) -> DataFrame:
    """A new and an older snapshot of one month, stored beside each other, split into parts and compared by part.

    Each snapshot is first kept as the one-file month it was published as.
    """
    root = scratch_path(spark, "snapshots")
    sides = []
    for name, rides in (("v1", new), ("v0", old)):
        save(rides, f"{root}/whole/{name}/{month}")
        repartition_snapshot(spark.read.parquet(f"{root}/whole/{name}/{month}"), f"{root}/{name}", month)
        counts = read_rides(spark, f"{root}/{name}").groupBy(*PART_KEYS)
        sides.append(counts.agg(F.count(F.lit(1)).alias(f"rows_{name}")))
    return sides[0].join(sides[1], PART_KEYS, "full")


def snapshot_changes(spark: SparkSession, new: DataFrame, old: DataFrame) -> DataFrame:
    """Two snapshots stored by stop month (`ym`), compared by digest first; ride keys of what changed."""
    root = scratch_path(spark, "digests")
    for name, rides in (("v1", new), ("v0", old)):
        write_by_month(rides, f"{root}/{name}")
    return compare(read_rides(spark, f"{root}/v1"), read_rides(spark, f"{root}/v0"), ["ym"], ride_key(new))


def backfill_written(spark: SparkSession, new: DataFrame, old: DataFrame) -> DataFrame:
    """Empty values before and after a backfill, as the job that writes it sees them."""
    return write_backfilled(new, old, scratch_path(spark, "backfilled"))


def month_files(spark: SparkSession, rides: DataFrame) -> DataFrame:
    """A table of months, of which several are loaded with their month as `ym`."""
    path = scratch_path(spark, "months")
    table = rollup(rides, "rt", "c", by_month=True)
    write_by_month(table, path)
    return read_rides(spark, path, [202001, 202006, 202012], "ym").select(*table.columns)


def month_rebuild(spark: SparkSession, raws: DataFrame) -> DataFrame:
    """Source months built, then one of them rebuilt with fewer stop months; rows by month of what is left.

    Rides of `raws` carry `src_ym`. The rebuild leaves out the rides that end in a later month, so months that only
    they reached must lose their rows.
    """
    root = scratch_path(spark, "rebuild")
    months = [r[0] for r in raws.select("src_ym").distinct().orderBy("src_ym").collect()]

    def build(rows: DataFrame, of: list[int]) -> None:
        by_region = [(rows.where(F.col("src_region") == r).drop("src_region"), r) for r in FIRST_MONTH]
        build_rides(spark, by_region, root, of)

    build(raws, months)
    stop = F.year("ended_at") * 100 + F.month("ended_at")
    first = raws.where((F.col("src_ym") == months[0]) & (stop <= months[0]))
    build(first, months[:1])
    return spark.read.parquet(f"{root}/rides").groupBy("ym").agg(F.count(F.lit(1)).alias("n"))


def rollup_delta(spark: SparkSession, raws: DataFrame) -> DataFrame:
    """Rollups after some source files changed: the changed months found by manifest and carried over as signed deltas.

    At first the files of every fourth source month lack a third of their rides and one month is not there at all.
    """
    root = scratch_path(spark, "deltas")
    months = sorted(r[0] for r in raws.select("src_ym").distinct().collect())
    short = F.col("src_ym").isin(months[1::4]) & (F.col("ride_id").cast("bigint") % 3 == 0)
    first = raws.where(~short & (F.col("src_ym") != months[-1]))

    def by_region(rows: DataFrame) -> list[tuple[DataFrame, str]]:
        return [(rows.where(F.col("src_region") == r).drop("src_region"), r) for r in FIRST_MONTH]

    def manifest(rows: DataFrame) -> DataFrame:
        files = rows.groupBy("src_ym", "src_region").agg(F.sum(F.col("ride_id").cast("bigint")).cast("string").alias("etag"))
        return files.select(F.concat_ws("-", "src_region", "src_ym", F.lit("trips.zip")).alias("path"), "etag")

    build_rollups(build_rides(spark, by_region(first), root, months[:-1]), root)
    changed = changed_months(manifest_diff(manifest(first), manifest(raws)))
    apply_changes(spark, by_region(raws.where(F.col("src_ym").isin(changed))), root, changed)
    table = spark.read.parquet(f"{root}/aggregated/ymrgtb_cd")
    return table.select("ym", *[c for c in table.columns if c != "ym"])


def ride_order(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """Rides per stop month as written, and how many of them stand before a smaller one in their file."""
    root = scratch_path(spark, "ordered")
    months = [r[0] for r in parts.select("src_ym").distinct().collect()]
    write_ride_parts(parts, root, months)
    key = F.struct("Start Time", "Stop Time", "Ride ID")
    placed = read_rides(spark, root).select(
        "stop_ym", key.alias("key"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")
    )
    ahead = F.lag("key").over(Window.partitionBy("file").orderBy("at"))
    rows = placed.select("stop_ym", (F.coalesce(ahead > F.col("key"), F.lit(False))).alias("late"))
    return rows.groupBy("stop_ym").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("out_of_order"))


def partition_write(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """Ride parts out, row counts per part back; a second write replaces one source month."""
    root = scratch_path(spark, "rides")
    months = [r[0] for r in parts.select("src_ym").distinct().orderBy("src_ym").collect()]
    write_ride_parts(parts, root, months)
    first = stored(spark, root, parts.schema).where(F.col("src_ym") == months[0])
    write_ride_parts(first.where(F.col("stop_ym") <= F.col("src_ym")), root, months[:1])
    return read_rides(spark, root).groupBy(*PART_KEYS).agg(F.count(F.lit(1)).alias("n"))


def incremental_append(spark: SparkSession, rides: DataFrame, last_known: int) -> DataFrame:
    """A rollup table up to a month, extended by the months after it."""
    path = scratch_path(spark, "rollup")
    table = rollup(rides, "rg", "cd", by_month=True)
    write_by_month(table.where(F.col("ym") <= last_known), path)
    stored = spark.read.schema(table.schema).parquet(path)
    newer = rides_after(rides, stored)
    write_by_month(rollup(newer, "rg", "cd", by_month=True), path)
    return spark.read.schema(table.schema).parquet(path)


def json_records(spark: SparkSession, rides: DataFrame) -> DataFrame:
    path = scratch_path(spark, "records")
    write_records(dashboard_records(rollup(rides, "ymrgtb", "cd")), path)
    return read_records(spark, path)


def station_json(spark: SparkSession, rides: DataFrame) -> DataFrame:
    path = scratch_path(spark, "stations-json")
    write_station_json(stations(rides), path)
    return read_station_json(spark, path)


def pair_json(spark: SparkSession, rides: DataFrame) -> DataFrame:
    path = scratch_path(spark, "pairs-json")
    pairs = pair_counts(rollup(rides, "se", "c"), station_index(stations(rides)))
    write_pair_json(pair_maps(pairs), path)
    return read_pair_json(spark, path)


def station_json_whole(spark: SparkSession, rides: DataFrame) -> DataFrame:
    """Stations as indented objects, one file for the stations of each first letter, read back as whole files."""
    path = scratch_path(spark, "stations-indented")
    entry = F.struct("id", F.struct("name", "lat", "lng", "ends"))
    objects = stations(rides).groupBy(F.substring("id", 1, 1).alias("letter")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry)), {"pretty": "true"}).alias("value")
    )
    objects.repartition("letter").write.partitionBy("letter").text(path)
    return read_station_json(spark, path, whole=True)


def pair_json_whole(spark: SparkSession, rides: DataFrame) -> DataFrame:
    """Pair counts as indented objects, one file for each start, read back as whole files."""
    path = scratch_path(spark, "pairs-indented")
    maps = pair_maps(pair_counts(rollup(rides, "se", "c"), station_index(stations(rides))))
    ends = F.from_json("ends", "map<string, bigint>")
    pretty = F.to_json(F.create_map(F.col("sidx").cast("string"), ends), {"pretty": "true"}).alias("value")
    maps.select("sidx", pretty).repartition("sidx").write.partitionBy("sidx").text(path)
    return read_pair_json(spark, path, whole=True)


ROUTED = [("r", "cd"), ("gt", "cd"), ("yw", "c"), ("s", "c"), ("rh", "d")]


def rollup_routed(spark: SparkSession, rides: DataFrame) -> DataFrame:
    """Rollups of several shapes, each answered from the smallest stored one that covers it; keys as one text."""
    root = scratch_path(spark, "lattice")
    write_lattice(rides, root)
    answers = []
    for keys, sums in ROUTED:
        table = answer(spark, root, keys, sums)
        totals = [(F.col(c) if c in table.columns else F.lit(None)).cast("bigint").alias(c) for c in ("Count", "Duration")]
        key = F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in key_columns(keys)])
        answers.append(table.select(F.lit(keys).alias("keys"), key.alias("key"), *totals))
    return union_regions(*answers)


def stations_all_time(spark: SparkSession, rides: DataFrame) -> DataFrame:
    """The station table from stored monthly states, after one month was taken out and another built wrong and replaced."""
    root = scratch_path(spark, "states")
    build_station_states(rides, root)
    months = sorted(r["ym"] for r in spark.read.parquet(f"{root}/stations/states").select("ym").distinct().collect())
    build_station_states(rides.limit(0), root, months[:1])
    last = rides.where(yyyymm(F.col("Stop Time")) == months[-1])
    build_station_states(last.unionAll(last), root, months[-1:])
    build_station_states(last, root, months[-1:])
    return all_time_stations(spark, root)


def saved_formats(spark: SparkSession, table: DataFrame) -> DataFrame:
    """The generic sink in each format; an existing output is left alone unless overwritten."""
    root = scratch_path(spark, "saved")
    for fmt in ("parquet", "csv", "json"):
        options = {"header": True} if fmt == "csv" else {}
        save(table, os.path.join(root, fmt), fmt, **options)
        save(table.limit(0), os.path.join(root, fmt), fmt, **options)
    back = [
        spark.read.parquet(f"{root}/parquet"),
        spark.read.schema(table.schema).option("header", True).csv(f"{root}/csv"),
        spark.read.schema(table.schema).json(f"{root}/json"),
    ]
    rows = [df.withColumn("format", F.lit(f)) for df, f in zip(back, ("parquet", "csv", "json"), strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
