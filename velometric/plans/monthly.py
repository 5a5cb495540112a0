"""The monthly stages end to end: normalise, consolidate, roll up, describe stations, serve."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velometric.operators.backfill import backfill
from velometric.operators.conform import conform, union_regions, with_part_keys
from velometric.operators.dedupe import assert_unique_key, exact_dedupe, merge_pairs, ride_columns_only, ride_key
from velometric.operators.rollup import STANDARD_ROLLUPS, dashboard_records, rollup
from velometric.operators.stations import (
    merge_states,
    pair_counts,
    pair_maps,
    station_index,
    station_states,
    stations,
    stations_from_states,
)
from velometric.schema import BACKFILL_MONTHS
from velometric.sinks.journal import folders, fresh, note, noted, remove, whole
from velometric.sinks.writers import (
    PART_KEYS,
    finish_swaps,
    save,
    stored,
    write_by_month,
    write_pair_json,
    write_ride_parts,
    write_sorted_csv,
    write_station_json,
)
from velometric.sources.archives import RECORDS, read_archives
from velometric.sources.files import with_source_part, without_known_bad_parts


def build_sorted_csvs(paths: DataFrame, root: str) -> list[tuple[str, str, list[str]]]:
    """Archives to one sorted gzipped CSV set per month and region: (path, region, header) of each.

    The rows written must be as many as the records that the archives' members hold, counted from their bytes while these
    are read, else the month is an error.
    """
    done = []
    for row in paths.select("ym", "src_region").distinct().orderBy("ym", "src_region").collect():
        own = paths.where((F.col("ym") == row["ym"]) & (F.col("src_region") == row["src_region"]))
        trips = read_archives(own, spread=False, records=True).drop("src_ym", "src_region")
        path = f"{root}/{row['src_region']}-{row['ym']}"
        write_sorted_csv(trips, path, records=RECORDS, spread=True)
        done.append((path, row["src_region"], [c for c in trips.columns if c != RECORDS]))
    return done


def normalized(raws: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct conformed rides of several regions with their source, start and stop months.

    Each frame carries `src_ym`, the month of the file a row came from.
    """
    frames = [conform(raw, region, keep=["src_ym"]) for raw, region in raws]
    return exact_dedupe(with_part_keys(union_regions(*frames)))


def consolidated(
    parts: DataFrame,
    old: DataFrame | None = None,
    backfill_months: tuple[int, int] = BACKFILL_MONTHS,
    check: bool = True,
) -> DataFrame:
    """Rides by stop month over all source months, `ym` being the stop month.

    In the backfill months rides found in two source files are merged and empty fields are filled
    from the older snapshot; the other months pass as they are, since the normalised parts have no
    exact copies and their rows differ in the part they come from. With `check` a pass over the key columns first makes
    sure that no key has more than two rows to merge.
    """
    tagged = with_source_part(without_known_bad_parts(parts))
    inside = F.col("stop_ym").between(*backfill_months)
    plain = tagged.where(~inside)
    merged = merge_pairs(tagged.where(inside), check=check)
    if old is not None:
        merged = backfill(merged, old, check=False)
    distinct = plain.unionByName(merged)
    return distinct.select(*ride_columns_only(distinct).columns, F.col("stop_ym").alias("ym"))


MONTHS = "kind string, ym int"


def stop_months(parts: DataFrame, src_months: Collection[int]) -> set[int]:
    own = parts.where(F.col("src_ym").isin(sorted(src_months)))
    return {r["stop_ym"] for r in own.select("stop_ym").distinct().collect()}


def rebuild_months(spark: SparkSession, root: str, parts: DataFrame, months: Collection[int], old: DataFrame | None = None) -> DataFrame:
    """Consolidate stop months anew from the written parts; ride keys are verified before anything is replaced."""
    table = consolidated(parts.where(F.col("stop_ym").isin(sorted(months))), old)
    write_by_month(table, f"{root}/rides", verify=assert_unique_key, months=sorted(months))
    return stored(spark, f"{root}/rides", table.schema)


def resume_build(spark: SparkSession, root: str, schema: T.StructType, old: DataFrame | None = None) -> None:
    """Finish what a stopped build left: swaps that were noted, then the stop months of its note."""
    open_notes = folders(spark, root, "_build-")
    if not open_notes:
        return
    parts_path = f"{root}/normalized"
    parts = stored(spark, parts_path, schema)
    finish_swaps(spark, parts_path, PART_KEYS, ride_key(parts), schema)
    parts = stored(spark, parts_path, schema)
    left = [row for path in open_notes if whole(spark, path) for row in noted(spark, path, MONTHS)]
    touched = {ym for kind, ym in left if kind == "stop"} | stop_months(parts, {ym for kind, ym in left if kind == "src"})
    rebuild_months(spark, root, parts, touched, old)
    for path in open_notes:
        remove(spark, path)


def build_rides(
    spark: SparkSession,
    raws: Sequence[tuple[DataFrame, str]],
    root: str,
    src_months: Sequence[int],
    old: DataFrame | None = None,
) -> DataFrame:
    """Write the normalised parts, then the consolidated months they touch; returns the latter.

    Touched are the stop months of the source months before and after: a month that a rebuild no longer reaches is
    rebuilt from what other source months have for it, and goes when that is nothing. Which source months are written and
    which stop months they had is noted durably before the parts change; a build that finds the note of a stopped one
    finishes that first. Reading the written parts back cuts the lineage at a durable table and lets the consolidated
    step prune by month. Ride keys are verified on the written months, from their key columns, before those replace the
    table's.
    """
    parts_path = f"{root}/normalized"
    rides = normalized(raws)
    resume_build(spark, root, rides.schema, old)

    def touched_now() -> set[int]:
        return stop_months(stored(spark, parts_path, rides.schema), src_months)

    touched, own_note = touched_now(), fresh(root, "_build-")
    note(spark, own_note, [*(("src", m) for m in src_months), *(("stop", m) for m in sorted(touched))], MONTHS)
    write_ride_parts(rides, parts_path, src_months)
    touched |= touched_now()
    table = rebuild_months(spark, root, stored(spark, parts_path, rides.schema), touched, old)
    remove(spark, own_note)
    return table.where(F.col("ym").isin(sorted(touched)))


def build_rollups(rides: DataFrame, root: str, months: Sequence[int] | None = None) -> None:
    """The standard rollups of the given months; `months` without rides lose theirs."""
    for keys, sums in STANDARD_ROLLUPS:
        table = rollup(rides, keys, sums, by_month=True)
        write_by_month(table, f"{root}/aggregated/{keys}_{sums}", months=months)


def build_station_states(rides: DataFrame, root: str, months: Sequence[int] | None = None) -> None:
    """Mergeable station states of the stop months in `rides`; `months` without rides lose theirs."""
    write_by_month(station_states(rides, by_month=True), f"{root}/stations/states", months=months)


def all_time_stations(spark: SparkSession, root: str, months: Sequence[int] | None = None) -> DataFrame:
    """The station table over all stored months, or some of them; no ride is read."""
    states = spark.read.parquet(f"{root}/stations/states")
    if months is not None:
        states = states.where(F.col("ym").isin(list(months)))
    return stations_from_states(merge_states(states))


def build_month_documents(spark: SparkSession, rides: DataFrame, root: str, ym: int) -> None:
    """Station and pair documents of one month."""
    month = rides.where(F.col("ym") == ym)
    save(stations(month), f"{root}/stations/{ym}", overwrite=True)
    dim = spark.read.parquet(f"{root}/stations/{ym}")
    se_c = spark.read.parquet(f"{root}/aggregated/se_c").where(F.col("ym") == ym)
    write_station_json(dim, f"{root}/documents/{ym}/stations.json")
    write_pair_json(pair_maps(pair_counts(se_c, station_index(dim))), f"{root}/documents/{ym}/se_c.json")


def build_dashboard(spark: SparkSession, root: str) -> DataFrame:
    """Records over all months of the `ymrgtb_cd` rollup."""
    return dashboard_records(spark.read.parquet(f"{root}/aggregated/ymrgtb_cd"))
