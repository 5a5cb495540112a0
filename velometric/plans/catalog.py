"""Named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velometric.functions.columns import (
    gender_letter,
    month_label,
    part_label,
    region_of,
    ride_seconds,
    seconds_label,
    yyyymm,
)
from velometric.functions.months import in_months
from velometric.operators import backfill as bf
from velometric.operators import dedupe as dd
from velometric.operators import explore as ex
from velometric.operators import series as sr
from velometric.operators import sets
from velometric.operators import stations as st
from velometric.operators.conform import (
    ambiguous_stations,
    column_surprises,
    conform,
    union_regions,
    with_part_keys,
)
from velometric.operators.rollup import compact_records, dashboard_records, resum, rollup
from velometric.plans import roundtrip
from velometric.plans.monthly import consolidated
from velometric.schema import REGION_PATTERNS, TIME_COLUMNS
from velometric.sinks.writers import renamed_subset
from velometric.sources.event_trips import read_event_trips
from velometric.sources.files import without_known_bad_parts
from velometric.sources.manifest import choose_keys, manifest_diff, month_regions
from velometric.sources.manifest import latest_month as latest_complete

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6
# The newest header's columns in an older spelling.
OLD_SPELLING = {
    "started_at": "starttime", "ended_at": "stoptime", "start_station_id": "start station id",
    "end_station_id": "End Station ID", "start_station_name": "start station name", "end_station_name": "End Station Name",
    "start_lat": "start station latitude", "start_lng": "start station longitude", "end_lat": "End Station Latitude",
    "end_lng": "End Station Longitude", "birth year": "Birth Year",
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- inputs -----------------------------------------------------------------------------------


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return read_event_trips(spark, folder)


def _rides(spark: SparkSession, folder: str, **options) -> DataFrame:
    return conform(_raw(spark, folder), region_column="src_region", **options)


def _republished(rides: DataFrame) -> DataFrame:
    """Monday rides appear a second time."""
    return rides.unionAll(rides.where(F.weekday("Start Time") == 0))


def _snapshots(rides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A newer snapshot with emptied fields and an older one that lacks some rides."""
    emptied = F.minute("Start Time") % 3 == 0
    new = rides.withColumns(
        {
            "Gender": F.when(emptied, F.lit(0)).otherwise(F.col("Gender")).cast("tinyint"),
            "Birth Year": F.when(~emptied, F.col("Birth Year")),
            "Bike ID": F.when(~emptied, F.col("Bike ID")),
        }
    )
    old = rides.where(F.hour("Start Time") != 3).withColumns(
        {
            "Gender": gender_letter(F.col("Gender")),
            "Bike ID": F.concat(F.col("Bike ID").cast("string"), F.lit(".0")),
        }
    )
    return new, old


def _differing(rides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshots, each lacking rides of the other."""
    new, old = _snapshots(rides)
    return new.where(F.hour("Start Time") != 4), old


def _pairs(rides: DataFrame) -> DataFrame:
    """The new snapshot as the later file, and rides of weekend starts in an earlier file too."""
    new, _ = _snapshots(rides)
    return new.withColumn("file", F.lit("b")).unionByName(
        rides.where(F.weekday("Start Time") >= 5).withColumn("file", F.lit("a"))
    )


def _halves(rides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rides before and from 2021."""
    early = F.year("Start Time") < 2021
    return rides.where(early), rides.where(~early)


def _new_stations(rides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rides before and from 2021, some stations being closed in either time."""
    early, late = _halves(rides)
    last = F.substring("Start Station ID", -1, 1)
    return early.where(last != "3"), late.where(last != "7")


def _rounded(df: DataFrame, *cols: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in cols})


def _order_months(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as monthly records: rides, minutes and two stacking dimensions."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    at = F.col("o_orderdate")
    return orders.groupBy(
        month_label(F.year(at), F.month(at)).alias("m"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    ).agg(
        F.count(F.lit(1)).alias("Rides"),
        (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 60).alias("Ride minutes"),
    )


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return sr.label_records(dashboard_records(rollup(_rides(spark, folder), "ymrgtb", "cd")))


# ---- conforming -------------------------------------------------------------------------------


@query
def rides_conformed(spark, folder):
    return _rides(spark, folder)


@query
def rides_open_ended(spark, folder):
    kept = _rides(spark, folder, keep_open_ended=True)
    return kept.select("Ride ID", "Start Region", "End Station ID", "End Region")


@query
def region_classify(spark, folder):
    raw = _raw(spark, folder)
    ids = raw.select(F.inline(F.array(
        F.struct(F.col("start_station_id").alias("id"), "src_region"),
        F.struct(F.col("end_station_id").alias("id"), "src_region"),
    )))
    counts = ids.groupBy("id", "src_region").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("region", F.expr(region_of("id", "src_region")))


@query
def region_ambiguity(spark, folder):
    """Ids that overlapping rules, as a caller might give them, put into two regions."""
    rules = {**REGION_PATTERNS, "HB": [*REGION_PATTERNS["HB"], r"JC0[67]"]}
    found = ambiguous_stations(_rides(spark, folder, drop_out_of_system=False), rules)
    return found.select("id", F.array_join("regions", ",").alias("regions"))


@query
def calendar_parts(spark, folder):
    start, stop = F.col("Start Time"), F.col("Stop Time")
    return _rides(spark, folder).select(
        "Ride ID",
        F.year(start).alias("year"),
        F.month(start).alias("month"),
        F.dayofmonth(start).alias("day"),
        F.weekday(start).alias("weekday"),
        F.hour(start).alias("hour"),
        ride_seconds(start, stop).alias("seconds"),
        ride_seconds(start, stop, wrap_days=False).alias("total_seconds"),
        part_label(start, stop).alias("part"),
    )


@query
def month_range_filter(spark, folder):
    parts = with_part_keys(_rides(spark, folder))
    chosen = parts.where(in_months(F.col("stop_ym"), "1906-08,2020-06,202201-"  , end=202203))
    return chosen.groupBy("stop_ym").agg(F.count(F.lit(1)).alias("n"))


# ---- rollups ----------------------------------------------------------------------------------


def _rollup_query(name: str, keys: str, sums: str, by_month: bool = False) -> None:
    def run(spark, folder):
        return rollup(_rides(spark, folder), keys, sums, by_month=by_month)

    QUERIES[name] = run


_rollup_query("rollup_ymrgtb_cd", "ymrgtb", "cd")
_rollup_query("rollup_s_c", "s", "c", True)
_rollup_query("rollup_e_c", "e", "c", True)
_rollup_query("rollup_se_c", "se", "c", True)
_rollup_query("rollup_ymrgw_c", "ymrgw", "c")
_rollup_query("rollup_day_hour_cd", "ymdh", "cd")
_rollup_query("rollup_name_c", "nN", "c")
_rollup_query("rollup_ymrse_c", "ymrse", "c")


@query
def rollup_latlng_c(spark, folder):
    table = rollup(_rides(spark, folder), "lL", "c")
    return _rounded(table, *[c for c in table.columns if c != "Count"])


@query
def group_totals(spark, folder):
    """Totals by station of a finer rollup, agreeing with the coarser one."""
    return resum(rollup(_rides(spark, folder), "seb", "cd"), ["Start Station ID"])


@query
def grand_totals(spark, folder):
    return ex.grand_totals(rollup(_rides(spark, folder), "se", "c"), "Count", "Start Station ID", "End Station ID")


@query
def month_gender(spark, folder):
    return ex.month_gender_totals(rollup(_rides(spark, folder), "ymg", "c"))


@query
def dashboard(spark, folder):
    return dashboard_records(rollup(_rides(spark, folder), "ymrgtb", "cd"))


@query
def compact_codes(spark, folder):
    return compact_records(dashboard_records(rollup(_rides(spark, folder), "ymrgtb", "cd")))


@query
def hudson_pairs(spark, folder):
    table = rollup(_rides(spark, folder), "ymrse", "c")
    names = {"Start Station ID": "start", "End Station ID": "end", "Start Year": "y", "Start Month": "m", "Count": "count"}
    return renamed_subset(table, names, F.col("Region") != "NYC")


@query
def value_counts(spark, folder):
    return ex.value_counts(_rides(spark, folder), ["User Type", "Rideable Type"])


@query
def category_filter(spark, folder):
    """Rides per bike type of the raw files without the odd dockless type."""
    raw = _raw(spark, folder).where("rideable_type <> 'motivate_dockless_bike'")
    return raw.groupBy("rideable_type").agg(F.count(F.lit(1)).alias("n"))


# ---- stations ---------------------------------------------------------------------------------


@query
def station_hist_in(spark, folder):
    return st.station_hist(_rides(spark, folder), "in")


@query
def station_hist_il(spark, folder):
    return _rounded(st.station_hist(_rides(spark, folder), "il"), "lat", "lng")


@query
def station_hist_ymi(spark, folder):
    return st.station_hist(_rides(spark, folder), "ymi")


@query
def station_mode(spark, folder):
    return st.modal_name(st.station_hist(_rides(spark, folder), "in"))


@query
def station_latlng(spark, folder):
    return _rounded(st.mean_place(st.station_hist(_rides(spark, folder), "il")), "lat", "lng")


@query
def stations_dim(spark, folder):
    return _rounded(st.stations(_rides(spark, folder)), "lat", "lng")


@query
def stations_joined(spark, folder):
    rides = _rides(spark, folder)
    joined = st.stations_from_hists(
        st.station_hist(rides, "in"), st.station_hist(rides, "il"), rollup(rides, "e", "c")
    )
    return _rounded(joined, "lat", "lng")


@query
def mode_diagnostics(spark, folder):
    return _rounded(st.mode_diagnostics(st.station_hist(_rides(spark, folder), "in")), "frac", "ratio")


def _with_run_text(sketch: DataFrame) -> DataFrame:
    text = F.array_join(
        F.transform("runs", lambda r: F.concat(r["count"].cast("string"), F.lit("x"), r["times"].cast("string"))), " "
    )
    return _rounded(sketch.withColumn("runs", text), "first/second", "mode_pct")


@query
def station_sketch(spark, folder):
    return _with_run_text(st.row_sketch(st.station_hist(_rides(spark, folder), "in")))


@query
def place_sketch(spark, folder):
    return _with_run_text(st.row_sketch(st.station_hist(_rides(spark, folder), "il")))


@query
def sketched_names(spark, folder):
    modes = st.sketched_modes(st.station_hist(_rides(spark, folder), "in"), ["name"])
    return _rounded(modes, "first/second", "mode_pct")


@query
def weak_modes(spark, folder):
    sketch = st.row_sketch(st.station_hist(_rides(spark, folder), "in"), counts="none")
    return _rounded(st.below_threshold(sketch, 0.8).select("id", "mode_pct"), "mode_pct")


@query
def pair_idx(spark, folder):
    rides = _rides(spark, folder)
    return st.pair_counts(rollup(rides, "se", "c"), st.station_index(st.stations(rides)))


@query
def pair_encode(spark, folder):
    """Inner-join encoding against the ids the pairs themselves hold."""
    se_c = rollup(_rides(spark, folder), "se", "c")
    return st.pair_counts(se_c, st.dense_index(sets.station_ids(se_c)), "inner")


@query
def pair_decode(spark, folder):
    rides = _rides(spark, folder)
    index = st.station_index(st.stations(rides))
    return st.decode_pairs(st.pair_counts(rollup(rides, "se", "c"), index), index)


@query
def pair_maps(spark, folder):
    rides = _rides(spark, folder)
    pairs = st.pair_counts(rollup(rides, "se", "c"), st.station_index(st.stations(rides)))
    return st.pair_maps(pairs)


@query
def pair_remap(spark, folder):
    """Pair maps read with ids in place of indices."""
    rides = _rides(spark, folder)
    index = st.station_index(st.stations(rides))
    return st.remap_pair_keys(st.pair_maps(st.pair_counts(rollup(rides, "se", "c"), index, "inner")), index)


@query
def pair_flow_weight(spark, folder):
    rides = _rides(spark, folder)
    named = rollup(rides, "se", "c").withColumnsRenamed(
        {"Start Station ID": "start_id", "End Station ID": "end_id", "Count": "count"}
    )
    return _rounded(st.flow_weights(named, st.stations(rides)), "weight")


@query
def station_radius(spark, folder):
    return _rounded(st.circle_radius(st.stations(_rides(spark, folder)).select("id", "ends")), "radius")


# ---- duplicates and snapshots -----------------------------------------------------------------


@query
def dedupe_rows(spark, folder):
    return dd.exact_dedupe(_republished(_rides(spark, folder)))


@query
def dup_keys(spark, folder):
    return dd.key_clashes(_republished(_rides(spark, folder)), [*TIME_COLUMNS, "Ride ID"])


@query
def dup_rows(spark, folder):
    copies = dd.keyed_copies(_republished(_rides(spark, folder)), TIME_COLUMNS)
    return copies.select("Ride ID", *TIME_COLUMNS, "Start Station ID")


@query
def once_only(spark, folder):
    single = dd.once_only(_republished(_rides(spark, folder)), TIME_COLUMNS)
    return single.select("Ride ID", *TIME_COLUMNS, "Start Station ID")


@query
def group_sizes(spark, folder):
    return dd.group_sizes(_rides(spark, folder), ["Start Station ID", "End Station ID", "Bike ID"])


@query
def freq_of_freq(spark, folder):
    return dd.frequency_of_frequencies(_republished(_rides(spark, folder)), TIME_COLUMNS)


@query
def first_ride_per_station(spark, folder):
    first = dd.first_per_key(_rides(spark, folder), ["Start Station ID"], "Start Time", "Ride ID")
    return first.select("Start Station ID", "Start Time", "Ride ID")


@query
def merge_pairs(spark, folder):
    return dd.merge_pairs(_pairs(_rides(spark, folder)), check=False)


@query
def dup_provenance(spark, folder):
    return dd.duplicate_provenance(_pairs(_rides(spark, folder)))


@query
def backfill(spark, folder):
    new, old = _snapshots(_rides(spark, folder))
    return bf.backfill(new, old)


@query
def backfill_report(spark, folder):
    new, old = _snapshots(_rides(spark, folder))
    return bf.backfill_report(new, old)


@query
def snapshot_diff(spark, folder):
    return bf.snapshot_diff(*_differing(_rides(spark, folder)))


@query
def null_profile(spark, folder):
    new, old = _snapshots(_rides(spark, folder))
    return bf.null_profile(old.drop("Ride ID"), new)


@query
def snapshot_outer(spark, folder):
    new, old = _differing(_rides(spark, folder))
    return bf.snapshot_outer(new, old, ["Birth Year", "User Type"])


@query
def snapshot_mismatches(spark, folder):
    new, old = _differing(_rides(spark, folder))
    cols = ["Birth Year", "User Type", "End Region"]
    return bf.mismatch_counts(bf.snapshot_outer(new, old, cols), cols)


@query
def reconcile(spark, folder):
    rides = _rides(spark, folder)
    return bf.reconcile(
        rollup(rides, "s", "c"), rollup(_republished(rides), "s", "c"), ["Start Station ID"], "Count"
    )


@query
def natural_join(spark, folder):
    rides = _rides(spark, folder)
    some = rides.where((F.substring("Start Station ID", -1, 1) != "3") | (F.hour("Start Time") != 4))
    return bf.natural_join(rollup(rides, "s", "c"), rollup(some, "s", "c"))


@query
def monthly_rides(spark, folder):
    """The consolidated table: late republications merged and backfilled in the affected months."""
    rides = with_part_keys(_rides(spark, folder))
    parts = rides.withColumn("src_ym", F.col("start_ym"))
    emptied = parts.where(
        F.col("stop_ym").between(202001, 202101) & (F.weekday("Start Time") == 0)
    ).withColumns(
        {
            "src_ym": F.lit(202102),
            "Gender": F.lit(0).cast("tinyint"),
            "Birth Year": F.lit(None).cast("int"),
            "Bike ID": F.lit(None).cast("int"),
        }
    )
    _, old = _snapshots(rides)
    unfilled = parts.withColumn("Birth Year", F.when(F.hour("Start Time") % 2 == 0, F.col("Birth Year")))
    return consolidated(unfilled.unionByName(emptied), old, check=False)


# ---- sets -------------------------------------------------------------------------------------


@query
def stations_added(spark, folder):
    early, late = _new_stations(_rides(spark, folder))
    return sets.keys_added(early, late, ["Start Station ID"])


@query
def stations_lost(spark, folder):
    early, late = _new_stations(_rides(spark, folder))
    return sets.keys_lost(early, late, ["Start Station ID"])


@query
def stations_kept(spark, folder):
    early, late = _new_stations(_rides(spark, folder))
    return sets.keys_kept(early, late, ["Start Station ID"])


@query
def ids_union(spark, folder):
    return sets.station_ids(_rides(spark, folder))


@query
def key_pairs_union(spark, folder):
    return sets.distinct_keys(["Start Station ID", "End Station ID"], *_halves(_rides(spark, folder)))


@query
def distinct_bikes(spark, folder):
    return sets.distinct_projection(_rides(spark, folder), ["Bike ID", "User Type"])


@query
def schema_profile(spark, folder):
    """Which columns either snapshot holds, with the rows that carry a value."""
    new, old = _snapshots(_rides(spark, folder))
    new = new.drop("Birth Year")
    old = old.drop("Ride ID")
    return sets.column_profile(new, old)


# ---- series -----------------------------------------------------------------------------------


@query
def month_series(spark, folder):
    months = _order_months(spark, folder)
    return _rounded(sr.month_totals(months, ["Rides", "Ride minutes"]), "Ride minutes", digits=4)


@query
def month_stack(spark, folder):
    return sr.month_totals(_order_months(spark, folder), "Rides", "priority")


@query
def month_pivot(spark, folder):
    return sr.month_pivot(_order_months(spark, folder), "Rides", "priority", PRIORITIES)


@query
def month_share(spark, folder):
    totals = sr.month_totals(_order_months(spark, folder), "Rides", "status")
    return _rounded(sr.month_shares(totals, "Rides"), "Rides")


@query
def filtered_series(spark, folder):
    chosen = sr.members(_order_months(spark, folder), status=["F", "P"], priority=PRIORITIES[:2])
    return sr.month_totals(chosen, "Rides")


@query
def rolling_avg(spark, folder):
    totals = sr.month_totals(_order_months(spark, folder), "Rides")
    return _rounded(sr.rolling_average(totals, 12, "Rides"), "avg")


@query
def rolling_avg_full(spark, folder):
    totals = sr.month_totals(_order_months(spark, folder), "Rides")
    return _rounded(sr.rolling_average(totals, 12, "Rides", warmup="full"), "avg")


@query
def rolling_avg_stack(spark, folder):
    pivoted = sr.month_pivot(_order_months(spark, folder), "Rides", "priority", PRIORITIES)
    long = sr.pivot_to_long(pivoted, "priority", "Rides")
    return _rounded(sr.rolling_average(long, 3, "Rides", "priority"), "avg")


@query
def annualized_growth(spark, folder):
    averages = sr.rolling_average(sr.month_totals(_order_months(spark, folder), "Rides"), 12, "Rides")
    return _rounded(sr.annualized_growth(averages, "avg"), "first_v", "last_v", "ratio", "percent", "years")


@query
def growth_by_stack(spark, folder):
    totals = sr.month_totals(_order_months(spark, folder), "Rides", "status")
    return _rounded(sr.annualized_growth(totals, "Rides", "status"), "ratio", "percent", "years")


@query
def series_clamped(spark, folder):
    return sr.clamp(sr.month_totals(_order_months(spark, folder), "Rides"), "1996-03", "1999-11")


@query
def series_last_years(spark, folder):
    return sr.clamp_preset(sr.month_totals(_order_months(spark, folder), "Rides"), "2y")


@query
def ride_month_totals(spark, folder):
    return _rounded(sr.month_totals(_labelled(spark, folder), "Ride minutes", "Region"), "Ride minutes", digits=4)


@query
def ride_type_shares(spark, folder):
    series = sr.ride_series(_labelled(spark, folder), "Rides", "Rideable Type", shares=True)
    return _rounded(series, "Rides")


@query
def ride_gender_averages(spark, folder):
    """Men's, women's and unknown riders' six-month averages, up to when gender stopped."""
    series = sr.ride_series(
        _labelled(spark, folder), "Rides", "Gender", average=6, start="2019-06", Region=["NYC", "JC"]
    )
    return _rounded(series, "avg")


# ---- exploration ------------------------------------------------------------------------------


@query
def region_matrix(spark, folder):
    return ex.region_matrix(_rides(spark, folder))


@query
def cross_region(spark, folder):
    return ex.cross_region(_rides(spark, folder))


@query
def category_share(spark, folder):
    by = {"year": F.year("Start Time"), "month": F.month("Start Time"), "region": F.col("Start Region")}
    letters = gender_letter(F.col("Gender"))
    return ex.category_share(_rides(spark, folder), letters, ["U", "M", "F"], by)


@query
def duration_hist(spark, folder):
    return ex.duration_hist(_rides(spark, folder), 60, 300)


@query
def duration_mode(spark, folder):
    return ex.hist_mode(ex.duration_hist(_rides(spark, folder), 600, None))


@query
def duration_labels(spark, folder):
    seconds = ride_seconds(F.col("Start Time"), F.col("Stop Time"))
    labels = _rides(spark, folder).select(seconds_label(seconds).alias("label"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _month_docks(rides: DataFrame) -> DataFrame:
    docks = ex.dockings(rides)
    return docks.withColumn("ym", yyyymm(F.col("time")))


@query
def station_daily(spark, folder):
    rides = _rides(spark, folder)
    docks = ex.dockings(rides)
    return ex.station_counts(docks, st.stations(rides), ["Day"], nj=True)


@query
def station_avg_weekday(spark, folder):
    rides = _rides(spark, folder)
    counts = ex.station_counts(
        ex.dockings(rides), st.stations(rides), weekdays=True, dates=("2019-02-01", "2023-02-28")
    )
    return _rounded(counts, "Avg")


@query
def station_hour_weekend(spark, folder):
    rides = _rides(spark, folder)
    counts = ex.station_counts(
        ex.dockings(rides), st.stations(rides), ["Hour", "Start"], nj=False, weekdays={5, 6},
        dates=("2019-02-01", "2023-02-28"),
    )
    return _rounded(counts, "Avg")


@query
def docking_sides(spark, folder):
    docks = ex.dockings(_rides(spark, folder)).where(F.col("Station ID").rlike("^(?:JC|HB)"))
    return docks.groupBy("Start").agg(F.count(F.lit(1)).alias("n"))


@query
def top_stations(spark, folder):
    rides = _rides(spark, folder)
    counts = ex.station_counts(ex.dockings(rides), st.stations(rides), nj=True, daily_avg=False)
    return ex.top_k(counts, 5, "Count", "Station ID")


@query
def top_station_days(spark, folder):
    rides = _rides(spark, folder)
    daily = ex.station_counts(ex.dockings(rides), st.stations(rides), ["Day"], nj=True)
    jc = daily.where(F.col("Station ID").startswith("JC"))
    return ex.top_k(jc, 50, "Count", "Station ID", "Day")


@query
def top_station_series(spark, folder):
    """Daily dockings of January 2020's five busiest New Jersey stations, dated and labelled."""
    rides = _rides(spark, folder)
    dim = st.stations(rides)
    docks = _month_docks(rides).where("ym = 202001")
    top = ex.top_k(ex.station_counts(docks, dim, nj=True, daily_avg=False), 5, "Count", "Station ID")
    daily = ex.rows_of(ex.station_counts(docks, dim, ["Day"], nj=True), top, "Station ID")
    return ex.dated(daily, 2020, 1).withColumn("Date", F.col("Date").cast("string"))


@query
def round_trip_share(spark, folder):
    return _rounded(ex.round_trip_share(_rides(spark, folder)), "share")


@query
def id_extract(spark, folder):
    return ex.station_id_parts(sets.station_ids(_rides(spark, folder)))


# ---- sources and sinks ------------------------------------------------------------------------


@query
def csv_ingest(spark, folder):
    return roundtrip.csv_ingest(spark, _raw(spark, folder))


@query
def sorted_csv(spark, folder):
    return roundtrip.sorted_csv(spark, _raw(spark, folder))


@query
def csv_months(spark, folder):
    return roundtrip.csv_months(spark, _raw(spark, folder), 202003, 202008)


@query
def zip_ingest(spark, folder):
    return roundtrip.zip_ingest(spark, _raw(spark, folder))


@query
def zip_name_types(spark, folder):
    return roundtrip.zip_name_types(spark, _raw(spark, folder))


@query
def zip_to_csv(spark, folder):
    return roundtrip.zip_to_csv(spark, _raw(spark, folder))


@query
def partition_write(spark, folder):
    parts = with_part_keys(_rides(spark, folder)).withColumn("src_ym", F.col("start_ym"))
    return roundtrip.partition_write(spark, parts)


@query
def month_rebuild(spark, folder):
    raw = _raw(spark, folder)
    return roundtrip.month_rebuild(spark, raw.withColumn("src_ym", yyyymm(F.col("started_at"))))


@query
def rollup_delta(spark, folder):
    raw = _raw(spark, folder)
    return roundtrip.rollup_delta(spark, raw.withColumn("src_ym", yyyymm(F.col("started_at"))))


@query
def ride_order(spark, folder):
    parts = with_part_keys(_rides(spark, folder)).withColumn("src_ym", F.col("start_ym"))
    return roundtrip.ride_order(spark, parts)


@query
def snapshot_scan(spark, folder):
    new, old = _differing(_rides(spark, folder))
    return roundtrip.snapshot_scan(spark, new, old, 202001)


@query
def snapshot_changes(spark, folder):
    """A snapshot published anew, in which every fourth month differs."""
    rides = _rides(spark, folder).withColumn("ym", yyyymm(F.col("Stop Time")))
    touched, hour = F.col("ym") % 4 == 0, F.hour("Start Time")
    emptied = F.when(touched & (F.minute("Start Time") % 3 == 0), F.lit(0)).otherwise(F.col("Gender")).cast("tinyint")
    new = rides.where(~(touched & (hour == 4))).withColumn("Gender", emptied)
    return roundtrip.snapshot_changes(spark, new, rides.where(~(touched & (hour == 3))))


@query
def backfill_written(spark, folder):
    new, old = _snapshots(_rides(spark, folder))
    return roundtrip.backfill_written(spark, new, old)


@query
def month_files(spark, folder):
    return roundtrip.month_files(spark, _rides(spark, folder))


@query
def latest_month(spark, folder):
    """The last month whose files are all there, when the newest lacks a region's."""
    manifest = _manifest(_rides(spark, folder))
    newest = manifest.agg(F.max("ym")).first()[0]
    months = month_regions(manifest.where((F.col("ym") < newest) | (F.col("src_region") == "NYC")))
    return months.where(F.col("ym") == latest_complete(months)).select("ym", "regions")


@query
def old_header(spark, folder):
    """The same trips under an older header, with a junk column and without those it lacked."""
    raw = _raw(spark, folder).withColumnsRenamed(OLD_SPELLING).drop("rideable_type", "gender", "member_casual", "ride_id")
    older = raw.withColumn("tripduration", F.lit("1")).withColumn("Unnamed: 0", F.lit("0")).withColumn("usertype", F.lit("Customer"))
    return conform(older, region_column="src_region").drop("Ride ID", "Start Region", "End Region")


@query
def known_bad_part(spark, folder):
    """Ride counts by part without the known bad one, the first month being published as that."""
    parts = with_part_keys(_rides(spark, folder))
    first = parts.agg(F.min("start_ym")).first()[0]
    renamed = {c: F.when(F.col(c) == first, F.lit(m)).otherwise(F.col(c)) for c, m in (("start_ym", 201307), ("stop_ym", 201307))}
    parts = parts.withColumns(renamed).withColumn("src_ym", F.lit(201306))
    return without_known_bad_parts(parts).groupBy("start_ym", "stop_ym").agg(F.count(F.lit(1)).alias("n"))


@query
def region_union(spark, folder):
    """Two regions' files of differing columns stacked."""
    rides = _rides(spark, folder)
    nyc = rides.where(F.col("Start Region") == "NYC").drop("Bike ID")
    rest = rides.where(F.col("Start Region") != "NYC").drop("Birth Year")
    stacked = union_regions(nyc, rest).groupBy("Start Region")
    return stacked.agg(F.count(F.lit(1)).alias("n"), F.count("Bike ID").alias("bikes"), F.count("Birth Year").alias("births"))


@query
def month_columns(spark, folder):
    """Columns of each month that are filled and should not be, or the reverse."""
    parts = with_part_keys(_rides(spark, folder)).withColumnRenamed("stop_ym", "ym")
    return column_surprises(parts)


@query
def station_hist_order(spark, folder):
    """The name histogram in key order."""
    return st.station_hist_sorted(_rides(spark, folder), "in")


@query
def station_hist_whole(spark, folder):
    """The whole name histogram in key order."""
    return st.station_hist_sorted(_rides(spark, folder), "in")


@query
def modal_places(spark, folder):
    return st.modal_place(st.station_hist(_rides(spark, folder), "il"))


@query
def ride_type_averages(spark, folder):
    """Six-month averages by bike type, unknown types ending with their last month."""
    return _rounded(sr.ride_series(_labelled(spark, folder), "Rides", "Rideable Type", average=6), "avg")


@query
def incremental_append(spark, folder):
    return roundtrip.incremental_append(spark, _rides(spark, folder), 202106)


@query
def json_records(spark, folder):
    return roundtrip.json_records(spark, _rides(spark, folder))


@query
def station_json(spark, folder):
    return _rounded(roundtrip.station_json(spark, _rides(spark, folder)), "lat", "lng")


@query
def pair_json(spark, folder):
    return roundtrip.pair_json(spark, _rides(spark, folder))


@query
def station_json_whole(spark, folder):
    return _rounded(roundtrip.station_json_whole(spark, _rides(spark, folder)), "lat", "lng")


@query
def pair_json_whole(spark, folder):
    return roundtrip.pair_json_whole(spark, _rides(spark, folder))


@query
def rollup_routed(spark, folder):
    return roundtrip.rollup_routed(spark, _rides(spark, folder))


@query
def stations_all_time(spark, folder):
    return _rounded(roundtrip.stations_all_time(spark, _rides(spark, folder)), "lat", "lng")


@query
def saved_formats(spark, folder):
    return roundtrip.saved_formats(spark, rollup(_rides(spark, folder), "rt", "cd"))


def _manifest(rides: DataFrame) -> DataFrame:
    """Source files the rides would come in: one per stop month and region, Hoboken's in Jersey City's."""
    region = F.when(F.col("Start Region") == "NYC", F.lit("NYC")).otherwise(F.lit("JC"))
    files = rides.groupBy(yyyymm(F.col("Stop Time")).alias("ym"), region.alias("src_region"))
    name = F.concat_ws("-", F.when(F.col("src_region") != "NYC", F.col("src_region")), F.col("ym"), F.lit("trips.zip"))
    tags = files.agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("Ride ID").cast("bigint")).alias("etag"))
    return tags.withColumn("path", name)


@query
def manifest_status(spark, folder):
    rides = _rides(spark, folder)
    stored = _manifest(rides.where((F.col("User Type") == "Subscriber") | (F.year("Start Time") < 2020)))
    current = choose_keys(_manifest(rides.where(yyyymm(F.col("Stop Time")) > 201904)), exclude="^JC-2022")
    return manifest_diff(stored, current)


@query
def months_available(spark, folder):
    manifest = _manifest(_rides(spark, folder))
    return month_regions(manifest.where("not (src_region = 'JC' and ym >= 202212)"))
