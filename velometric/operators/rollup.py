"""Group rides by any mix of keys and sum counts and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velometric.functions.columns import lookup, ride_seconds, yyyymm
from velometric.schema import COMPACT_CODES, DASHBOARD_REGION, DASHBOARD_USER

def _start_time() -> Column:
    return F.col("Start Time")


# Key letter -> output columns with their expressions, in output order.
ROLLUP_KEYS = {
    "r": lambda: {"Region": F.col("Start Region")},
    "y": lambda: {"Start Year": F.year(_start_time())},
    "m": lambda: {"Start Month": F.month(_start_time())},
    "d": lambda: {"Start Day": F.dayofmonth(_start_time())},
    "w": lambda: {"Start Weekday": F.weekday(_start_time())},
    "h": lambda: {"Start Hour": F.hour(_start_time())},
    "g": lambda: {"Gender": F.col("Gender")},
    "t": lambda: {"User Type": F.col("User Type")},
    "b": lambda: {"Rideable Type": F.col("Rideable Type")},
    "s": lambda: {"Start Station ID": F.col("Start Station ID")},
    "e": lambda: {"End Station ID": F.col("End Station ID")},
    "n": lambda: {"Start Station Name": F.col("Start Station Name")},
    "N": lambda: {"End Station Name": F.col("End Station Name")},
    "l": lambda: {
        "Start Station Latitude": F.col("Start Station Latitude"),
        "Start Station Longitude": F.col("Start Station Longitude"),
    },
    "L": lambda: {
        "End Station Latitude": F.col("End Station Latitude"),
        "End Station Longitude": F.col("End Station Longitude"),
    },
}
ROLLUP_SUMS = {
    "c": lambda wrap: F.count(F.lit(1)).alias("Count"),
    "d": lambda wrap: F.sum(
        ride_seconds(F.col("Start Time"), F.col("Stop Time"), wrap)
    ).alias("Duration"),
}
# The rollups kept as tables, per stop month.
STANDARD_ROLLUPS = [("s", "c"), ("e", "c"), ("se", "c"), ("ymrgtb", "cd")]


def _letters(text: str, known: dict) -> list[str]:
    unknown = set(text) - set(known)
    if unknown or len(set(text)) != len(text) or not text:
        raise ValueError(f"bad keys {text!r}; known: {''.join(known)}")
    return [k for k in known if k in text]


def key_columns(keys: str) -> list[str]:
    """Output key columns of a rollup, in order."""
    return [c for k in _letters(keys, ROLLUP_KEYS) for c in ROLLUP_KEYS[k]()]


def rollup(
    rides: DataFrame,
    keys: str,
    sums: str = "c",
    by_month: bool = False,
    keep_nulls: bool = False,
    wrap_days: bool = True,
) -> DataFrame:
    """Sum rides (`c`) and duration seconds (`d`) by the given key letters.

    Rides belong to their start region and start time. Rows with a null key are left out unless
    `keep_nulls`. `by_month` adds the stop month `ym`, the unit the rollup tables are kept in.
    """
    exprs = {c: e for k in _letters(keys, ROLLUP_KEYS) for c, e in ROLLUP_KEYS[k]().items()}
    if by_month:
        exprs = {"ym": yyyymm(F.col("Stop Time")), **exprs}
    filtered = rides
    if not keep_nulls:
        for e in exprs.values():
            filtered = filtered.where(e.isNotNull())
    totals = [ROLLUP_SUMS[s](wrap_days) for s in _letters(sums, ROLLUP_SUMS)]
    return filtered.groupBy(*[e.alias(c) for c, e in exprs.items()]).agg(*totals)


def resum(table: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of an existing rollup over fewer keys."""
    sums = [c for c in ("Count", "Duration") if c in table.columns]
    return table.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def signed(table: DataFrame, sign: int) -> DataFrame:
    """A rollup's counts and sums times +1 or -1."""
    return table.withColumns({c: F.col(c) * sign for c in ("Count", "Duration") if c in table.columns})


def merge_signed(table: DataFrame, *changes: DataFrame) -> DataFrame:
    """A rollup with signed changes of the same columns added; keys whose count comes to nothing go.

    Counts and sums invert, so an old contribution is taken out without the rides of other sources. One aggregation with
    map-side combination; a count below zero means that the change is not of this table and is an error.
    """
    sums = [c for c in ("Count", "Duration") if c in table.columns]
    keys = [c for c in table.columns if c not in sums]
    rows = table
    for change in changes:
        rows = rows.unionByName(change.select(*table.columns))
    total = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where(F.col("Count") != 0)
    message = F.concat(F.lit("a change takes out more rides than there are: "), F.to_json(F.struct(*keys)))
    return total.withColumn("Count", F.when(F.col("Count") < 0, F.raise_error(message).cast("long")).otherwise(F.col("Count")))


def dashboard_records(ymrgtb_cd: DataFrame) -> DataFrame:
    """Relabelled, renamed and sorted records; an unknown user type is an error."""
    user = lookup(
        F.col("User Type"),
        DASHBOARD_USER,
        F.raise_error(F.concat(F.lit("unknown user type "), F.col("User Type"))).cast("string"),
    )
    named = ymrgtb_cd.withColumns(
        {
            "Region": lookup(F.col("Region"), DASHBOARD_REGION, F.col("Region")),
            "User Type": user,
        }
    ).withColumnsRenamed({"Start Year": "Year", "Start Month": "Month"})
    first = ["Year", "Month", "Region", "User Type", "Rideable Type", "Gender"]
    rest = sorted(set(named.columns) - set(first) - {"ym"})
    # A record can come from two stop-month tables; the dashboard sums them later.
    return named.select(*first, *rest).orderBy(*first)


def compact_records(records: DataFrame) -> DataFrame:
    """Short column names, dimension values as ordinals and two-digit years."""
    coded = records.select(
        F.col("Region").alias("r"),
        (F.col("Year") - 2000).alias("y"),
        F.col("Month").alias("m"),
        F.col("Gender").alias("g"),
        F.col("User Type").alias("t"),
        F.col("Rideable Type").alias("b"),
        F.col("Count").alias("c"),
        F.col("Duration").alias("d"),
    )
    return coded.withColumns(
        {
            k: lookup(F.col(k), {v: i for i, v in enumerate(values)})
            for k, values in COMPACT_CODES.items()
        }
    )
