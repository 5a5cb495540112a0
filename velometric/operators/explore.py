"""Ad-hoc analyses: region matrix, shares, duration histograms, docking counts, top-k."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velometric.functions.columns import (
    lookup,
    month_gender_label,
    ride_seconds,
    seconds_label,
    starts_like,
    weekday_label,
)
from velometric.operators.stations import ride_ends

# Station id prefixes of the New Jersey side.
NJ_PREFIXES = ("JC", "HB")


def value_counts(df: DataFrame, cols: Sequence[str], name: str = "Count") -> DataFrame:
    """Joint counts of non-null values."""
    return df.na.drop(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def region_matrix(rides: DataFrame, regions: Sequence[str] = ("NYC", "JC", "HB")) -> DataFrame:
    """Start region rows by end region columns; absent pairs are null."""
    counts = value_counts(rides, ["Start Region", "End Region"])
    return counts.groupBy("Start Region").pivot("End Region", list(regions)).agg(F.sum("Count"))


def cross_region(rides: DataFrame) -> DataFrame:
    """Counts of rides between different regions."""
    return value_counts(
        rides.where(F.col("Start Region") != F.col("End Region")), ["Start Region", "End Region"]
    )


def category_share(rides: DataFrame, category: Column, values: Sequence[str], by: dict[str, Column]) -> DataFrame:
    """Counts and percentages (one decimal, halves to even) of each category value per group."""
    tagged = rides.select(*[e.alias(n) for n, e in by.items()], category.alias("__cat"))
    tagged = tagged.na.drop()
    wide = tagged.groupBy(*by).pivot("__cat", list(values)).agg(F.count(F.lit(1)))
    total = sum((F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in values), F.lit(0))
    return wide.withColumns({f"{v}%": F.bround(F.col(f"`{v}`") / total * 100, 1) for v in values})


def duration_hist(rides: DataFrame, bucket: int, n: int | None = None) -> DataFrame:
    """Rides per duration bucket, ascending, with a text label; `n` asks for the first n that occur."""
    seconds = ride_seconds(F.col("Start Time"), F.col("Stop Time"))
    counts = (
        rides.select(F.floor(seconds / bucket).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("# Rides"))
        .withColumn("Duration", seconds_label(F.col("bucket") * bucket))
        .orderBy("bucket")
    )
    return counts.limit(n) if n else counts


def hist_mode(hist: DataFrame, count: str = "# Rides") -> DataFrame:
    """Rows of a histogram that reach its maximum (the histogram has at most a day of buckets)."""
    top = F.max(F.col(f"`{count}`")).over(Window.partitionBy())
    return hist.withColumn("__top", top).where(F.col(f"`{count}`") == F.col("__top")).drop("__top")


def dockings(rides: DataFrame) -> DataFrame:
    """Starts and ends as rows with their own time's day, weekday and hour."""
    columns = [("id", "Station ID")]

    ends = ride_ends(
        rides.withColumnsRenamed({"Start Time": "__start", "Stop Time": "__stop"}),
        columns,
        F.col("__start"),
        F.col("__stop"),
    )
    at = F.when(F.col("start"), F.col("__start")).otherwise(F.col("__stop"))
    return ends.select(
        F.col("id").alias("Station ID"),
        at.alias("time"),
        F.col("start").alias("Start"),
        F.dayofmonth(at).alias("Day"),
        F.weekday(at).alias("Weekday"),
        F.hour(at).alias("Hour"),
    ).where("`Station ID` is not null")


def weekday_filter(weekday: Column, weekdays: bool | Collection[int] | None) -> Column:
    """True keeps Monday to Friday, False the weekend, a set exactly those days."""
    if weekdays is None:
        return F.lit(True)
    if weekdays is True:
        return weekday < 5
    if weekdays is False:
        return weekday >= 5
    return weekday.isin(sorted(set(weekdays)))


def qualifying_days(first: str, last: str, weekdays: bool | Collection[int] | None = None) -> Column:
    """Number of calendar days of the closed date range that pass the weekday filter."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return F.size(F.filter(days, lambda d: weekday_filter(F.weekday(d), weekdays)))


def station_counts(
    docks: DataFrame,
    dim: DataFrame,
    keys: Sequence[str] = (),
    nj: bool | None = None,
    weekdays: bool | Collection[int] | None = None,
    daily_avg: bool | None = None,
    dates: tuple[str, str] | None = None,
) -> DataFrame:
    """Dockings per station and optional Day/Weekday/Hour/Start, with the station's name.

    `nj` keeps or excludes the New Jersey stations. Daily averages divide by the number of
    qualifying days in `dates` and cannot be combined with Day or Weekday keys.
    """
    daily = {"Day", "Weekday"} & set(keys)
    if daily_avg is None:
        daily_avg = not daily
    if daily_avg and daily:
        raise ValueError("daily averages need counts that are not grouped by day")
    if daily_avg and not dates:
        raise ValueError("daily averages need the date range")
    chosen = docks.where(weekday_filter(F.col("Weekday"), weekdays))
    if nj is not None:
        there = F.expr(starts_like("`Station ID`", *NJ_PREFIXES))
        chosen = chosen.where(there if nj else ~there)
    counts = chosen.groupBy("Station ID", *keys).agg(F.count(F.lit(1)).alias("Count"))
    names = dim.select(F.col("id").alias("Station ID"), F.col("name").alias("Station Name"))
    out = counts.join(names, "Station ID").select("Station ID", "Station Name", *keys, "Count")
    if daily_avg:
        out = out.withColumn("Avg", F.col("Count") / qualifying_days(*dates, weekdays))
    return out


def top_k(df: DataFrame, k: int, measure: str, *ties: str) -> DataFrame:
    """The k rows of largest measure; ties in key order."""
    return df.orderBy(F.desc(measure), *ties).limit(k)


def rows_of(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among a small chosen set."""
    return df.join(keys.select(key), key, "left_semi")


def dated(df: DataFrame, year: int, month: int) -> DataFrame:
    """Calendar date and weekday/weekend label from a day number."""
    date = F.make_date(F.lit(year), F.lit(month), F.col("Day"))
    return df.withColumn("Date", date).withColumn("Kind", weekday_label(F.weekday("Date")))


def round_trip_share(rides: DataFrame) -> DataFrame:
    """Per start month, the share of rides ending at the station name they started from."""
    same = F.col("Start Station Name") == F.col("End Station Name")
    return rides.groupBy(
        F.year("Start Time").alias("Year"), F.month("Start Time").alias("Month")
    ).agg(
        F.count_if(same).alias("same"),
        F.count(F.lit(1)).alias("rides"),
        (F.count_if(same) / F.count(F.lit(1))).alias("share"),
    )


def station_id_parts(ids: DataFrame, column: str = "id") -> DataFrame:
    """Id and region prefix extracted from New Jersey ids; other ids are left out."""
    pattern = r"((JC|HB)\d+)"
    value = F.col(column)
    found = ids.where(value.rlike(pattern))
    return found.select(
        column,
        F.regexp_extract(value, pattern, 1).alias("station"),
        F.regexp_extract(value, pattern, 2).alias("region"),
    )


def grand_totals(table: DataFrame, measure: str, *distinct: str) -> DataFrame:
    """Sum of a measure and distinct counts of columns."""
    return table.agg(
        F.sum(measure).alias("total"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"distinct {c}") for c in distinct]
    )


# Rank of unknown, women and men.
GENDER_RANK = {0: 0, 2: 1, 1: 2}


def month_gender_totals(ymg_c: DataFrame) -> DataFrame:
    """Counts per month and gender with the `Jan-M` label and the unknown/women/men order."""
    start = F.make_date(F.col("Start Year"), F.col("Start Month"), F.lit(1))
    return ymg_c.select(
        "Start Year",
        "Start Month",
        "Gender",
        month_gender_label(start, F.col("Gender")).alias("mg"),
        lookup(F.col("Gender"), GENDER_RANK).alias("rank"),
        "Count",
    )
