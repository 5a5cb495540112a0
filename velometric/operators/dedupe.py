"""Exact and keyed duplicates.

Every full-width step that could meet a hot key is preceded by, or consists of, an aggregation with
map-side combining, so a key repeated a billion times shuffles as a handful of partial rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velometric.schema import BACKFILL_COLUMNS, RIDE_COLUMNS, TIME_COLUMNS
from velometric.session import scratch_path


class DuplicateKeyError(AssertionError):
    """Two different rows share a key that must be unique."""


def ride_key(df: DataFrame) -> list[str]:
    """Start, stop and the ride id, or the bike id where there is no ride id."""
    extra = [c for c in ("Ride ID", "Bike ID") if c in df.columns][:1]
    return [*TIME_COLUMNS, *extra]


def exact_dedupe(rides: DataFrame) -> DataFrame:
    """One of each set of fully equal rows; partial aggregation collapses copies before the shuffle."""
    return rides.dropDuplicates()


def key_clashes(distinct_rides: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Keys held by several rows, with how many; only the key columns are read and shuffled."""
    key = list(key or ride_key(distinct_rides))
    return distinct_rides.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique_key(distinct_rides: DataFrame, key: Sequence[str] | None = None) -> None:
    """Raise when a key repeats, saying how many do, over how many rows, and the most on one key."""
    clashes = key_clashes(distinct_rides, key)
    found = clashes.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    if found["keys"]:
        shown = f"{found['keys']} keys, {found['rows']} rows, {found['most']} rows on one key"
        raise DuplicateKeyError(f"{list(key or ride_key(distinct_rides))} is not unique ({shown})")


def ride_sort(rides: DataFrame) -> DataFrame:
    """Rides ordered by key inside each partition, which is what the files need."""
    return rides.sortWithinPartitions(*ride_key(rides))


def keyed_copies(rides: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows of keys that repeat. Only repeated keys enter the join; AQE splits hot ones."""
    return rides.join(_nonnull_safe(key_clashes(rides, key), key), _same(rides, key), "left_semi")


def once_only(rides: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key occurs exactly once."""
    return rides.join(_nonnull_safe(key_clashes(rides, key), key), _same(rides, key), "left_anti")


def _nonnull_safe(keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return keys.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in key])


def _same(rides: DataFrame, key: Sequence[str]):
    """Null-safe key equality (nulls count as equal among duplicates)."""
    condition = F.lit(True)
    for c in key:
        condition = condition & F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`"))
    return condition


def group_sizes(df: DataFrame, key: Sequence[str], over: int = 1) -> DataFrame:
    """Groups larger than `over` with their row counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("dupes")).where(F.col("dupes") > over)


def frequency_of_frequencies(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many keys occur once, twice, and so on."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("times"))
    return per_key.groupBy("times").agg(F.count(F.lit(1)).alias("keys"))


def duplicate_provenance(tagged: DataFrame, key: Sequence[str] = tuple(TIME_COLUMNS)) -> DataFrame:
    """For repeated keys: which files hold how many of the rows, and how often each mix occurs.

    Counting per (key, file) first leaves at most one entry per file and key to list.
    """
    per_file = tagged.groupBy(*key, "file").agg(F.count(F.lit(1)).alias("n"))
    per_key = (
        per_file.groupBy(*key)
        .agg(
            F.sum("n").alias("rows"),
            F.sort_array(F.collect_list(F.struct("file", "n"))).alias("parts"),
        )
        .where("rows > 1")
    )
    label = F.array_join(
        F.transform("parts", lambda p: F.concat(p["file"], F.lit(":"), p["n"].cast("string"))), " "
    )
    return per_key.groupBy(label.alias("files")).agg(F.count(F.lit(1)).alias("keys"))


def _empty(prefix: str, cols: Sequence[str]):
    """All columns null, a zero gender counting as null."""
    condition = F.lit(True)
    for c in cols:
        value = F.col(f"`{prefix}{c}`")
        missing = value.isNull()
        if c == "Gender":
            missing = missing | (value == 0)
        condition = condition & missing
    return condition


def merge_pairs(
    tagged: DataFrame,
    cols: Sequence[str] = tuple(BACKFILL_COLUMNS),
    key: Sequence[str] = tuple(TIME_COLUMNS),
    check: bool = True,
) -> DataFrame:
    """Rows repeated across two files become the later file's row.

    The later row takes the earlier row's `cols` when all of its own are empty and the earlier
    row's are not. Three rows on one key are an error. Keys are counted first, with map-side combining: a hot key
    fails there, and only rows of repeated keys, a handful in real months, enter the window; the others pass by an anti
    join. With `check` the repeated keys are written first, so Spark knows their size and leaves the rides unshuffled
    where it may broadcast them; without it everything stays one lazy plan.
    """
    key = list(key)
    many = F.raise_error(F.lit("more than two rows on one key")).cast("boolean")
    counts = tagged.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    if check:
        repeated = key_clashes(tagged, key)
        path = scratch_path(tagged.sparkSession, "repeated-keys")
        repeated.write.parquet(path)
        counts = tagged.sparkSession.read.schema(repeated.schema).parquet(path)
        worst = counts.where("n > 2").limit(1).collect()
        if worst:
            raise DuplicateKeyError(f"more than two rows on one key: {worst[0].asDict()}")
    keys = _nonnull_safe(counts.where(F.when(F.col("n") > 2, many).otherwise(F.col("n") > 1)), key)
    single = tagged.join(keys, _same(tagged, key), "left_anti")
    double = tagged.join(keys, _same(tagged, key), "left_semi")
    tie = [c for c in ("Ride ID", "Bike ID") if c in tagged.columns]
    by_file = Window.partitionBy(*key).orderBy("file", *tie)
    ranked = double.withColumns(
        {
            "__nth": F.row_number().over(by_file),
            **{f"__{c}": F.lag(F.col(f"`{c}`")).over(by_file) for c in cols},
        }
    )
    take = _empty("", cols) & ~_empty("__", cols)
    merged = {c: F.when(take, F.col(f"`__{c}`")).otherwise(F.col(f"`{c}`")) for c in cols}
    later = ranked.where("__nth = 2").withColumns(merged).select(*[f"`{c}`" for c in tagged.columns])
    return single.unionByName(later)


def first_per_key(df: DataFrame, key: Sequence[str], *order) -> DataFrame:
    """First row per key in the given order; the rank limit prunes before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def ride_columns_only(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in RIDE_COLUMNS if c in df.columns])
