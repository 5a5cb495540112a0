"""Reconcile a month's new snapshot with an older one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velometric.functions.columns import lookup
from velometric.operators.dedupe import assert_unique_key
from velometric.schema import BACKFILL_COLUMNS, GENDER_CODES, TIME_COLUMNS


def _old_value(old: DataFrame, name: str) -> Column:
    """Old snapshots may spell gender as a letter and bike ids as floats."""
    kind = old.schema[name].dataType
    value = F.col(f"`{name}`")
    if name == "Gender":
        value = lookup(value, GENDER_CODES) if isinstance(kind, T.StringType) else value
        return value.cast("tinyint")
    if isinstance(kind, T.StringType):
        value = F.regexp_replace(value, r"\.0$", "")
    return value.cast("int")


def _old_keys(old: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per time key. Aggregating on the join key pre-combines repeats and leaves the
    result partitioned for the join; a repeated key is an error raised in the plan."""
    grouped = (
        old.select(*TIME_COLUMNS, *[_old_value(old, c).alias(c) for c in cols])
        .groupBy(*TIME_COLUMNS)
        .agg(F.count(F.lit(1)).alias("__n"), *[F.max(F.col(f"`{c}`")).alias(f"old {c}") for c in cols])
    )
    repeated = F.raise_error(F.lit("old snapshot repeats a start/stop time")).cast("boolean")
    return grouped.where(F.when(F.col("__n") > 1, repeated).otherwise(F.lit(True))).drop("__n")


def _joined(new: DataFrame, old: DataFrame, cols: Sequence[str]) -> DataFrame:
    return new.join(_old_keys(old, cols), TIME_COLUMNS, "left")


def _filled(name: str) -> Column:
    new, old = F.col(f"`{name}`"), F.col(f"`old {name}`")
    if name == "Gender":
        return F.coalesce(F.when(new == 0, old).otherwise(new), F.lit(0)).cast("tinyint")
    return F.coalesce(new, old).cast("int")


def backfill(
    new: DataFrame,
    old: DataFrame,
    cols: Sequence[str] = tuple(BACKFILL_COLUMNS),
    check: bool = True,
) -> DataFrame:
    """Fill birth year, bike id and gender of `new` from `old` rides with equal start and stop.

    `check` verifies first that `new` has unique times (an aggregation over the two time columns), so no time is a hot
    key of the join; a caller that has made sure of it, as `merge_pairs` does, can leave it out.
    """
    if check:
        assert_unique_key(new, TIME_COLUMNS)
    order = new.columns
    joined = _joined(new, old, cols)
    return joined.select(*[_filled(c).alias(c) if c in cols else F.col(f"`{c}`") for c in order])


def backfill_report(
    new: DataFrame, old: DataFrame, cols: Sequence[str] = tuple(BACKFILL_COLUMNS)
) -> DataFrame:
    """Per column: empty before, filled, and the filled share in percent."""
    new = new.select(*TIME_COLUMNS, *cols)

    def empty(value: Column, name: str) -> Column:
        return value == 0 if name == "Gender" else value.isNull()

    counted = _joined(new, old, cols).agg(
        *[F.count_if(empty(F.col(f"`{c}`"), c)).alias(f"before {c}") for c in cols],
        *[F.count_if(empty(_filled(c), c)).alias(f"after {c}") for c in cols],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"`before {c}`").alias("empty"),
                (F.col(f"`before {c}`") - F.col(f"`after {c}`")).alias("filled"),
            )
            for c in cols
        ]
    )
    share = F.when(F.col("empty") > 0, F.round(F.col("filled") * 100.0 / F.col("empty"), 1))
    return counted.select(F.inline(rows)).withColumn("pct", F.coalesce(share, F.lit(0.0)))


def write_backfilled(
    new: DataFrame,
    old: DataFrame,
    path: str,
    cols: Sequence[str] = tuple(BACKFILL_COLUMNS),
    check: bool = True,
) -> DataFrame:
    """Write `backfill(new, old, cols)` and give its profile: (column, before, after), `Length` counting rows.

    `before` counts the empty values of `new`, `after` those of what was written. Both are observed by the write itself, so
    neither side is read a second time for them; `check` alone takes a pass of its own over the two times. The profile
    counts rows as they reach the files, behind the last shuffle.
    """
    if check:
        assert_unique_key(new, TIME_COLUMNS)
    kinds = {f.name: f.dataType for f in new.schema.fields}
    order = new.columns
    joined = _joined(new, old, cols)
    flags = [is_empty(c, kinds[c]).alias(f"__empty {c}") for c in cols]
    filled = joined.select(*[_filled(c).alias(c) if c in cols else F.col(f"`{c}`") for c in order], *flags)
    seen = Observation()
    after = {f.name: f.dataType for f in filled.schema.fields}
    counts = [F.count_if(is_empty(c, after[c])).alias(c) for c in order]
    counts += [F.count_if(F.col(f"`__empty {c}`")).alias(f"before {c}") for c in cols]
    watched = filled.observe(seen, F.count(F.lit(1)).alias("Length"), *counts)
    watched.select(*[F.col(f"`{c}`") for c in order]).write.parquet(path)
    found = seen.get
    rows = [("Length", found["Length"], found["Length"])]
    rows += [(c, found[f"before {c}" if c in cols else c], found[c]) for c in order]
    return new.sparkSession.createDataFrame(rows, "column string, before bigint, after bigint")


def snapshot_diff(new: DataFrame, old: DataFrame, key: Sequence[str] = tuple(TIME_COLUMNS)) -> DataFrame:
    """Counts of keys added, deleted and in both; one aggregation over both sides, no join."""
    key = list(key)
    sides = new.select(*key, F.lit(1).alias("in_new"), F.lit(0).alias("in_old")).unionAll(
        old.select(*key, F.lit(0).alias("in_new"), F.lit(1).alias("in_old"))
    )
    per_key = sides.groupBy(*key).agg(F.max("in_new").alias("n"), F.max("in_old").alias("o"))
    return per_key.agg(
        F.count_if(F.expr("n = 1 and o = 0")).alias("adds"),
        F.count_if(F.expr("n = 0 and o = 1")).alias("dels"),
        F.count_if(F.expr("n = 1 and o = 1")).alias("both"),
    )


def is_empty(name: str, kind: T.DataType) -> Column:
    """Null, or what stands for an unknown gender or bike type."""
    value = F.col(f"`{name}`")
    if name == "Gender":
        return value == ("U" if isinstance(kind, T.StringType) else 0)
    return value == "unknown" if name == "Rideable Type" else value.isNull()


def _empty_counts(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Nulls per column (zero or `U` gender and unknown rideable count), plus the row count."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    counts = [F.count(F.lit(1)).alias("Length")]
    for c in columns:
        counts.append((F.count_if(is_empty(c, kinds[c])) if c in kinds else F.count(F.lit(1))).alias(c))
    one_row = df.agg(*counts)
    names = ["Length", *columns]
    stacked = F.array(
        *[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("n")) for n in names]
    )
    return one_row.select(F.inline(stacked)).withColumn("side", F.lit(label))


def null_profile(old: DataFrame, new: DataFrame, nonzero_only: bool = True) -> DataFrame:
    """Empty counts of two snapshots side by side; an absent column counts as empty throughout."""
    columns = [*new.columns, *[c for c in old.columns if c not in new.columns]]
    both = _empty_counts(old, "old", columns).unionAll(_empty_counts(new, "new", columns))
    wide = both.groupBy("column").agg(
        F.max(F.when(F.col("side") == "old", F.col("n"))).alias("old"),
        F.max(F.when(F.col("side") == "new", F.col("n"))).alias("new"),
    )
    return wide.where("old <> 0 or new <> 0") if nonzero_only else wide


def snapshot_outer(new: DataFrame, old: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full outer merge on the times with both versions of `cols`."""
    left = new.select(*TIME_COLUMNS, *[F.col(f"`{c}`").alias(f"{c} new") for c in cols])
    right = old.select(*TIME_COLUMNS, *[F.col(f"`{c}`").alias(f"{c} old") for c in cols])
    return left.withColumn("in_new", F.lit(True)).join(
        right.withColumn("in_old", F.lit(True)), TIME_COLUMNS, "full"
    )


def mismatch_counts(merged: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: rows in both snapshots whose values differ (nulls equal each other)."""
    matched = merged.where("in_new and in_old")
    one_row = matched.agg(
        *[
            F.count_if(~F.col(f"`{c} new`").eqNullSafe(F.col(f"`{c} old`"))).alias(c)
            for c in cols
        ]
    )
    stacked = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("differs")) for c in cols]
    )
    return one_row.select(F.inline(stacked))


def reconcile(left: DataFrame, right: DataFrame, key: Sequence[str], measure: str) -> DataFrame:
    """Equi-join of two rollups, keeping keys whose measure differs."""
    a = left.select(*key, F.col(f"`{measure}`").alias(f"{measure}_x"))
    b = right.select(*key, F.col(f"`{measure}`").alias(f"{measure}_y"))
    return a.join(b, list(key)).where(F.col(f"`{measure}_x`") != F.col(f"`{measure}_y`"))


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on every column of the left side."""
    return left.join(right, left.columns)
