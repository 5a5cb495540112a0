"""Changed source months carried to the rollups as signed contributions.

A source month that is imported again takes its old contribution out of the stored rollups and puts the new one in; the rides
of other source months are not read. Months that are merged or backfilled over several sources do not add up, so these are
rolled up whole from their consolidated rides.

The stages leave notes, and every one can be repeated: the old contributions are written before the rides change, the new
rollups beside the stored ones before any of these is replaced, so a change is never taken in twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velometric.operators.rollup import STANDARD_ROLLUPS, merge_signed, rollup, signed
from velometric.plans.monthly import MONTHS, build_rides, normalized, resume_build, stop_months
from velometric.schema import BACKFILL_MONTHS
from velometric.sinks.journal import folders, fresh, note, noted, remove, whole
from velometric.sinks.writers import stored, write_by_month
from velometric.sources.files import without_known_bad_parts

TOUCHED = "ym int"


def contributions(parts: DataFrame, src_months: Sequence[int], keys: str, sums: str) -> DataFrame:
    """What source months add to a rollup outside the backfill months."""
    own = parts.where(F.col("src_ym").isin(list(src_months)) & ~F.col("stop_ym").between(*BACKFILL_MONTHS))
    return rollup(without_known_bad_parts(own), keys, sums, by_month=True)


def apply_changes(
    spark: SparkSession,
    raws: Sequence[tuple[DataFrame, str]],
    root: str,
    src_months: Sequence[int],
    old: DataFrame | None = None,
) -> None:
    """Import source months again and bring the standard rollups up to date; `src_months` without rows lose theirs.

    A change that a stopped job left open is finished first.
    """
    schema = normalized(raws).schema
    finish_changes(spark, root, schema, old)
    change = fresh(root, "_change-")
    parts = stored(spark, f"{root}/normalized", schema)
    for keys, sums in STANDARD_ROLLUPS:
        contributions(parts, src_months, keys, sums).write.parquet(f"{change}/old-{keys}_{sums}")
    had = stop_months(parts, src_months)
    note(spark, f"{change}/months", [*(("src", m) for m in src_months), *(("stop", m) for m in sorted(had))], MONTHS)
    build_rides(spark, raws, root, src_months, old)
    finish_changes(spark, root, schema, old)


def finish_changes(spark: SparkSession, root: str, schema: T.StructType, old: DataFrame | None = None) -> None:
    """Take noted changes into the rollups, after a build that was stopped on the way there."""
    resume_build(spark, root, schema, old)
    for change in folders(spark, root, "_change-"):
        # Without its months it was stopped before the rides changed.
        if whole(spark, f"{change}/months"):
            if not whole(spark, f"{change}/ready"):
                _prepare(spark, root, change, schema)
            touched = [m for (m,) in noted(spark, f"{change}/ready", TOUCHED)]
            for keys, sums in STANDARD_ROLLUPS:
                new = spark.read.parquet(f"{change}/new-{keys}_{sums}")
                write_by_month(new, f"{root}/aggregated/{keys}_{sums}", months=touched)
        remove(spark, change)


def _prepare(spark: SparkSession, root: str, change: str, schema: T.StructType) -> None:
    """Write the touched months of every rollup as they will be, then say so."""
    left = noted(spark, f"{change}/months", MONTHS)
    src_months = [m for kind, m in left if kind == "src"]
    parts = stored(spark, f"{root}/normalized", schema)
    touched = sorted({m for kind, m in left if kind == "stop"} | stop_months(parts, src_months))
    merged = [m for m in touched if BACKFILL_MONTHS[0] <= m <= BACKFILL_MONTHS[1]]
    rides = spark.read.parquet(f"{root}/rides").where(F.col("ym").isin(merged))
    for keys, sums in STANDARD_ROLLUPS:
        before = spark.read.parquet(f"{change}/old-{keys}_{sums}")
        after = contributions(parts, src_months, keys, sums)
        table = stored(spark, f"{root}/aggregated/{keys}_{sums}", after.schema).select(*after.columns)
        table = table.where(F.col("ym").isin([m for m in touched if m not in merged]))
        new = merge_signed(table, signed(before, -1), signed(after, 1))
        new.unionByName(rollup(rides, keys, sums, by_month=True)).write.mode("overwrite").parquet(f"{change}/new-{keys}_{sums}")
    remove(spark, f"{change}/ready")
    note(spark, f"{change}/ready", [(m,) for m in touched], TOUCHED)
