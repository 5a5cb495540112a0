"""Set operations between tables, key sets and schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keys_added(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys in `after` that `before` lacks."""
    return after.select(*key).distinct().join(before.select(*key).distinct(), list(key), "left_anti")


def keys_lost(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    return keys_added(after, before, key)


def keys_kept(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    return after.select(*key).distinct().join(before.select(*key).distinct(), list(key), "left_semi")


def station_ids(df: DataFrame, start: str = "Start Station ID", end: str = "End Station ID") -> DataFrame:
    """Distinct non-null ids of both ride ends, from one scan."""
    both = df.select(F.explode(F.array(F.col(f"`{start}`"), F.col(f"`{end}`"))).alias("id"))
    return both.where("id is not null").distinct()


def distinct_keys(key: Sequence[str], *frames: DataFrame) -> DataFrame:
    """Distinct keys over several tables; each is reduced before they meet."""
    first, *rest = [f.select(*key).distinct() for f in frames]
    for other in rest:
        first = first.unionAll(other)
    return first.distinct()


def distinct_projection(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def schema_diff(left: Sequence[str], right: Sequence[str]) -> dict[str, list[str]]:
    """Columns only left, only right and in both, in their own order."""
    return {
        "extra": [c for c in left if c not in set(right)],
        "missing": [c for c in right if c not in set(left)],
        "common": [c for c in left if c in set(right)],
    }


def column_profile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every column of either side: whether it is extra, missing or common, and how many rows of each side fill it."""
    kinds = {c: kind for kind, columns in schema_diff(left.columns, right.columns).items() for c in columns}

    def filled(df: DataFrame, name: str) -> DataFrame:
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias(name)) for c in df.columns]
        return counts.select(F.inline(F.array(*cells)))

    both = filled(left, "left").join(filled(right, "right"), "column", "full")
    names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return both.select("column", F.element_at(names, F.col("column")).alias("side"), "left", "right")
