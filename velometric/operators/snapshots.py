"""Compare two stored snapshots part by part: digests first, rows only where these differ."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGES = ("added", "dropped", "altered")


def row_hashes(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two hashes of a row's values; nulls count by their place, which hashing alone passes over."""
    values = [F.col(f"`{c}`") for c in columns]
    nulls = F.concat_ws("", *[v.isNull().cast("int").cast("string") for v in values])
    return F.xxhash64(nulls, *values), F.xxhash64(*reversed(values), nulls)


def digest_columns(columns: Sequence[str]) -> list[Column]:
    """`rows` with sums of both hashes: the same in any order, combined on the map side, told apart by repeated rows.

    Hashes are summed up as decimals, which hold 10 ** 18 of them.
    """
    first, second = row_hashes(columns)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum(first.cast("decimal(20,0)")).alias("low"),
        F.sum(second.cast("decimal(20,0)")).alias("high"),
    ]


def part_digests(rides: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per part: `rows`, `low` and `high` over `columns` (by default all but the keys)."""
    columns = columns or [c for c in rides.columns if c not in keys]
    return rides.groupBy(*keys).agg(*digest_columns(columns))


def differing_parts(
    new: DataFrame, old: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Keys of parts that only one snapshot has or whose rows differ. Both snapshots are read once, nothing wide is moved."""
    columns = columns or common_columns(new, old, keys)
    sides = [
        part_digests(df, keys, columns).select(*keys, F.struct("rows", "low", "high").alias(side))
        for df, side in ((new, "new"), (old, "old"))
    ]
    both = sides[0].join(sides[1], list(keys), "full")
    return both.where(~F.col("new").eqNullSafe(F.col("old"))).select(*keys)


def common_columns(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in new.columns if c in old.columns and c not in keys]


def in_parts(df: DataFrame, keys: Sequence[str], parts: Sequence[tuple]) -> DataFrame:
    """Rows of these parts, as a filter on partition columns: a list for one key, else one condition a part."""
    if not parts:
        return df.limit(0)
    if len(keys) == 1:
        return df.where(F.col(keys[0]).isin([p[0] for p in parts]))
    same = [reduce(Column.__and__, [F.col(k) == v for k, v in zip(keys, part, strict=True)]) for part in parts]
    return df.where(reduce(Column.__or__, same))


def row_changes(new: DataFrame, old: DataFrame, key: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Keys whose rows differ: `change` (added, dropped or altered), `rows_new` and `rows_old`.

    One aggregation over both sides and no join, so a key that many rows share shuffles as a few partial rows.
    """
    at = [*within, *key]
    columns = common_columns(new, old, at)
    # A key alone is its whole row: then the counts tell.
    first, second = row_hashes(columns) if columns else (F.lit(0), F.lit(0))
    sides = [df.select(*at, first.alias("a"), second.alias("b"), F.lit(sign).alias("sign")) for df, sign in ((new, 1), (old, -1))]
    signed = lambda c: F.sum((F.col(c).cast("decimal(20,0)") * F.col("sign")).cast("decimal(21,0)"))
    counted = sides[0].unionAll(sides[1]).groupBy(*at).agg(
        F.count_if(F.col("sign") > 0).alias("rows_new"), F.count_if(F.col("sign") < 0).alias("rows_old"),
        signed("a").alias("a"), signed("b").alias("b"),
    )
    changed = counted.where("a <> 0 or b <> 0 or rows_new <> rows_old")
    change = F.when(F.col("rows_old") == 0, CHANGES[0]).when(F.col("rows_new") == 0, CHANGES[1]).otherwise(CHANGES[2])
    return changed.select(*at, change.alias("change"), "rows_new", "rows_old")


def snapshot_changes(new: DataFrame, old: DataFrame, parts: Sequence[str], key: Sequence[str]) -> DataFrame:
    """What changed from one stored snapshot to a later one, by part and ride key.

    `parts` are partition columns of both tables. Parts with equal digests are not read again; the driver sees the keys
    of the others, a row a part.
    """
    differing = [tuple(r) for r in differing_parts(new, old, parts).orderBy(*parts).collect()]
    return row_changes(in_parts(new, parts, differing), in_parts(old, parts, differing), key, parts)
