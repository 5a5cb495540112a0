"""Bring raw trip records of any header era to the canonical ride schema."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velometric.functions.columns import (
    clean_station_id,
    null_tokens_removed,
    out_of_system,
    quoted,
    region_matches,
    region_of,
    trip_time,
    yyyymm,
)
from velometric.schema import (
    DROPPED_COLUMNS,
    GENDER_CODES,
    HEADER_ALIASES,
    MEMBER_TO_USER,
    NO_REGION,
    REGION_PATTERNS,
    RIDE_COLUMNS,
    RIDE_SCHEMA,
    RIDEABLE_TYPES,
    UNFILLED_MONTHS,
    USER_TYPES,
    squash_header,
)


def rename_headers(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Canonical column names; junk columns go, unknown ones are reported and dropped."""
    picked, unknown = [], []
    for name in df.columns:
        if name in DROPPED_COLUMNS:
            continue
        target = HEADER_ALIASES.get(squash_header(name))
        source = F.col(f"`{name}`")
        if target:
            picked.append(source.alias(target))
        elif name in RIDE_COLUMNS or name in keep:
            picked.append(source)
        else:
            unknown.append(name)
    if unknown:
        warnings.warn(f"dropping unexpected columns: {', '.join(unknown)}", stacklevel=2)
    return df.select(*picked)


def nulls_from_tokens(df: DataFrame) -> DataFrame:
    """Null spellings of text sources become nulls in every string column."""
    return df.select(
        *[
            null_tokens_removed(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def conform(
    raw: DataFrame,
    source_region: str | None = None,
    region_column: str | None = None,
    keep: Sequence[str] = (),
    drop_out_of_system: bool = True,
    keep_open_ended: bool = False,
    strict_none: bool = False,
    rules: Mapping[str, Sequence[str]] = REGION_PATTERNS,
) -> DataFrame:
    """Rename, default, decode, enforce enum domains, classify regions, cast and order columns.

    The region of the source file is given as `source_region`, or per row as `region_column`.
    `keep` passes source columns (such as month tags) through. `keep_open_ended` keeps rides
    without an end station and gives them their start region; by default they go, as do rides
    touching the operator's own stations. Every step is a narrow projection or filter.
    """
    carried = list(dict.fromkeys([*keep, *([region_column] if region_column else [])]))
    df = rename_headers(raw, keep=carried)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if "Member/Casual" in kinds and "User Type" in kinds:
        raise ValueError("both member_casual and user type columns are present")
    values = {name: f"`{name}`" for name in kinds}

    def cases(name: str, table: Mapping) -> str:
        return " ".join(f"when `{name}` = '{k}' then {v!r}" for k, v in table.items())

    for name in ("Start Time", "Stop Time"):
        if kinds.get(name) == "string":
            values[name] = trip_time(f"`{name}`")
    if kinds.get("Gender") == "string":
        values["Gender"] = f"case {cases('Gender', GENDER_CODES)} else cast(`Gender` as tinyint) end"
    values.setdefault("Gender", "0")
    if "Rideable Type" in kinds:
        domain = {"docked_bike": "classic_bike"} | {v: v for v in RIDEABLE_TYPES}
        values["Rideable Type"] = f"case {cases('Rideable Type', domain)} end"
    values.setdefault("Rideable Type", "'unknown'")
    if "Member/Casual" in kinds:
        values["User Type"] = f"case {cases('Member/Casual', MEMBER_TO_USER)} end"
    elif "User Type" in kinds:
        values["User Type"] = f"case {cases('User Type', {v: v for v in USER_TYPES})} end"
    for name in ("Start Station ID", "End Station ID"):
        text = f"`{name}`" if kinds[name] == "string" else f"cast(`{name}` as string)"
        values[name] = clean_station_id(text)
    for name in ("Birth Year", "Bike ID"):
        if kinds.get(name) == "string":
            values[name] = f"cast(`{name}` as double)"

    types = {f.name: f.dataType.simpleString() for f in RIDE_SCHEMA.fields}
    passed = [f"`{c}`" for c in carried]
    typed = df.selectExpr(
        *[
            f"cast({values.get(c, 'null')} as {t}) as `{c}`"
            for c, t in types.items()
            if c not in ("Start Region", "End Region")
        ],
        *passed,
    )
    start_id, end_id = "`Start Station ID`", "`End Station ID`"
    if drop_out_of_system:
        # Decided on the ids, one pattern per end, before regions are worked out; a region that
        # stays unknown (unrecognised station) does not remove its ride.
        end_out = out_of_system(end_id, rules, strict_none, missing=not keep_open_ended)
        typed = typed.where(f"not {out_of_system(start_id, rules, strict_none)} and not {end_out}")
    source = f"`{region_column}`" if region_column else quoted(source_region) if source_region else None
    start = region_of(start_id, source, rules, strict_none)
    end = region_of(end_id, source, rules, strict_none)
    if keep_open_ended:
        end = f"coalesce(nullif({end}, '{NO_REGION}'), if({end} = '{NO_REGION}', {start}, null))"
    regions = {"Start Region": f"{start} as `Start Region`", "End Region": f"{end} as `End Region`"}
    return typed.selectExpr(
        *[regions.get(c, f"`{c}`") for c in RIDE_COLUMNS], *[f"`{c}`" for c in keep]
    )


def with_part_keys(rides: DataFrame) -> DataFrame:
    """Month keys that partition the ride table: start and stop month. A missing time is an error."""

    def month(name: str) -> Column:
        missing = F.raise_error(F.lit(f"ride without {name}")).cast("int")
        return F.coalesce(yyyymm(F.col(name)), missing)

    return rides.withColumns({"start_ym": month("Start Time"), "stop_ym": month("Stop Time")})


def column_surprises(rides: DataFrame, month: str = "ym") -> DataFrame:
    """(month, column) where a column is filled and should not be (`filled` > 0) or the reverse."""
    columns = [c for c in RIDE_COLUMNS if c in rides.columns]
    counts = rides.groupBy(month).agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("filled")) for c in columns]
    long = counts.select(month, F.inline(F.array(*cells)))
    unfilled = F.lit(False)
    for name, (begin, end) in UNFILLED_MONTHS.items():
        inside = F.col("column") == name
        inside = inside & (F.col(month) >= begin) if begin else inside
        unfilled = unfilled | (inside & (F.col(month) < end) if end else inside)
    return long.where(unfilled == (F.col("filled") > 0))


def ambiguous_stations(
    rides: DataFrame, rules: Mapping[str, Sequence[str]] = REGION_PATTERNS
) -> DataFrame:
    """Station ids matching more than one region (none is expected); ids are made distinct first."""
    ids = rides.select(
        F.explode(F.array(F.col("Start Station ID"), F.col("End Station ID"))).alias("id")
    ).where(F.col("id").isNotNull())
    found = ids.distinct().withColumn("regions", F.expr(region_matches("id", rules)))
    return found.where(F.size("regions") > 1)


def union_regions(*frames: DataFrame) -> DataFrame:
    """Stack frames of differing columns; absent columns become null."""
    first, *rest = frames
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
