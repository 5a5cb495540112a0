"""Ride tables, sorted CSV and JSON documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velometric.operators.conform import conform, with_part_keys
from velometric.operators.dedupe import ride_key
from velometric.schema import HEADER_ALIASES, TIME_COLUMNS, squash_header
from velometric.sinks.journal import exists, folders, fresh, note, noted, remove, whole

PART_KEYS = ["src_ym", "start_ym", "stop_ym"]


def stored(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, empty where it has not been written or has no part left."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _parts(table: DataFrame, keys: Sequence[str]) -> set[tuple]:
    """Partitions that hold rows: one small row each."""
    return {tuple(r) for r in table.select(*keys).distinct().collect()}


def _swap_in(
    df: DataFrame,
    root: str,
    keys: Sequence[str],
    order: Sequence[str] = (),
    replaced: Sequence[int] | None = None,
    verify: Callable[[DataFrame], None] | None = None,
) -> None:
    """Write partitions to a staging table, verify that, then overwrite the table's from it.

    `replaced` names values of the first key whose partitions go when nothing was written for them; by default only the
    written ones are replaced. The table is written by Spark's own committer with dynamic overwrite. The staging table is
    removed last: until then every row is in one place that is whole, and a failure leaves it to start again from.
    Partitions without new rows are removed only after that commit. A note of what goes where is written before the table is
    touched; the next write to this root finishes what such a note left open.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    finish_swaps(spark, root, keys, order, df.schema)
    staging = fresh(root, "_staging-")

    def arranged(rows: DataFrame) -> DataFrame:
        return rows.hint("rebalance", *keys).sortWithinPartitions(*keys, *order)

    arranged(df).write.partitionBy(*keys).parquet(staging)
    staged = spark.read.schema(df.schema).parquet(staging)
    if verify:
        try:
            verify(staged)
        except BaseException:
            remove(spark, staging)
            raise
    now = _parts(staged, keys)
    emptied: set[tuple] = set()
    if replaced is not None:
        old = stored(spark, root, df.schema).where(F.col(keys[0]).isin(list(replaced)))
        emptied = _parts(old, keys) - now
    paths = ["/".join(f"{k}={v}" for k, v in zip(keys, part, strict=True)) for part in sorted(emptied)]
    swap = fresh(root, "_swap-")
    note(spark, swap, [(staging.rsplit("/", 1)[1], None), *((None, path) for path in paths)], SWAP)
    _swap(arranged(staged), root, keys, paths)
    remove(spark, staging)
    remove(spark, swap)


SWAP = "staging string, emptied string"


def _swap(rows: DataFrame, root: str, keys: Sequence[str], emptied: Sequence[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root)
    for part in emptied:
        remove(rows.sparkSession, f"{root}/{part}")


def finish_swaps(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str], schema: T.StructType) -> None:
    """Repeat swaps that a stopped job left open; their staging tables are whole. What was never noted goes."""
    for swap in folders(spark, root, "_swap-"):
        if whole(spark, swap):
            rows = noted(spark, swap, SWAP)
            staging = next(f"{root}/{name}" for name, _ in rows if name)
            if exists(spark, staging):
                staged = spark.read.schema(schema).parquet(staging)
                staged = staged.hint("rebalance", *keys).sortWithinPartitions(*keys, *order)
                _swap(staged, root, keys, [part for _, part in rows if part])
                remove(spark, staging)
        remove(spark, swap)
    for staging in folders(spark, root, "_staging-"):
        remove(spark, staging)


def write_ride_parts(rides: DataFrame, root: str, src_months: Sequence[int]) -> None:
    """Write rides below `root` by source, start and stop month, replacing whole source months.

    Rows are rebalanced by part (adaptive execution splits large months and merges small ones) and
    sorted inside files. Parts that a source month no longer produces disappear.
    """
    if "stop_ym" not in rides.columns:
        rides = with_part_keys(rides)
    own = rides.where(F.col("src_ym").isin(list(src_months)))
    _swap_in(own, root, PART_KEYS, ride_key(own), replaced=src_months)


def repartition_snapshot(rides: DataFrame, root: str, src_ym: int) -> None:
    """Conform an existing one-file month again and split it into its parts."""
    write_ride_parts(conform(rides).withColumn("src_ym", F.lit(src_ym)), root, [src_ym])


def write_by_month(
    table: DataFrame,
    path: str,
    month: str = "ym",
    verify: Callable[[DataFrame], None] | None = None,
    months: Sequence[int] | None = None,
) -> None:
    """Replace the months present in `table`, leaving the others.

    `months` are replaced also when `table` has no row of them. `verify` sees the written rows before they replace
    anything and raises to call the write off.
    """
    _swap_in(table, path, [month], replaced=months, verify=verify)


def save(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False, **options) -> None:
    """Write unless the output exists; `overwrite` replaces it."""
    df.write.mode("overwrite" if overwrite else "ignore").options(**options).format(fmt).save(path)


def csv_sort_columns(columns: Sequence[str]) -> list[str]:
    """The header's spellings of the ride key: start, stop and ride id, or bike id without one."""
    spelt = {HEADER_ALIASES.get(squash_header(c), c): c for c in columns}
    key = [*TIME_COLUMNS, next((c for c in ("Ride ID", "Bike ID") if c in spelt), "Ride ID")]
    if missing := [c for c in key if c not in spelt]:
        raise ValueError(f"no column for {missing} among {list(columns)}")
    return [spelt[c] for c in key]


def write_sorted_csv(
    raw: DataFrame, path: str, expected_rows: int | None = None, records: str | None = None, spread: bool = False
) -> int:
    """Gzipped CSV in global order of start, stop and id; returns the rows written.

    The order comes from a range partitioning, so part files follow each other and no task sorts
    more than its range; the input position as last sort column keeps ties in order and lets many
    copies of one key spread over several ranges. A row count other than `expected_rows` is an error, as is one other
    than the sum of the column `records`, which is not written: the sources' own record counts, in the same pass.
    The range bounds are sampled by a pass of their own over `raw`; `spread` rebalances the rows before it, so that a costly
    scan is run once and both passes read its shuffle.
    """
    seen = Observation()
    columns = [c for c in raw.columns if c != records]
    keys = [F.col(f"`{c}`") for c in csv_sort_columns(columns)]
    placed = raw.withColumn("__at", F.monotonically_increasing_id())
    placed = placed.hint("rebalance") if spread else placed
    ordered = placed.orderBy(*keys, "__at").drop("__at")
    # Counted after the sort: the range bounds are sampled by an extra pass over what is below it.
    told = F.sum(F.col(records) if records else F.lit(None).cast("bigint"))
    counted = ordered.observe(seen, F.count(F.lit(1)).alias("rows"), told.alias("told"))
    counted.select(*[F.col(f"`{c}`") for c in columns]).write.option("header", True).option("compression", "gzip").csv(path)
    rows, told = seen.get["rows"], seen.get["told"] or 0
    for expected in ([expected_rows] if expected_rows is not None else []) + ([told] if records else []):
        if rows != expected:
            raise ValueError(f"wrote {rows} rows, expected {expected}")
    return rows


def nonempty_lines(spark: SparkSession, path: str) -> int:
    """Data lines of CSV files with one header line each."""
    lines = spark.read.text(path).where("value <> ''")
    files = F.count_distinct(F.col("_metadata.file_path"))
    counts = lines.agg((F.count(F.lit(1)) - files).alias("n"))
    return counts.first()["n"]


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, one record each."""
    df.write.json(path)


def json_entry(key: Column, value: Column) -> Column:
    """`"key":value` text of one object entry; `value` is JSON text."""
    quoted = F.regexp_replace(F.to_json(F.struct(key.cast("string").alias("k"))), r'^\{"k":|\}$', "")
    return F.concat(quoted, F.lit(":"), value)


def write_json_object(df: DataFrame, key: str, value: Column, path: str) -> None:
    """One JSON object spread over part files: concatenated in name order they are the document.

    Entries are range-partitioned by key, which is unique, and written one per line, each after the first with a leading comma, between a `{` and a `}` line. Nothing
    is gathered; the only lookup is the smallest key.
    """
    entries = df.select(F.col(key).alias("at"), json_entry(F.col(key), value).alias("value"))
    first = df.agg(F.min(key)).first()[0]
    leading = entries.select(
        F.lit(1).alias("line"),
        "at",
        F.when(F.col("at") == first, F.col("value"))
        .otherwise(F.concat(F.lit(","), F.col("value")))
        .alias("value"),
    )
    braces = df.sparkSession.createDataFrame([(0, "{"), (2, "}")], "line int, value string")
    whole = leading.unionByName(braces, allowMissingColumns=True).orderBy("line", "at")
    whole.select("value").write.text(path)


def write_station_json(stations: DataFrame, path: str) -> None:
    """Stations as an object keyed by id."""
    write_json_object(
        stations, "id", F.to_json(F.struct("name", "lat", "lng", "ends"), {"ignoreNullFields": "false"}), path
    )


def write_pair_json(pair_maps: DataFrame, path: str) -> None:
    """Nested pair counts as an object keyed by start index: one line per `pair_maps` row, so every key once."""
    write_json_object(pair_maps, "sidx", F.col("ends"), path)


def renamed_subset(table: DataFrame, names: dict[str, str], where: Column | None = None) -> DataFrame:
    """Selected columns under new names, optionally filtered, ready for a records sink."""
    chosen = table if where is None else table.where(where)
    return chosen.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])
