"""Stored rollups that answer coarser ones: a lattice of key sets, each question going to the smallest that covers it.

A stored rollup keeps rows with null keys, as another rollup may not group by that key; a question leaves out the rows that
are null in its own keys, like a direct rollup. Counts and durations add up over stop months and over keys. Calendar keys
that others determine (the weekday of a date) are worked out from these.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velometric.operators.rollup import key_columns, resum, rollup
from velometric.sinks.journal import exists
from velometric.sinks.writers import write_by_month

Shape = tuple[str, str]

#: By day and rider, by hour and weekday, by station pair with calendar month, and what most questions ask for.
LATTICE: list[Shape] = [("ymdrgtb", "cd"), ("ymrgtb", "cd"), ("rwh", "cd"), ("ymse", "c"), ("se", "c"), ("s", "c")]

#: Key letter -> letters that determine it, and the expression over their columns.
DERIVED = {
    "w": ("ymd", lambda: F.weekday(F.make_date(F.col("Start Year"), F.col("Start Month"), F.col("Start Day")))),
}


def covers(stored: Shape, keys: str, sums: str) -> bool:
    """Whether a stored rollup determines the wanted one."""
    have = set(stored[0])
    have |= {letter for letter, (needed, _) in DERIVED.items() if have.issuperset(needed)}
    return have.issuperset(keys) and set(stored[1]).issuperset(sums)


def _path(root: str, shape: Shape) -> str:
    return f"{root.rstrip('/')}/{shape[0]}_{shape[1]}"


def _regrouped(table: DataFrame, keys: str, sums: str, by_month: bool, keep_nulls: bool) -> DataFrame:
    for letter, (_, make) in DERIVED.items():
        name = key_columns(letter)[0]
        if letter in keys and name not in table.columns:
            table = table.withColumn(name, make())
    columns = [*(["ym"] if by_month else []), *key_columns(keys)]
    totals = [c for letter, c in (("c", "Count"), ("d", "Duration")) if letter in sums]
    rows = table.select(*columns, *totals)
    if not keep_nulls:
        rows = rows.na.drop(subset=columns)
    return resum(rows, columns)


def write_lattice(
    rides: DataFrame, root: str, shapes: Sequence[Shape] = LATTICE, months: Collection[int] | None = None
) -> None:
    """Write the rollups of the stop months in `rides`, finer ones first; `months` without rides lose theirs.

    Rides are read once per shape that no other covers; every coarser shape is summed up from the stored one just above it.
    """
    spark = rides.sparkSession
    written: list[Shape] = []
    wanted = None if months is None else sorted(months)
    for shape in sorted(shapes, key=lambda s: (-len(s[0]), s)):
        above = [s for s in written if covers(s, *shape)]
        if above:
            source = spark.read.parquet(_path(root, above[-1]))
            source = source if wanted is None else source.where(F.col("ym").isin(wanted))
            table = _regrouped(source, *shape, by_month=True, keep_nulls=True)
        else:
            table = rollup(rides, *shape, by_month=True, keep_nulls=True)
        write_by_month(table, _path(root, shape), months=wanted)
        written.append(shape)


def route(spark: SparkSession, root: str, keys: str, sums: str = "c", shapes: Sequence[Shape] = LATTICE) -> Shape:
    """The stored shape with the fewest rows that covers the question; row counts come from the files' footers."""
    able = [s for s in shapes if covers(s, keys, sums) and exists(spark, _path(root, s))]
    if not able:
        raise LookupError(f"no stored rollup covers {keys}_{sums}")
    return min(able, key=lambda s: (spark.read.parquet(_path(root, s)).count(), s))


def answer(
    spark: SparkSession,
    root: str,
    keys: str,
    sums: str = "c",
    by_month: bool = False,
    months: Collection[int] | None = None,
    shapes: Sequence[Shape] = LATTICE,
) -> DataFrame:
    """`rollup(rides, keys, sums, by_month)` without the rides; `months` restricts it to stop months."""
    table = spark.read.parquet(_path(root, route(spark, root, keys, sums, shapes)))
    if months is not None:
        table = table.where(F.col("ym").isin(sorted(months)))
    return _regrouped(table, keys, sums, by_month, keep_nulls=False)
