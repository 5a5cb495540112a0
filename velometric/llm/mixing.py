"""Mixing sources to target weights by systematic sampling.

A source's weight gives its target: shares of all words, stopped at three times the source's size, the excess dealt out
again by weight. Every document of a source expects target / size copies; the expectations are summed up along the
source, one offset is added, and a document is emitted once per integer that its stretch of the sum crosses.

The order of the sum is by size class, then by a hash of the id, so every stretch of it holds documents of like size and
the words taken come near the target. The prefix sum never runs over a whole source in one task: documents fall into
cells (source, size class, three hex digits of the hash), cells are counted with map-side combining, two small windows
sum over classes of a source and cells of a class, and a window ranks documents within one cell.

Defined results: a null text has size 0; null sources are one source, sorted last; equal rows are dealt with one by one;
sources without words take nothing; an empty table gives an empty one. Reruns agree, as all randomness is hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velometric.llm.common import WORD, packed, whole_text, written

MOST_COPIES = 3


def size_class(size: Column) -> Column:
    """Sixteen classes below 16, then eight for each doubling; grows with the size."""
    low = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return (low * 16 + F.floor(size / F.pow(F.lit(2.0), low))).cast("int")


def offset_of(source: Column) -> Column:
    """A number in [0, 1) of each source, a multiple of 2 ** -20."""
    digits = F.substring(F.md5(F.concat(F.lit("offset:"), F.coalesce(source, F.lit("")))), 1, 5)
    return F.conv(digits, 16, 10).cast("double") / F.lit(1048576.0)


def home_of(source: Column) -> Column:
    """The source as a key that is never null, so joins and windows over it share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: list[str] | None) -> DataFrame:
    """`row` (of the columns `carry`, by default all) with its size and the cell it falls into."""
    row = F.struct(*[F.col(f"row.`{c}`").alias(c) for c in carry or docs.columns])
    rows = packed(docs).select(
        row.alias("row"),
        F.col(f"row.`{id_col}`").cast("string").alias("id"),
        home_of(F.col(f"row.`{source_col}`").cast("string")).alias("home"),
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"),
    )
    rows = rows.select("*", F.md5(F.coalesce("id", F.lit(""))).alias("hash"))
    # Never null, so that joins on it need no filter that would count the words once more.
    own_class = F.coalesce(size_class(F.col("size")), F.lit(0))
    return rows.select("*", own_class.alias("class"), F.substring("hash", 1, 3).alias("part"))


def targets(sizes: DataFrame, cycle: int = 3, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) with `target`. One row per source, so the windows without partitions stay small.

    In order of cap over weight, a source is capped when its cap is under what is left for it; the level of the first
    one that is not is the level of all others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.select("*", ((F.row_number().over(by_name) - 1) % cycle + 1).alias("weight"))
    rows = rows.select("*", (F.col("source_size") * most).alias("cap"), (F.col("source_size") * most / F.col("weight")).alias("ratio"))
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    rows = rows.select("*", level.alias("level"), (F.col("ratio") < level).alias("capped"))
    water = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(water * F.col("weight"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: list[str] | None = None,
) -> DataFrame:
    """`row` with `size`, `source_size`, `target` (its source's) and `copies`, one row per input row.

    Rows travel once, to the window over their cell; `carry` names the columns that they take along.
    """
    rows = sized(docs, id_col, text_col, source_col, carry)
    cells = written(
        rows.groupBy("home", "class", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-cells"
    )
    classes = cells.groupBy("home", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    past = Window.partitionBy("home").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("home", "class", "words", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("class_before"))
    sizes = classes.groupBy("home").agg(F.sum("words").alias("source_size"))
    source = F.when(F.col("home") != "", F.substr("home", F.lit(2)))
    rates = targets(sizes.select(source.alias("source"), "source_size"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES))))
    rates = rates.select(
        home_of(F.col("source")).alias("home"), "source_size", "target",
        F.coalesce(rate, F.lit(0.0)).alias("rate"), offset_of(F.col("source")).alias("offset"),
    )
    within = Window.partitionBy("home", "class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cell_before = F.col("class_before") + F.coalesce(F.sum("n").over(within), F.lit(0))
    placed = (
        cells.join(classes.drop("words"), ["home", "class"])
        .select("home", "class", "part", cell_before.alias("before"))
        .join(rates, "home")
    )
    in_cell = Window.partitionBy("home", "class", "part").orderBy("hash", "id", "size")
    ranked = rows.join(placed, ["home", "class", "part"]).select(
        "row", "size", "source_size", "target", "rate", "offset", (F.col("before") + F.row_number().over(in_cell)).alias("rank")
    )
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor(
        (F.col("rank") - 1) * F.col("rate") + F.col("offset")
    )
    return ranked.select(
        "row", "size", "source_size", "target", F.least(crossed, F.lit(MOST_COPIES)).cast("int").alias("copies")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    rows = mix(docs, id_col, text_col, source_col).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns from `mix`."""
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("long").alias("copies"),
    )
