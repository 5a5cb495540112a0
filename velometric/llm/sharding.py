"""Sharding by sampled splitters.

Keys are text checksums, so equal texts lie together. Keys are drawn in proportion to size, quantiles of the draws are
the splitters of `ranges` ranges, and the ranges' bytes are counted exactly. An overfull range, such as one key that a
third of the rows hold, is subdivided by a hash of the id into parts of about the mean size. Consecutive ranges and parts
form a shard; each goes to the shard that holds its middle byte, so shards differ from one another by about one range.
A row's slot is its rank in its grain behind the rows of the part's earlier grains and the shard's earlier parts.

Grains are what one task ranks at a time. A range has GRAINS of them, more where that leaves over ROWS rows to one, so
they stay as small with 1e12 rows as with 1e6. The table of grains grows with the rows and is joined like any other.

The driver sees the `ranges` - 1 splitters and one row of totals.

Defined results: a null text has size 1 and checksum 0; very long texts are one row like any other; rows equal in everything take
different slots, ties between them going either way; extra columns stay in `row` under their names; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velometric.llm.common import packed, whole_text, written

RANGES = 1024
DRAWS = 32
#: Into how many grains a range is counted at least, of which its parts are made, and how many rows a grain should have at most.
GRAINS = 1024
ROWS = 50_000
_UNIT = 1 << 30


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = whole_text(text_col)
    rows = packed(docs).select(
        "row", F.col(f"row.`{id_col}`").cast("string").alias("id"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("key"),
    )
    return rows.select("*", F.pmod(F.xxhash64("id", "key"), F.lit(_UNIT)).alias("spread"))


def splitters(rows: DataFrame, total: int, ranges: int, draws: int) -> list[int]:
    """Quantiles of keys drawn about `draws` times per range, a row in proportion to its size."""
    expected = F.col("size") * F.lit(ranges * draws / max(total, 1))
    sample = rows.select("key", F.floor(expected + F.col("spread") / F.lit(float(_UNIT))).alias("drawn")).where("drawn > 0")
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = sample.agg(F.percentile("key", at, F.col("drawn"))).head()[0]
    return sorted({int(x) for x in found or []})


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many splitters are at or below the key: first among every w-th, then among the w behind that one."""
    if not cuts:
        return F.lit(0)
    width = max(1, round(len(cuts) ** 0.5))
    rows = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    tails = F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    coarse = F.size(F.filter(heads, lambda x: x <= key))
    fine = F.size(F.filter(F.get(tails, coarse - 1), lambda x: x <= key))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + fine).cast("int")


def grains_of(rows: int, ranges: int) -> int:
    """Grains of a range: a power of two, so that `spread` falls evenly into them."""
    grains = GRAINS
    while grains * ranges * ROWS < rows and grains < _UNIT:
        grains *= 2
    return grains


def placed_grains(counts: DataFrame, total: int, shards: int, ranges: int, grains: int) -> DataFrame:
    """(range, grain) with `shard` and `first_slot`, from the grains' `bytes` and `rows`."""
    mean = max(total / ranges, 1.0)
    # A window over one range's grains; their number does not depend on how many rows share a key.
    of_range = F.sum("bytes").over(Window.partitionBy("range"))
    n_parts = F.least(F.greatest(F.floor(of_range / F.lit(mean)), F.lit(1)), F.lit(grains))
    part = F.floor(F.col("grain") * F.col("n_parts") / F.lit(grains)).cast("int")
    cells = counts.select("*", n_parts.alias("n_parts")).select("range", "grain", "bytes", "rows", part.alias("part"))
    earlier_grains = Window.partitionBy("range", "part").orderBy("grain").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("*", F.coalesce(F.sum("rows").over(earlier_grains), F.lit(0)).alias("in_part"))
    table = cells.groupBy("range", "part").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    # At most 2 * `ranges` parts, as a range has at most its bytes over the mean, plus one.
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select("*", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before"))
    shard = F.floor((F.col("before") + F.col("bytes") / 2) * shards / F.lit(float(max(total, 1))))
    table = table.select("*", F.least(shard, F.lit(shards - 1)).cast("int").alias("shard"))
    earlier = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select("range", "part", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("part_slot"))
    return cells.join(table, ["range", "part"]).select(
        "range", "grain", "shard", (F.col("part_slot") + F.col("in_part")).alias("first_slot")
    )


def assign_shards(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges: int = RANGES,
    draws: int = DRAWS,
) -> DataFrame:
    """`row` with `size`, `key`, `shard` and `slot`, one row per input row."""
    rows = keyed(docs, id_col, text_col)
    totals = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).head()
    total, grains = totals["bytes"] or 0, grains_of(totals["rows"], ranges)
    cuts = splitters(rows, total, ranges, draws)
    ranged = rows.select(
        "*",
        # Never null, so that joins on it need no filter that would work it out once more.
        F.coalesce(range_of(F.col("key"), cuts), F.lit(0)).alias("range"),
        F.coalesce(F.floor(F.col("spread") * grains / F.lit(_UNIT)).cast("int"), F.lit(0)).alias("grain"),
    )
    counts = written(
        ranged.groupBy("range", "grain").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-grains"
    )
    table = written(placed_grains(counts, total, shards, ranges, grains), "shard-places")
    placed = ranged.join(table, ["range", "grain"])
    rank = F.row_number().over(Window.partitionBy("range", "grain").orderBy("key", "spread", "id", "size"))
    return placed.select("row", "size", "key", "shard", (F.col("first_slot") + rank - 1).alias("slot"))


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns from `assign_shards`."""
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "size", F.col("key").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
