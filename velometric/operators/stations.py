"""Station occurrence histograms, canonical names and places, dense indices and pair flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velometric.functions.columns import yyyymm
from velometric.operators.rollup import rollup
from velometric.session import checkpoint_root

# Key letter -> (output column, ride column suffix) pairs.
STATION_KEYS = {
    "i": [("id", "Station ID")],
    "n": [("name", "Station Name")],
    "l": [("lat", "Station Latitude"), ("lng", "Station Longitude")],
}
TIME_KEYS = {
    "y": ("year", lambda: F.year("Start Time")),
    "m": ("month", lambda: F.month("Start Time")),
}


def ride_ends(rides: DataFrame, columns: list[tuple[str, str]], *carried: Column) -> DataFrame:
    """Both ends of every ride as rows, from one pass over the rides; `start` tells the side."""

    def side(prefix: str) -> Column:
        fields = [F.col(f"`{prefix} {source}`").alias(name) for name, source in columns]
        return F.struct(*fields, F.lit(prefix == "Start").alias("start"))

    return rides.select(*carried, F.inline(F.array(side("Start"), side("End"))))


def station_hist(rides: DataFrame, keys: str, keep_nulls: bool = False) -> DataFrame:
    """Occurrences of station id/name/place (letters `i`, `n`, `l`) with optional year and month.

    Time is the ride's start for both ends. Rows with a null key are left out.
    """
    unknown = set(keys) - set(STATION_KEYS) - set(TIME_KEYS)
    if unknown or not keys:
        raise ValueError(f"bad station keys {keys!r}")
    columns = [pair for k, pairs in STATION_KEYS.items() if k in keys for pair in pairs]
    times = [(name, make()) for k, (name, make) in TIME_KEYS.items() if k in keys]
    ends = ride_ends(rides, columns, *[e.alias(n) for n, e in times])
    names = [n for n, _ in times] + [n for n, _ in columns]
    if not keep_nulls:
        ends = ends.na.drop(subset=names)
    return ends.groupBy(*names).agg(F.count(F.lit(1)).alias("count"))


def station_hist_sorted(rides: DataFrame, keys: str) -> DataFrame:
    """The histogram in order of its keys, which is how it is published."""
    hist = station_hist(rides, keys)
    return hist.orderBy(*[c for c in hist.columns if c != "count"])


def modal_place(hist_il: DataFrame) -> DataFrame:
    """Most frequent place per id with how dominant it is; the larger place wins a tie."""
    return sketched_modes(hist_il, ["lat", "lng"])


def modal_name(hist_in: DataFrame) -> DataFrame:
    """Most frequent name per id; the smallest name wins a tie."""
    best = F.min_by("name", F.struct(-F.col("count"), F.col("name")))
    return hist_in.groupBy("id").agg(best.alias("name"))


def mean_place(hist_il: DataFrame) -> DataFrame:
    """Count-weighted mean latitude and longitude per id."""
    weight = F.sum("count")
    return hist_il.groupBy("id").agg(
        (F.sum(F.col("lat") * F.col("count")) / weight).alias("lat"),
        (F.sum(F.col("lng") * F.col("count")) / weight).alias("lng"),
    )


def stations_from_hists(hist_in: DataFrame, hist_il: DataFrame, e_c: DataFrame) -> DataFrame:
    """Names, places and end counts side by side by id; stations without ends get 0."""
    ends = e_c.select(F.col("End Station ID").alias("id"), F.col("Count").alias("ends"))
    joined = modal_name(hist_in).join(mean_place(hist_il), "id", "full").join(ends, "id", "full")
    return joined.withColumn("ends", F.coalesce("ends", F.lit(0)))


def station_states(rides: DataFrame, by_month: bool = False) -> DataFrame:
    """What rides add to each (id, name): mergeable counts and place sums, by stop month if wanted.

    States of disjoint rides add up, so months can be joined, replaced and left out without the rides of any other.
    """
    columns = [pair for pairs in STATION_KEYS.values() for pair in pairs]
    month = [yyyymm(F.col("Stop Time")).alias("ym")] if by_month else []
    ends = ride_ends(rides, columns, *month).where("id is not null")
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return ends.groupBy(*(["ym"] if by_month else []), "id", "name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(placed).alias("placed"),
        F.sum(F.when(placed, F.col("lat"))).alias("lat"),
        F.sum(F.when(placed, F.col("lng"))).alias("lng"),
        F.count_if(~F.col("start")).alias("ends"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """States of several months as one per (id, name)."""
    sums = ["n", "placed", "lat", "lng", "ends"]
    return states.groupBy("id", "name").agg(*[F.sum(c).alias(c) for c in sums])


def stations_from_states(states: DataFrame) -> DataFrame:
    """The station table from one state per (id, name): modal name, mean place, end count."""
    named = F.col("name").isNotNull()
    dim = states.groupBy("id").agg(
        F.min_by(
            F.when(named, F.col("name")), F.when(named, F.struct(-F.col("n"), F.col("name")))
        ).alias("name"),
        (F.sum("lat") / F.sum("placed")).alias("lat"),
        (F.sum("lng") / F.sum("placed")).alias("lng"),
        F.sum("ends").alias("ends"),
        F.sum("placed").alias("placed"),
    )
    return dim.where("name is not null or placed > 0 or ends > 0").drop("placed")


def stations(rides: DataFrame) -> DataFrame:
    """The same table as `stations_from_hists` from a single scan of the rides.

    Rides reduce to one row per (id, name) before anything is grouped by id alone, so a hot
    station costs its number of name spellings rather than its number of rides, and the widely
    varying coordinates never become grouping keys.
    """
    return stations_from_states(station_states(rides))


def mode_diagnostics(hist_in: DataFrame) -> DataFrame:
    """Per (id, name): total, number of names, share, and ratio to the next most frequent name."""
    per_id = Window.partitionBy("id")
    ranked = per_id.orderBy(F.desc("count"), F.asc("name"))
    return hist_in.withColumns(
        {
            "total": F.sum("count").over(per_id),
            "n": F.count(F.lit(1)).over(per_id),
            "ratio": F.col("count") / F.lead("count").over(ranked),
        }
    ).withColumn("frac", F.col("count") / F.col("total"))


def row_sketch(hist: DataFrame, key: str = "id", sum_key: str = "count", counts: str = "runs") -> DataFrame:
    """How dominant each key's most frequent value is.

    Equal counts are run-length grouped before they are listed: a key with N rides has at most
    about sqrt(2N) different counts, so no list grows with the rides or with the number of values.
    `counts` picks the descending counts as `runs` (count, times), as a flat `list`, or `none`.
    """
    runs = hist.groupBy(key, F.col(sum_key).alias("__count")).agg(F.count(F.lit(1)).alias("__times"))
    listed = runs.groupBy(key).agg(
        F.sort_array(
            F.collect_list(
                F.struct(F.col("__count").alias("count"), F.col("__times").alias("times"))
            ),
            asc=False,
        ).alias("runs"),
        F.sum(F.col("__count") * F.col("__times")).alias("total"),
        F.sum("__times").alias("num"),
    )
    top = F.col("runs")[0]
    second = F.when(top["times"] > 1, top["count"]).otherwise(F.get(F.col("runs"), F.lit(1))["count"])
    out = listed.select(
        key,
        top["count"].alias("mode_count"),
        second.alias("second"),
        (F.col("total") - top["count"]).alias("restsum"),
        "total",
        (top["count"] / second).alias("first/second"),
        (top["count"] / F.col("total")).alias("mode_pct"),
        "num",
        "runs",
    )
    if counts == "runs":
        return out
    if counts == "list":
        flat = F.flatten(
            F.transform("runs", lambda r: F.array_repeat(r["count"], r["times"].cast("int")))
        )
        return out.withColumn("counts", flat).drop("runs")
    return out.drop("runs")


def below_threshold(sketch: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Keys whose most frequent value holds less than the threshold share."""
    return sketch.where(F.col("mode_pct") < threshold)


def sketched_modes(hist: DataFrame, value_cols: list[str], key: str = "id") -> DataFrame:
    """Modal value of each key with its sketch; on a tie the largest value wins."""
    best = F.max(F.struct("count", *value_cols)).alias("best")
    modes = hist.groupBy(key).agg(best).select(key, *[F.col(f"best.{c}") for c in value_cols])
    return modes.join(row_sketch(hist, key, counts="none"), key)


def dense_index(dim: DataFrame, order: str = "id", name: str = "idx") -> DataFrame:
    """0-based position in the order of a unique column, without gathering rows in one task.

    Rows are range-partitioned and sorted, then pinned with a reliable checkpoint so that
    partition numbers cannot change; a row's index is its place in its partition plus the sizes of
    the partitions before it (a table with one row per partition).
    """
    checkpoint_root(dim.sparkSession)
    pinned = dim.repartitionByRange(F.col(order)).sortWithinPartitions(order).checkpoint()
    placed = pinned.withColumn("__row", F.monotonically_increasing_id()).withColumns(
        {
            "__part": F.shiftright("__row", 33),
            "__row": F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__off"))
    joined = placed.join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("__off") + F.col("__row")).drop("__part", "__row", "__off")


def station_index(dim: DataFrame) -> DataFrame:
    """id and idx; idx is the rank of the id among all stations."""
    return dense_index(dim.select("id"))


def pair_counts(se_c: DataFrame, index: DataFrame, how: str = "left") -> DataFrame:
    """Start/end pair counts with both ids replaced by their indices.

    The join strategy is left to the planner: the index is broadcast only when its measured size
    allows, otherwise both sides shuffle and hot stations are split by adaptive execution.
    """
    starts = index.select(F.col("id").alias("Start Station ID"), F.col("idx").alias("sidx"))
    ends = index.select(F.col("id").alias("End Station ID"), F.col("idx").alias("eidx"))
    joined = se_c.join(starts, "Start Station ID", how).join(ends, "End Station ID", how)
    return joined.select("sidx", "eidx", F.col("Count").alias("count"))


def decode_pairs(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Indices back to ids, as two left joins written in SQL."""
    return pairs.sparkSession.sql(
        """
        select s.id as start_id, e.id as end_id, p.count
        from {pairs} p
        left join {index} s on p.sidx = s.idx
        left join {index} e on p.eidx = e.idx
        """,
        pairs=pairs,
        index=index,
    )


def pair_maps(pairs: DataFrame) -> DataFrame:
    """One JSON object `{eidx: count}` per start station, keys ascending.

    A row holds at most one entry per end station, so the station dimension bounds it, not the rides.
    """
    entries = F.sort_array(F.collect_list(F.struct("eidx", "count")))
    named = F.transform("entries", lambda e: F.struct(e["eidx"].cast("string"), e["count"]))
    maps = pairs.groupBy("sidx").agg(entries.alias("entries"))
    return maps.select("sidx", F.to_json(F.map_from_entries(named)).alias("ends"))


def remap_pair_keys(maps: DataFrame, index: DataFrame) -> DataFrame:
    """Pair maps keyed by ids instead of indices, as long rows; indices without a station go."""
    pairs = maps.select(
        F.col("sidx").cast("bigint").alias("sidx"),
        F.explode(F.from_json("ends", "map<string, bigint>")).alias("eidx", "count"),
    )
    named = decode_pairs(pairs.withColumn("eidx", F.col("eidx").cast("bigint")), index)
    return named.where("start_id is not null and end_id is not null")


def flow_weights(pairs_by_id: DataFrame, dim: DataFrame) -> DataFrame:
    """Line weight of each pair: share of the start's largest flow times sqrt of the start's ends.

    The largest flow comes from an aggregation joined back, not from a window over the group.
    """
    largest = pairs_by_id.groupBy("start_id").agg(F.max("count").alias("max_count"))
    start = dim.select(F.col("id").alias("start_id"), "ends")
    weight = F.col("count") / F.col("max_count") * F.sqrt("ends")
    return (
        pairs_by_id.join(largest, "start_id")
        .join(start, "start_id")
        .select("start_id", "end_id", "count", weight.alias("weight"))
    )


def circle_radius(dim: DataFrame) -> DataFrame:
    """Marker radius of a station: square root of its ends."""
    return dim.withColumn("radius", F.sqrt("ends"))
