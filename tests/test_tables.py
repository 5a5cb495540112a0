"""Duplicates, snapshots, stations and series on hand-written rows."""

import datetime as dt
import json
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velometric.operators.backfill import backfill, backfill_report, null_profile, snapshot_diff
from velometric.operators.dedupe import (
    DuplicateKeyError,
    assert_unique_key,
    exact_dedupe,
    keyed_copies,
    merge_pairs,
    once_only,
    ride_key,
)
from velometric.operators.explore import category_share, duration_hist, hist_mode, qualifying_days, station_counts
from velometric.operators.rollup import dashboard_records, rollup
from velometric.operators.series import (
    annualized_growth,
    clamp,
    clamp_preset,
    rolling_average,
)
from velometric.operators.stations import (
    dense_index,
    mean_place,
    modal_name,
    pair_maps,
    row_sketch,
    sketched_modes,
    stations,
    stations_from_hists,
    station_hist,
)
from velometric.schema import RIDE_SCHEMA
from velometric.sinks.writers import write_pair_json
from velometric.sources.documents import parse_pair_maps

AT = dt.datetime(2020, 5, 1, 8)


def ride(i, start=AT, stop=None, **kw):
    row = {f.name: None for f in RIDE_SCHEMA.fields}
    row.update({"Ride ID": str(i), "Start Time": start, "Stop Time": stop or start + dt.timedelta(minutes=10),
                "Start Region": "NYC", "End Region": "NYC", "Start Station ID": "72", "End Station ID": "79",
                "User Type": "Customer", "Rideable Type": "unknown", "Gender": 0})
    row.update(kw)
    return tuple(row[f.name] for f in RIDE_SCHEMA.fields)


def rides(spark, rows):
    return spark.createDataFrame(rows, RIDE_SCHEMA)


def test_dedupe_and_unique_key(spark):
    df = rides(spark, [ride(1), ride(1), ride(2)])
    assert exact_dedupe(df).count() == 2
    assert ride_key(df) == ["Start Time", "Stop Time", "Ride ID"] and ride_key(df.drop("Ride ID"))[-1] == "Bike ID"
    assert_unique_key(exact_dedupe(df))
    with pytest.raises(DuplicateKeyError, match="1 keys, 2 rows, 2 rows on one key"):
        assert_unique_key(rides(spark, [ride(1), ride(1, Gender=1)]))


def test_null_keys_count_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "k int, v int")
    assert {r["v"] for r in keyed_copies(df, ["k"]).collect()} == {1, 2}
    assert {r["v"] for r in once_only(df, ["k"]).collect()} == {3}


def pairs(spark, *groups):
    rows = []
    for n, group in enumerate(groups):
        for file, fields in group:
            rows.append((*ride(n, AT + dt.timedelta(hours=n), **fields), file))
    return spark.createDataFrame(rows, T.StructType([*RIDE_SCHEMA.fields, T.StructField("file", T.StringType())]))


def test_merge_pairs(spark):
    full, empty = {"Gender": 1, "Birth Year": 1980, "Bike ID": 5}, {}
    other = {"Gender": 2, "Birth Year": None, "Bike ID": None}
    df = pairs(spark, [("b", empty), ("a", full)], [("a", full), ("b", other)], [("a", empty)])
    got = {r["Ride ID"]: r for r in merge_pairs(df).collect()}
    assert [(got[k]["file"], got[k]["Gender"], got[k]["Birth Year"], got[k]["Bike ID"]) for k in "012"] == [
        ("b", 1, 1980, 5), ("b", 2, None, None), ("a", 0, None, None)]
    three = df.unionAll(df.where("file = 'b'").withColumn("file", F.lit("c")))
    with pytest.raises(DuplicateKeyError):
        merge_pairs(three)
    with pytest.raises(Exception, match="more than two rows on one key"):
        merge_pairs(three, check=False).collect()


def test_backfill(spark):
    new = rides(spark, [
        ride(0, AT), ride(1, AT + dt.timedelta(hours=1), Gender=2), ride(2, AT + dt.timedelta(hours=2))])
    old = rides(spark, [
        ride(0, AT, Gender=1, **{"Birth Year": 1980, "Bike ID": 7}),
        ride(1, AT + dt.timedelta(hours=1), Gender=1)])
    lettered = old.withColumn("Gender", F.when(F.col("Gender") == 1, "M")).withColumn(
        "Bike ID", F.concat(F.col("Bike ID").cast("string"), F.lit(".0")))
    for snapshot in (old, lettered):
        got = {r["Ride ID"]: r for r in backfill(new, snapshot, check=True).collect()}
        assert [(got[k]["Birth Year"], got[k]["Gender"], got[k]["Bike ID"]) for k in "012"] == [
            (1980, 1, 7), (None, 2, None), (None, 0, None)]
    assert backfill(new, old).columns == new.columns
    with pytest.raises(DuplicateKeyError):
        backfill(new.unionAll(new), old)
    report = {r["column"]: (r["empty"], r["filled"]) for r in backfill_report(new, old).collect()}
    assert report == {"Birth Year": (3, 1), "Gender": (2, 1), "Bike ID": (3, 1)}
    assert snapshot_diff(new, old).first().asDict() == {"adds": 1, "dels": 0, "both": 2}
    profile = {r["column"]: (r["old"], r["new"]) for r in null_profile(old.drop("Ride ID"), new).collect()}
    assert profile["Ride ID"] == (2, 0) and profile["Length"] == (2, 3) and "User Type" not in profile
    with pytest.raises(PySparkException):
        backfill(new, old.unionAll(old)).collect()
    with pytest.raises(DuplicateKeyError):
        backfill(new.unionAll(new), old, check=True)


def test_rollup_drops_null_keys(spark):
    df = rides(spark, [ride(1), ride(2, **{"Rideable Type": None})])
    assert [tuple(r) for r in rollup(df, "b", "cd").collect()] == [("unknown", 1, 600)]
    assert rollup(df, "b", "c", keep_nulls=True).count() == 2
    assert rollup(df, "bymr", "c").columns == ["Region", "Start Year", "Start Month", "Rideable Type", "Count"]
    with pytest.raises(ValueError):
        rollup(df, "q")
    bad = df.withColumn("User Type", F.lit("x"))
    with pytest.raises(PySparkException):
        dashboard_records(rollup(bad, "ymrgtb", "cd")).collect()


def test_station_modes(spark):
    hist = spark.createDataFrame([("1", "b", 5), ("1", "a", 5), ("2", "c", 1)], "id string, name string, count bigint")
    assert {r["id"]: r["name"] for r in modal_name(hist).collect()} == {"1": "a", "2": "c"}
    places = spark.createDataFrame([("1", 1.0, 0.0, 3), ("1", 2.0, 0.0, 1)], "id string, lat double, lng double, count bigint")
    assert mean_place(places).first()["lat"] == 1.25
    assert {r["id"]: r["name"] for r in sketched_modes(hist, ["name"]).collect()} == {"1": "b", "2": "c"}


def test_row_sketch(spark):
    hist = spark.createDataFrame(
        [("k", "a", 6), ("k", "b", 3), ("k", "c", 1), ("one", "a", 4), ("tie", "a", 2), ("tie", "b", 2)],
        "id string, name string, count bigint")
    got = {r["id"]: r.asDict() for r in row_sketch(hist, counts="list").collect()}
    assert got["k"] == {"id": "k", "mode_count": 6, "second": 3, "restsum": 4, "total": 10, "first/second": 2.0,
                        "mode_pct": 0.6, "num": 3, "counts": [6, 3, 1]}
    assert got["one"]["second"] is None and got["one"]["restsum"] == 0
    assert got["tie"]["second"] == 2 and got["tie"]["counts"] == [2, 2]


def test_station_table_both_ways(spark):
    df = rides(spark, [
        ride(1, **{"Start Station Name": "A", "Start Station Latitude": 1.0, "Start Station Longitude": 2.0}),
        ride(2, **{"Start Station ID": None, "End Station ID": "lost"}),
        ride(3, **{"Start Station ID": "bare"}),
        ride(4, **{"End Station Name": "B", "End Station ID": "72"})])
    one = {tuple(r) for r in stations(df).collect()}
    three = {tuple(r) for r in stations_from_hists(station_hist(df, "in"), station_hist(df, "il"), rollup(df, "e", "c")).collect()}
    assert one == three == {("72", "A", 1.0, 2.0, 1), ("79", None, None, None, 2), ("lost", None, None, None, 1)}


def test_dense_index_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = spark.range(5000, numPartitions=16).select(F.sha2(F.col("id").cast("string"), 256).alias("id"))
        indexed = dense_index(ids)
        assert indexed.rdd.getNumPartitions() > 1
        rows = sorted((r["id"], r["idx"]) for r in indexed.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [i for _, i in rows] == list(range(5000))


def test_pair_maps_have_a_row_per_start(spark, tmp_path):
    pairs_df = spark.range(100_000).select(
        (F.col("id") % 2 * 7).alias("sidx"), F.col("id").alias("eidx"), (F.col("id") + 1).alias("count"))
    maps = pair_maps(pairs_df)
    assert maps.count() == 2
    assert maps.where("sidx = 0").first()["ends"].startswith('{"0":1,"2":3,')
    assert parse_pair_maps(maps).exceptAll(pairs_df).count() == 0
    write_pair_json(maps, str(tmp_path / "se"))
    document = json.loads("".join(p.read_text() for p in sorted((tmp_path / "se").glob("part-*"))))
    assert {(s, len(ends)) for s, ends in document.items()} == {("0", 50_000), ("7", 50_000)}


def series(spark, values, start=(2020, 1)):
    y, m = start
    rows = [(f"{(y * 12 + m - 1 + i) // 12}-{(y * 12 + m - 1 + i) % 12 + 1:02d}", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "m string, v double")


def averages(df, **kw):
    return [r["avg"] for r in rolling_average(df, 2, "v", **kw).orderBy("m").collect()]


def test_rolling(spark):
    df = series(spark, [1.0, 2.0, 3.0, None, 5.0, 6.0])
    assert averages(df) == [None, None, 2.5, 1.5, 2.5, None]
    assert averages(df, warmup="full") == [None, 1.5, 2.5, 1.5, 2.5, 5.5]


def test_growth(spark):
    values = [100.0] + [150.0] * 11 + [200.0] + [300.0] * 11 + [400.0]
    got = {r["months"]: r for r in annualized_growth(series(spark, values), "v").collect()}
    assert set(got) == {12, 24} and got[12]["ratio"] == 2 and math.isclose(got[24]["percent"], 100)
    assert got[24]["first_m"] == "2020-01" and got[24]["last_m"] == "2022-01"
    short = annualized_growth(series(spark, [100.0, 1.0, 1.0, 1.0, 1.0, 1.0, 110.0]), "v").collect()
    assert len(short) == 1 and short[0]["months"] == 6 and math.isclose(short[0]["percent"], 21)
    assert annualized_growth(series(spark, [1.0]), "v").count() == 0


def test_clamp(spark):
    df = series(spark, [1.0, 2.0, 3.0])
    assert [r["m"] for r in clamp(df, "2020-02", "2020-03").collect()] == ["2020-02"]
    long = series(spark, [float(i) for i in range(30)])
    assert clamp_preset(long, "1y").count() == 12 and clamp_preset(long, "All").count() == 30


def test_durations(spark):
    df = rides(spark, [ride(i, AT, AT + dt.timedelta(seconds=s)) for i, s in enumerate([5, 12, 13, 25, 99])])
    hist = duration_hist(df, 10, 3)
    assert [(r["Duration"], r["# Rides"]) for r in hist.collect()] == [("0s", 1), ("10s", 2), ("20s", 1)]
    assert [r["bucket"] for r in hist_mode(hist).collect()] == [1]


def test_docking_averages(spark):
    days = spark.range(1).select(
        qualifying_days("2022-08-01", "2022-08-31").alias("a"),
        qualifying_days("2022-08-01", "2022-08-31", True).alias("b"),
        qualifying_days("2022-08-01", "2022-08-31", {0}).alias("c")).first()
    assert tuple(days) == (31, 23, 5)
    with pytest.raises(ValueError):
        station_counts(None, None, ["Day"], daily_avg=True)


def test_category_share_rounds_halves_to_even(spark):
    df = spark.range(400).select(F.when(F.col("id") < 49, "a").otherwise("b").alias("c"), F.lit(1).alias("g"))
    row = category_share(df, F.col("c"), ["a", "b"], {"g": F.col("g")}).first()
    assert (row["a"], row["b"], row["a%"], row["b%"]) == (49, 351, 12.2, 87.8)
