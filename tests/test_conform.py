import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from velometric.functions.columns import (
    clean_station_id,
    gender_letter,
    part_label,
    region_of,
    ride_seconds,
    seconds_label,
)
from velometric.functions.months import month_list, months_between
from velometric.operators.conform import (
    ambiguous_stations,
    column_surprises,
    conform,
    union_regions,
    with_part_keys,
)
from velometric.schema import RIDE_COLUMNS

T0 = dt.datetime(2021, 3, 14, 1, 0, 0)


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_duration_wraps_and_ignores_time_zones(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        deltas = [dt.timedelta(hours=25), dt.timedelta(seconds=-10), dt.timedelta(seconds=1.9),
                  dt.timedelta(seconds=-0.5), dt.timedelta(hours=2)]
        df = spark.createDataFrame(
            [(i, T0, T0 + d) for i, d in enumerate(deltas)], "i int, a timestamp_ntz, b timestamp_ntz"
        )
        rows = df.select(
            "i", ride_seconds(F.col("a"), F.col("b")).alias("w"), ride_seconds(F.col("a"), F.col("b"), False).alias("t")
        ).orderBy("i").collect()
        assert [r["w"] for r in rows] == [3600, 86390, 1, 86399, 7200]
        assert [r["t"] for r in rows] == [90000, -10, 1, -1, 7200]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_regions(spark):
    ids = ["72", "5329.03", "12345xyz", "JC005", "HB102", "SYS038", "zzz", None, "None", "North", "JC5",
           "Liberty State Park X", "S 5th St & Kent Ave", "X-MTL-AOS-5.1", "X-MTL-AOS-551", "JCSYS", "Lab - NYC"]
    got = column(spark, ids, "string", F.expr(region_of("v")))
    assert got == ["NYC", "NYC", "NYC", "JC", "HB", "SYS", None, "None", "None", "None", None,
                   "JC", "NYC", "SYS", None, "SYS", "SYS"]
    assert column(spark, ["72", "JC005"], "string", F.expr(region_of("v", "'JC'"))) == ["JC", "JC"]
    strict = F.expr(region_of("v", strict_none=True))
    assert column(spark, ["North", "None", None], "string", strict) == [None, "None", "None"]


def test_overlapping_custom_rules_are_an_error(spark):
    rules = {"A": [r"\d+"], "B": ["7|x"], "SYS": ["S"]}
    assert column(spark, ["8", "x1", "q"], "string", F.expr(region_of("v", rules=rules))) == ["A", "B", None]
    with pytest.raises(PySparkException):
        column(spark, ["72"], "string", F.expr(region_of("v", rules=rules)))


def test_station_ids(spark):
    got = column(spark, ["72.0", "5329.03", "7.00", "a.0", None], "string", F.expr(clean_station_id("v")))
    assert got == ["72", "5329.03", "7.00", "a.0", None]


def test_labels(spark):
    seconds = [0, 59, 60, 3600, 3661, 86399, 86400 + 5]
    assert column(spark, seconds, "bigint", seconds_label(F.col("v"))) == [
        "0s", "59s", "1m", "1h", "1h1m1s", "23h59m59s", "5s"]
    assert column(spark, [0, 1, 2], "int", gender_letter(F.col("v"))) == ["U", "M", "F"]


def test_part_label_needs_times(spark):
    df = spark.createDataFrame([(T0, None)], "a timestamp_ntz, b timestamp_ntz")
    with pytest.raises(PySparkException):
        df.select(part_label(F.col("a"), F.col("b"))).collect()


OLD = ("tripduration string, starttime string, stoptime string, `start station id` string, `start station name` string, "
       "`start station latitude` string, `start station longitude` string, `end station id` string, "
       "`end station name` string, `end station latitude` string, `end station longitude` string, bikeid string, "
       "usertype string, `birth year` string, gender string")


def old_row(**kw):
    row = dict(d="9", start="2015-06-01 00:00:01", stop="2015-06-01 00:10:01", sid="72.0", sn="A", slat="40.1",
               slng="-73.9", eid="79", en="B", elat="40.2", elng="-74.0", bike="17", user="Subscriber",
               birth="1980.0", gender="2")
    row.update(kw)
    return tuple(row.values())


def test_old_era(spark):
    raw = spark.createDataFrame(
        [old_row(), old_row(start="6/1/2015 0:00:03", stop="6/1/2015 0:05", user="other", birth=None, gender="U")], OLD
    )
    a, b = conform(raw, "NYC").orderBy("Start Time").collect()
    assert list(a.asDict()) == RIDE_COLUMNS
    assert (a["Start Station ID"], a["Start Region"], a["Birth Year"], a["Gender"], a["Bike ID"]) == ("72", "NYC", 1980, 2, 17)
    assert a["Rideable Type"] == "unknown" and a["Ride ID"] is None
    assert b["Start Time"] == dt.datetime(2015, 6, 1, 0, 0, 3) and b["Stop Time"] == dt.datetime(2015, 6, 1, 0, 5)
    assert b["User Type"] is None and b["Gender"] == 0


NEW = ("ride_id string, rideable_type string, started_at string, ended_at string, start_station_id string, "
       "end_station_id string, member_casual string, `Unnamed: 0` string, extra string")


def test_new_era(spark):
    raw = spark.createDataFrame(
        [("a", "docked_bike", "2022-01-01 00:00:00.5", "2022-01-01 01:00:00", "JC005", "HB102", "member", "0", "x"),
         ("b", "motivate_dockless_bike", "2022-01-01 00:00:01", "2022-01-01 01:00:00", "JC005", None, "casual", "0", "x"),
         ("c", "electric_bike", "2022-01-01 00:00:02", "2022-01-01 01:00:00", "SYS038", "JC005", "member", "0", "x"),
         ("d", "electric_bike", "2022-01-01 00:00:03", "2022-01-01 01:00:00", "zzz", "72", "who", "0", "x")], NEW)
    with pytest.warns(UserWarning, match="extra"):
        rides = conform(raw, "JC")
    got = {r["Ride ID"]: r for r in rides.collect()}
    assert set(got) == {"a", "d"}
    assert got["a"]["Rideable Type"] == "classic_bike" and got["a"]["User Type"] == "Subscriber"
    assert got["d"]["Start Region"] is None and got["d"]["End Region"] == "JC" and got["d"]["User Type"] is None
    with pytest.warns(UserWarning):
        kept = {r["Ride ID"]: r for r in conform(raw, "JC", keep_open_ended=True).collect()}
    assert set(kept) == {"a", "b", "d"} and kept["b"]["End Region"] == "JC" and kept["b"]["Rideable Type"] is None
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        conform(raw.withColumn("usertype", F.lit("x")))
    assert ambiguous_stations(rides).count() == 0


def test_union_of_regions(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert sorted(tuple(r) for r in union_regions(a, b).fillna(-1).collect()) == [(1, 2), (3, -1)]


@pytest.mark.parametrize(
    "text, months",
    [("202106-08", [202106, 202107]), ("1306", [201306]), ("14-15", list(range(201401, 201413))),
     ("2021-2022", list(range(202101, 202113))), ("2012", [202012]), ("202101,202012-202102", [202012, 202101]),
     ("-1308", [201306, 201307]), ("202411-", [202411, 202412])],
)
def test_month_lists(text, months):
    assert month_list(text, end=202501) == months


@pytest.mark.parametrize("text", ["1206", "1950", "202113", "abc", "20210"])
def test_bad_months(text):
    with pytest.raises(ValueError):
        month_list(text)


def test_months():
    assert months_between(201911, 202002) == [201911, 201912, 202001]


def test_column_surprises(spark):
    rows = [(201912, "a", 1, 1980), (202006, "b", 1, 1980), (202006, None, 1, None), (202103, "c", None, None), (202104, None, 5, None)]
    df = spark.createDataFrame(rows, "ym int, `Ride ID` string, `Bike ID` int, `Birth Year` int")
    got = {(r["ym"], r["column"], r["filled"]) for r in column_surprises(df).collect()}
    assert got == {(201912, "Ride ID", 1), (202104, "Ride ID", 0), (202104, "Bike ID", 1)}


def test_part_keys_need_times(spark):
    df = spark.createDataFrame([(T0, None)], "`Start Time` timestamp_ntz, `Stop Time` timestamp_ntz")
    with pytest.raises(Exception, match="ride without Stop Time"):
        with_part_keys(df).collect()
