"""Snapshots compared by digest, a backfill profiled by its own write, and months read through a range index."""

import pytest
from compare import ROOT
from pyspark.sql import functions as F

from velometric.functions.columns import yyyymm
from velometric.operators.backfill import backfill, null_profile, write_backfilled
from velometric.operators.conform import conform
from velometric.operators.snapshots import differing_parts, part_digests, row_changes, snapshot_changes
from velometric.plans.catalog import _snapshots
from velometric.sinks.writers import write_by_month, write_sorted_csv
from velometric.sources.event_trips import read_event_trips
from velometric.sources.sorted_csv import files_of_months, index_sorted_csv, read_csv_months

KEYED = "ym int, k int, v string"


@pytest.fixture(scope="module")
def raw(spark):
    return read_event_trips(spark, f"{ROOT}/sf0.001").cache()


@pytest.fixture(scope="module")
def rides(raw):
    return conform(raw, region_column="src_region").withColumn("ym", yyyymm(F.col("Stop Time"))).cache()


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_digests_do_not_depend_on_order_and_tell_nulls_and_copies(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (2, 1, None), (2, 1, None)], KEYED)
    assert rows(differing_parts(a, a.repartition(3).orderBy(F.desc("k")), ["ym"])) == []
    once = spark.createDataFrame([(1, 2, None), (1, 1, "x"), (2, 1, None)], KEYED)
    assert rows(differing_parts(a, once, ["ym"])) == [(2,)]
    swapped = spark.createDataFrame([(1, 1, None), (1, 2, "x"), (2, 1, None), (2, 1, None)], KEYED)
    assert rows(differing_parts(a, swapped, ["ym"])) == [(1,)]
    moved = spark.createDataFrame([(1, None, "1"), (1, 1, None)], "ym int, a int, b string")
    back = spark.createDataFrame([(1, 1, None), (1, None, "1")], "ym int, a int, b string")
    assert rows(differing_parts(moved, back, ["ym"])) == []


def test_digests_hold_large_groups(spark):
    table = spark.range(200_000).select(F.lit(1).alias("ym"), (F.col("id") % 3).alias("v"))
    found = part_digests(table, ["ym"]).first()
    assert found["rows"] == 200_000 and found["low"] is not None and found["high"] is not None


def test_changes_of_rows(spark):
    new = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 4, "r"), (1, 4, "r"), (3, 1, "n")], KEYED)
    old = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (1, 3, "z"), (1, 4, "r"), (2, 1, "o")], KEYED)
    assert rows(row_changes(new, old, ["k"], ["ym"])) == [
        (1, 2, "altered", 1, 1), (1, 3, "dropped", 0, 1), (1, 4, "altered", 2, 1), (2, 1, "dropped", 0, 1), (3, 1, "added", 1, 0),
    ]
    assert rows(row_changes(new.limit(0), old.limit(0), ["k"], ["ym"])) == []
    assert rows(row_changes(new.select("k"), old.select("k"), ["k"])) == [(3, "dropped", 0, 1), (4, "altered", 2, 1)]


def test_equal_parts_are_not_read_again(spark, rides, tmp_path):
    months = sorted(r[0] for r in rides.select("ym").distinct().collect())
    late = rides.where((F.col("ym") != months[3]) | (F.minute("Start Time") % 2 != 0))
    write_by_month(rides, f"{tmp_path}/old")
    write_by_month(late, f"{tmp_path}/new")
    new, old = spark.read.parquet(f"{tmp_path}/new"), spark.read.parquet(f"{tmp_path}/old")
    found = snapshot_changes(new, old, ["ym"], ["Ride ID"])
    gone = rides.where((F.col("ym") == months[3]) & (F.minute("Start Time") % 2 == 0))
    assert gone.count() > 0
    assert rows(found, "Ride ID", "change") == rows(gone.select("Ride ID", F.lit("dropped")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert len(filters) == 2 and all(str(months[3]) in f and str(months[4]) not in f for f in filters)
    assert snapshot_changes(old, old, ["ym"], ["Ride ID"]).count() == 0


def test_several_part_keys(spark, rides, tmp_path):
    keys = ["ym", "Start Region"]
    table = rides.where(F.col("Start Region").isNotNull())
    middle = table.agg(F.median("ym")).first()[0]
    gone = (F.col("Start Region") == "JC") & (F.col("ym") < middle)
    for name, df in (("old", table), ("new", table.where(~gone))):
        df.write.partitionBy(*keys).parquet(f"{tmp_path}/{name}")
    new, old = spark.read.parquet(f"{tmp_path}/new"), spark.read.parquet(f"{tmp_path}/old")
    found = snapshot_changes(new, old, keys, ["Ride ID"])
    assert rows(found.select("Start Region", "change").distinct()) == [("JC", "dropped")]
    assert found.count() == table.where(gone).count() > 0


def test_a_backfill_is_profiled_by_its_write(spark, rides, tmp_path):
    new, old = _snapshots(rides.drop("ym"))
    report = write_backfilled(new, old, f"{tmp_path}/month")
    wanted = backfill(new, old)
    assert rows(spark.read.parquet(f"{tmp_path}/month"), *wanted.columns) == rows(wanted)
    profile = null_profile(new, wanted, nonzero_only=False)
    assert rows(report, "column", "before", "after") == rows(profile, "column", "old", "new")


def test_an_empty_month_is_profiled(spark, rides, tmp_path):
    new, old = _snapshots(rides.drop("ym"))
    report = write_backfilled(new.limit(0), old, f"{tmp_path}/month")
    assert {tuple(r)[1:] for r in report.collect()} == {(0, 0)}


@pytest.fixture(scope="module")
def indexed(spark, raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sorted") / "csv")
    text = raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_sorted_csv(text, path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return path, text, index_sorted_csv(spark, path, raw.columns)


def test_the_index_tells_the_files(spark, indexed):
    path, text, index = indexed
    found = index.orderBy("first").collect()
    assert len(found) > 2 and sum(r["rows"] for r in found) == text.count()
    assert all(a["last"] <= b["first"] for a, b in zip(found, found[1:], strict=False))


@pytest.mark.parametrize("first, last", [(202203, 202203), (202201, 202206), (190001, 190012), (190001, 299912)])
def test_months_read_only_files_that_can_hold_them(spark, indexed, first, last):
    path, text, index = indexed
    month = yyyymm(F.col("started_at").cast("timestamp_ntz"))
    got = read_csv_months(spark, path, text.columns, first, last)
    assert rows(got) == rows(text.where(month.between(first, last)))
    files = files_of_months(spark, path, text.columns, first, last)
    if first == last or last < 190100:
        assert len(files) < index.count()
        assert sorted(f.rsplit("/", 1)[-1] for f in files) == sorted(
            r["file"] for r in index.collect() if r["first"].year * 100 + r["first"].month <= last and r["last"].year * 100 + r["last"].month >= first
        )
    if files:
        assert len(got.inputFiles()) == len(files)


def test_files_behind_the_index_are_an_error(spark, raw, tmp_path):
    path = str(tmp_path / "csv")
    text = raw.limit(50).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns])
    write_sorted_csv(text, path)
    index_sorted_csv(spark, path, raw.columns)
    text.limit(3).write.mode("append").option("header", True).option("compression", "gzip").csv(path)
    with pytest.raises(ValueError, match="does not know"):
        files_of_months(spark, path, raw.columns, 202001, 202002)


def test_rows_without_a_start_keep_their_file_in_reach(spark, raw, tmp_path):
    path = str(tmp_path / "csv")
    text = raw.limit(20).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns])
    text = text.withColumn("started_at", F.when(F.col("ride_id") != text.first()["ride_id"], F.col("started_at")))
    write_sorted_csv(text.coalesce(1), path)
    index = index_sorted_csv(spark, path, raw.columns)
    assert index.where("first is null").count() >= 1
    assert read_csv_months(spark, path, raw.columns, 190001, 190012).count() == 0


def test_older_times_are_indexed_by_time_and_not_by_text(spark, tmp_path):
    path = str(tmp_path / "csv")
    header = ["starttime", "stoptime", "bikeid"]
    text = spark.createDataFrame([("10/2/2015 0:00", "10/2/2015 0:09", "1"), ("9/30/2015 0:00:03", "9/30/2015 1:00", "2")], header)
    write_sorted_csv(text, path)
    index_sorted_csv(spark, path, header)
    assert [r["bikeid"] for r in read_csv_months(spark, path, header, 201509, 201509).collect()] == ["2"]
