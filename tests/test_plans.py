"""End-to-end months, plan shapes and hot keys."""

import datetime as dt

import pytest
from compare import ROOT
from pyspark.sql import functions as F

from velometric.operators.conform import conform
from velometric.operators.dedupe import DuplicateKeyError, exact_dedupe, keyed_copies, once_only
from velometric.operators.rollup import rollup
from velometric.operators.stations import row_sketch, station_hist, stations
from velometric.plans.monthly import build_dashboard, build_month_documents, build_rides, build_rollups
from velometric.session import checkpoint_root
from velometric.sources.documents import read_pair_json, read_station_json
from velometric.sources.event_trips import read_event_trips

FOLDER = f"{ROOT}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rides(spark):
    return conform(read_event_trips(spark, FOLDER), region_column="src_region")


def test_month_build(spark, tmp_path):
    raw = read_event_trips(spark, FOLDER).withColumn("src_ym", F.year("started_at") * 100 + F.month("started_at"))
    raws = [(raw.where(F.col("src_region") == r), r) for r in ("NYC", "JC")]
    months = sorted(r[0] for r in raw.select("src_ym").distinct().collect())
    root = str(tmp_path)
    built = build_rides(spark, raws, root, months)
    expected = conform(raw, region_column="src_region")
    assert built.count() == expected.count()
    build_rollups(built, root)
    total = build_dashboard(spark, root).agg(F.sum("Count"), F.sum("Duration")).first()
    direct = rollup(expected, "ymrgtb", "cd").agg(F.sum("Count"), F.sum("Duration")).first()
    assert tuple(total) == tuple(direct)
    ym = built.groupBy("ym").count().orderBy(F.desc("count")).first()["ym"]
    build_month_documents(spark, built, root, ym)
    month = built.where(F.col("ym") == ym)
    assert read_station_json(spark, f"{root}/documents/{ym}/stations.json").count() == stations(month).count()
    pairs = read_pair_json(spark, f"{root}/documents/{ym}/se_c.json")
    se_c = rollup(month, "se", "c")
    assert pairs.agg(F.sum("count")).first()[0] == se_c.agg(F.sum("Count")).first()[0]
    # Building one source month again leaves the rest alone and adds nothing.
    again = [(raw.where((F.col("src_region") == r) & (F.col("src_ym") == months[0])), r) for r in ("NYC", "JC")]
    build_rides(spark, again, root, months[:1])
    assert spark.read.parquet(f"{root}/rides").count() == expected.count()


def test_rollup_consistency(rides):
    both = rides.where(F.col("Start Station ID").isNotNull() & F.col("End Station ID").isNotNull()).count()
    for keys in ("se", "s", "e"):
        assert rollup(rides, keys, "c").agg(F.sum("Count")).first()[0] == both


def test_scans_are_pruned(spark, tmp_path, rides):
    path = str(tmp_path / "rides")
    rides.write.parquet(path)
    text = plan(rollup(spark.read.parquet(path).where(F.col("Start Region") == "JC"), "ym", "c"))
    assert "ReadSchema: struct<Start Time:timestamp_ntz,Start Region:string>" in text
    assert "EqualTo(`Start Region`,JC)" in text and text.count("Exchange") == 1


def test_conforming_is_narrow(rides):
    assert "Exchange" not in plan(rides)


def test_station_table_scans_once(rides):
    assert plan(stations(rides)).count("FileScan") == 1


def test_first_per_key_limits_before_the_shuffle(rides):
    from velometric.operators.dedupe import first_per_key

    assert plan(first_per_key(rides, ["Start Station ID"], "Start Time")).count("WindowGroupLimit") == 2


def hot_rides(spark, n=30000):
    """A third of the rows are copies of one ride; another third start at one station in distinct places."""
    at = dt.datetime(2020, 5, 1)
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, F.lit("copy")).otherwise(i.cast("string")).alias("Ride ID"),
        F.when(i % 3 == 0, F.lit(at)).otherwise(F.timestamp_add("SECOND", i.cast("int"), F.lit(at))).alias("Start Time"),
        F.lit(at + dt.timedelta(days=1)).alias("Stop Time"),
        F.when(i % 3 == 1, F.lit("72")).otherwise((i % 50 + 1000).cast("string")).alias("Start Station ID"),
        F.lit("79").alias("End Station ID"),
        F.lit("A").alias("Start Station Name"),
        F.lit("B").alias("End Station Name"),
        F.when(i % 3 == 1, i / 1e6).otherwise(F.lit(1.0)).alias("Start Station Latitude"),
        F.lit(2.0).alias("Start Station Longitude"),
        F.lit(1.0).alias("End Station Latitude"),
        F.lit(2.0).alias("End Station Longitude"),
    )


def test_hot_keys_keep_results_whole(spark):
    hot = hot_rides(spark)
    assert exact_dedupe(hot).count() == 20000 + _distinct_copies(hot)
    assert keyed_copies(hot, ["Ride ID"]).count() == 10000
    assert once_only(hot, ["Ride ID"]).count() == 20000
    sketch = {r["id"]: r for r in row_sketch(station_hist(hot, "il")).collect()}
    assert sketch["72"]["num"] == 10000 and [tuple(r) for r in sketch["72"]["runs"]] == [(1, 10000)]
    assert sketch["79"]["mode_count"] == 30000


def _distinct_copies(hot):
    return hot.where("`Ride ID` = 'copy'").distinct().count()


def test_shared_folder_comes_from_the_session(spark):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_clashing_rides_leave_the_table_untouched(spark, tmp_path):
    raw = read_event_trips(spark, FOLDER).withColumn("src_ym", F.lit(202301))
    clash = raw.unionAll(raw.withColumn("member_casual", F.lit("casual"))).where("src_region = 'JC'")
    with pytest.raises(DuplicateKeyError):
        build_rides(spark, [(clash, "JC")], str(tmp_path), [202301])
    left = list((tmp_path / "rides").glob("*")) if (tmp_path / "rides").exists() else []
    assert not [p for p in left if p.name.startswith(("ym=", "_staging"))]


def test_merging_leaves_single_rides_unshuffled(spark, rides):
    """Rows of repeated keys alone are shuffled; the others pass a broadcast anti join."""
    from velometric.operators.dedupe import merge_pairs

    again = rides.where("`Start Station ID` = 'JC065'").withColumn("file", F.lit("b"))
    merged = merge_pairs(rides.withColumn("file", F.lit("a")).unionByName(again))
    text = plan(merged)
    assert "LeftAnti" in text and "LeftSemi" in text and "SortMergeJoin" not in text
    assert text.count("Exchange hashpartitioning") == 1
    assert merged.count() == rides.count()


def test_a_hot_key_fails_in_the_count(spark, rides):
    from velometric.operators.dedupe import merge_pairs

    hot = hot_rides(spark).withColumns({"file": F.lit("a"), "Gender": F.lit(0), "Birth Year": F.lit(1), "Bike ID": F.lit(1)})
    with pytest.raises(DuplicateKeyError):
        merge_pairs(hot)


def test_a_failing_overwrite_keeps_the_staging_table(spark, tmp_path, monkeypatch):
    """Until the table holds the new rows, the verified ones stay in the staging table."""
    from pyspark.sql import DataFrameWriter

    from velometric.sinks.writers import write_by_month

    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(202001, 1), (202002, 2)], "ym int, n int")
    write_by_month(rows, path)
    plain = DataFrameWriter.parquet

    def broken(self, to, *args, **kw):
        if to == path:
            raise OSError("no space left")
        return plain(self, to, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(OSError):
        write_by_month(rows.withColumn("n", F.col("n") + 10), path)
    assert {tuple(r) for r in spark.read.parquet(path).select("ym", "n").collect()} == {(202001, 1), (202002, 2)}
    staged = next((tmp_path / "table").glob("_staging-*"))
    assert {tuple(r) for r in spark.read.parquet(str(staged)).select("ym", "n").collect()} == {(202001, 11), (202002, 12)}
    monkeypatch.undo()
    write_by_month(rows.withColumn("n", F.col("n") + 10).where("ym = 202001"), path, months=[202001, 202002])
    assert {tuple(r) for r in spark.read.parquet(path).select("ym", "n").collect()} == {(202001, 11)}
