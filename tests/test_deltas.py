"""Changed months carried to the rollups, and builds that stop on the way."""

import os

import pytest
from pyspark.sql import functions as F

from velometric.operators.rollup import STANDARD_ROLLUPS, merge_signed, rollup, signed
from velometric.plans import deltas, monthly
from velometric.plans.deltas import apply_changes
from velometric.plans.monthly import build_rides, build_rollups
from velometric.sinks import writers
from velometric.sinks.writers import write_by_month
from velometric.sources.event_trips import read_event_trips
from velometric.sources.manifest import changed_months, manifest_diff

FOLDER = f"{os.environ.get('TESTDATA_ROOT', '/root/testdata')}/sf0.001"


class Stopped(Exception):
    pass


def stop_at(monkeypatch, module, name, call=1):
    """The given call of a function stops the run before it does anything."""
    plain, seen = getattr(module, name), [0]

    def wrapped(*args, **kw):
        seen[0] += 1
        if seen[0] == call:
            raise Stopped(name)
        return plain(*args, **kw)

    monkeypatch.setattr(module, name, wrapped)


@pytest.fixture(scope="module")
def raw(spark):
    trips = read_event_trips(spark, FOLDER)
    return trips.withColumn("src_ym", F.year("started_at") * 100 + F.month("started_at")).cache()


def regions(rows):
    return [(rows.where(F.col("src_region") == r).drop("src_region"), r) for r in ("NYC", "JC")]


def counts(spark, root):
    return {r["ym"]: r["count"] for r in spark.read.parquet(f"{root}/rides").groupBy("ym").count().collect()}


def hidden(root):
    return sorted(p.name for p in root.rglob("_*") if p.is_dir() and p.name != "_temporary")


def spread_month(raw):
    """One source month whose rides end in several months, and the same with the early ones only."""
    rows = raw.where("src_ym between 202111 and 202204").withColumn("src_ym", F.lit(202111))
    return rows, rows.where("ended_at < timestamp'2022-02-01'")


def test_a_build_stopped_between_parts_and_months(spark, tmp_path, raw, monkeypatch):
    rows, early = spread_month(raw)
    other = raw.where("src_ym = 202203").withColumn("src_ym", F.lit(202203)).where("hour(started_at) = 5")
    build_rides(spark, regions(rows), str(tmp_path), [202111])
    assert max(counts(spark, tmp_path)) > 202201
    stop_at(monkeypatch, monthly, "write_by_month")
    with pytest.raises(Stopped):
        build_rides(spark, regions(early), str(tmp_path), [202111])
    assert max(counts(spark, tmp_path)) > 202201
    monkeypatch.undo()
    # The next build is of another source month: what the first left open is finished all the same.
    build_rides(spark, regions(other), str(tmp_path), [202203])
    plain = tmp_path / "plain"
    build_rides(spark, regions(early), str(plain), [202111])
    build_rides(spark, regions(other), str(plain), [202203])
    assert counts(spark, tmp_path) == counts(spark, plain)
    assert not hidden(tmp_path)


@pytest.mark.parametrize("name, call", [("_swap", 1), ("remove", 1), ("remove", 2), ("remove", 3), ("note", 1)])
def test_a_swap_stopped_on_the_way(spark, tmp_path, monkeypatch, name, call):
    """Before the overwrite, before an emptied part goes, before staging table and note go, before the note is written."""
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(202001, 1), (202002, 2), (202003, 3)], "ym int, n int")
    write_by_month(rows, path)
    stop_at(monkeypatch, writers, name, call)
    with pytest.raises(Stopped):
        write_by_month(rows.where("ym = 202001").withColumn("n", F.lit(11)), path, months=[202001, 202002])
    monkeypatch.undo()
    write_by_month(rows.where("ym = 202003").withColumn("n", F.lit(13)), path)
    first = {(202001, 1), (202002, 2)} if name == "note" else {(202001, 11)}
    assert {tuple(r) for r in spark.read.parquet(path).select("ym", "n").collect()} == first | {(202003, 13)}
    assert not hidden(tmp_path)


def test_signed_changes(spark):
    old = spark.createDataFrame([("a", 3, 30), ("b", 2, 20), ("c", 1, 10)], "k string, Count long, Duration long")
    out = spark.createDataFrame([("a", 1, 5), ("b", 2, 20)], old.schema)
    new = spark.createDataFrame([("a", 4, 1), ("d", 1, 7)], old.schema)
    got = {tuple(r) for r in merge_signed(old, signed(out, -1), signed(new, 1)).collect()}
    assert got == {("a", 6, 26), ("c", 1, 10), ("d", 1, 7)}
    with pytest.raises(Exception, match="more rides than there are"):
        merge_signed(old, signed(new, -1)).collect()


def rollups(spark, root):
    tables = (spark.read.parquet(f"{root}/aggregated/{k}_{s}") for k, s in STANDARD_ROLLUPS)
    return [{tuple(r[c] for c in sorted(t.columns)) for r in t.collect()} for t in tables]


def changed_rows(raw):
    months = sorted(r[0] for r in raw.select("src_ym").distinct().collect())
    # One month inside the months that are merged, one outside, one that is gone afterwards.
    inside, outside, gone = 202006, 202109, months[-1]
    first = raw.where(~(F.col("src_ym").isin(inside, outside) & (F.col("ride_id").cast("bigint") % 3 == 0)))
    return first, raw.where(F.col("src_ym") != gone), months, [inside, outside, gone]


@pytest.mark.parametrize("module, name, call", [(None, "", 0), (deltas, "build_rides", 1), (monthly, "write_by_month", 1), (deltas, "_prepare", 1), (deltas, "write_by_month", 2)])
def test_changes_equal_a_full_build(spark, tmp_path, raw, monkeypatch, module, name, call):
    """Whether or not the run stops before the rides, within them, before the rollups or between two of them."""
    first, last, months, changed = changed_rows(raw)
    build_rollups(build_rides(spark, regions(first), str(tmp_path), months), str(tmp_path))
    again = regions(last.where(F.col("src_ym").isin(changed)))
    if module:
        stop_at(monkeypatch, module, name, call)
        with pytest.raises(Stopped):
            apply_changes(spark, again, str(tmp_path), changed)
        monkeypatch.undo()
    apply_changes(spark, again, str(tmp_path), changed)
    plain = tmp_path / "plain"
    build_rollups(build_rides(spark, regions(last), str(plain), months), str(plain))
    assert rollups(spark, tmp_path) == rollups(spark, plain)
    assert counts(spark, tmp_path) == counts(spark, plain)
    assert not hidden(tmp_path)


def test_changes_read_changed_sources_only(spark, tmp_path, raw):
    first, _, months, _ = changed_rows(raw)
    build_rides(spark, regions(first), str(tmp_path), months)
    parts = spark.read.parquet(f"{tmp_path}/normalized")
    text = deltas.contributions(parts, [202109], "ymrgtb", "cd")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in text and "src_ym" in text.split("PartitionFilters: [")[1].split("]")[0]
    own = parts.where("src_ym = 202109")
    assert deltas.contributions(parts, [202109], "ymrgtb", "cd").count() == rollup(own, "ymrgtb", "cd", by_month=True).count()


def test_changed_months(spark):
    stored = spark.createDataFrame([("a/JC-202001-x.zip", "1"), ("202002-x.zip", "1"), ("202003-x.zip", "1"), ("readme", "1")], "path string, etag string")
    current = spark.createDataFrame([("a/JC-202001-x.zip", "2"), ("202003-x.zip", "1"), ("202004-x.zip", "1"), ("readme", "2")], stored.schema)
    assert changed_months(manifest_diff(stored, current)) == [202001, 202002, 202004]
