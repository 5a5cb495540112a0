"""Stored rollups and station states that answer without the rides, and JSON objects in any layout."""

import json

import pytest
from compare import ROOT
from pyspark.sql import functions as F

from velometric.functions.columns import yyyymm
from velometric.operators.conform import conform
from velometric.operators.rollup import rollup
from velometric.operators.stations import station_states, stations
from velometric.plans.lattice import answer, covers, route, write_lattice
from velometric.plans.monthly import all_time_stations, build_station_states
from velometric.sources.documents import read_pair_json, read_station_json
from velometric.sources.event_trips import read_event_trips


@pytest.fixture(scope="module")
def rides(spark):
    return conform(read_event_trips(spark, f"{ROOT}/sf0.001"), region_column="src_region").cache()


@pytest.fixture(scope="module")
def stored(rides, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lattice"))
    write_lattice(rides, root)
    return root


def same(left, right):
    assert left.columns == right.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, right.collect()), key=repr)


def test_covering():
    assert covers(("ymrgtb", "cd"), "rg", "d")
    assert covers(("ymdr", "c"), "wr", "c")
    assert not covers(("ymr", "c"), "w", "c")
    assert not covers(("se", "c"), "s", "d")


@pytest.mark.parametrize("keys, sums", [("r", "cd"), ("ymrgtb", "cd"), ("b", "d"), ("se", "c"), ("e", "c"), ("w", "c"), ("mrw", "cd"), ("yms", "c")])
@pytest.mark.parametrize("by_month", [False, True])
def test_answers_equal_the_direct_rollup(spark, rides, stored, keys, sums, by_month):
    same(answer(spark, stored, keys, sums, by_month), rollup(rides, keys, sums, by_month))


def test_the_smallest_table_is_read_and_no_ride(spark, stored):
    assert route(spark, stored, "s") == ("s", "c")
    assert route(spark, stored, "r", "cd") in (("rwh", "cd"), ("ymrgtb", "cd"))
    assert all("/s_c/" in f for f in answer(spark, stored, "s").inputFiles())
    pruned = answer(spark, stored, "s", months=[202001])
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan and "(ym#" in plan.split("PartitionFilters", 1)[1].split("]")[0]
    with pytest.raises(LookupError):
        route(spark, stored, "n")


def test_months_of_the_lattice_are_replaced(spark, rides, tmp_path):
    root, shapes = str(tmp_path), [("rgt", "cd"), ("r", "cd"), ("t", "c")]
    write_lattice(rides, root, shapes)
    month = yyyymm(F.col("Stop Time"))
    first, second = sorted(r[0] for r in rides.select(month).distinct().collect())[:2]
    few = rides.where((month == first) & (F.col("Gender") == 1))
    write_lattice(few, root, shapes, months=[first, second])
    left = rides.where(~month.isin(first, second)).unionAll(few)
    for keys, sums in (("r", "cd"), ("t", "c"), ("g", "c")):
        same(answer(spark, root, keys, sums, True, shapes=shapes), rollup(left, keys, sums, True))


def test_null_keys_count_for_other_keys(spark, tmp_path):
    rows = [("NYC", None, 1), ("NYC", "Subscriber", 1), (None, "Customer", 2)]
    rides = spark.createDataFrame(rows, "`Start Region` string, `User Type` string, Gender int").withColumns(
        {"Start Time": F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"), "Stop Time": F.lit("2020-01-01 00:01:00").cast("timestamp_ntz")}
    )
    shapes = [("rgt", "c")]
    write_lattice(rides, str(tmp_path), shapes)
    assert [tuple(r) for r in answer(spark, str(tmp_path), "r", shapes=shapes).collect()] == [("NYC", 2)]
    assert sorted(tuple(r) for r in answer(spark, str(tmp_path), "g", shapes=shapes).collect()) == [(1, 2), (2, 1)]


def rounded(dim):
    return sorted((r["id"], r["name"], r["lat"] and round(r["lat"], 6), r["lng"] and round(r["lng"], 6), r["ends"]) for r in dim.collect())


def test_station_states_of_months(spark, rides, tmp_path):
    root = str(tmp_path)
    build_station_states(rides, root)
    month = yyyymm(F.col("Stop Time"))
    first, second, third = sorted(r[0] for r in rides.select(month).distinct().collect())[:3]
    assert rounded(all_time_stations(spark, root)) == rounded(stations(rides))
    assert rounded(all_time_stations(spark, root, [second, third])) == rounded(stations(rides.where(month.isin(second, third))))
    build_station_states(rides.limit(0), root, [second])
    assert rounded(all_time_stations(spark, root)) == rounded(stations(rides.where(month != second)))
    assert all("/stations/states/" in f for f in all_time_stations(spark, root).inputFiles())
    assert station_states(rides.limit(0), by_month=True).count() == 0


STATIONS = {"72": {"name": 'A "q"', "lat": 1.5, "lng": 2.5, "ends": 3}, "JC005": {"name": None, "lat": None, "lng": None, "ends": 0}}
PAIRS = {"0": {"1": 5, "10": 7}, "2": {"0": 1}}


@pytest.mark.parametrize("indent", [None, 2])
def test_whole_objects_in_any_layout(spark, tmp_path, indent):
    (tmp_path / "stations.json").write_text(json.dumps(STATIONS, indent=indent))
    (tmp_path / "pairs.json").write_text(json.dumps(PAIRS, indent=indent))
    got = read_station_json(spark, str(tmp_path / "stations.json"), whole=True).collect()
    assert {r["id"]: {k: r[k] for k in ("name", "lat", "lng", "ends")} for r in got} == STATIONS
    pairs = read_pair_json(spark, str(tmp_path / "pairs.json"), whole=True).collect()
    assert {tuple(r) for r in pairs} == {(0, 1, 5), (0, 10, 7), (2, 0, 1)}


@pytest.mark.parametrize("text", [json.dumps(STATIONS, indent=2), '{\n"72":{"name":"A"\n}\n', "[1, 2]\n", "null\n", '{"72": 5}'])
def test_lines_that_do_not_parse_are_an_error(spark, tmp_path, text):
    (tmp_path / "odd.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED_RECORD|no JSON object"):
        read_station_json(spark, str(tmp_path / "odd.json")).collect()


def test_a_broken_whole_file_is_an_error(spark, tmp_path):
    (tmp_path / "cut.json").write_text(json.dumps(STATIONS, indent=2)[:-30])
    with pytest.raises(Exception, match="MALFORMED_RECORD|no JSON object"):
        read_station_json(spark, str(tmp_path / "cut.json"), whole=True).collect()
