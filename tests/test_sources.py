import datetime as dt
import gzip
import io
import json
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from velometric.operators.conform import conform
from velometric.sinks.writers import (
    csv_sort_columns,
    nonempty_lines,
    repartition_snapshot,
    save,
    write_pair_json,
    write_ride_parts,
    write_sorted_csv,
    write_station_json,
)
from velometric.operators.stations import pair_maps
from velometric.sources import archives
from velometric.sources.archives import (
    RECORDS,
    Records,
    archive_name,
    archive_paths,
    check_headers,
    choose_members,
    list_members,
    read_archives,
    source_months,
)
from velometric.sources.documents import read_pair_json, read_records, read_station_json
from velometric.sources.files import read_month_files, read_stem_parquet, read_trip_csv, without_known_bad_parts
from velometric.sources.manifest import (
    choose_keys,
    file_manifest,
    latest_month,
    manifest_diff,
    month_regions,
    to_import,
)
from velometric.streaming.new_files import append_rollups, new_trip_rows

STEM = "acmebike-tripdata"
OLD_HEADER = ('"tripduration","starttime","stoptime","start station id","start station name","start station latitude",'
              '"start station longitude","end station id","end station name","end station latitude",'
              '"end station longitude","bikeid","usertype","birth year","gender"')
NEW_HEADER = ("ride_id,rideable_type,started_at,ended_at,start_station_name,start_station_id,end_station_name,"
              "end_station_id,start_lat,start_lng,end_lat,end_lng,member_casual")


def old_csv(tag, n=2):
    rows = [f'"9","2018-03-0{i + 1} 00:00:01","2018-03-0{i + 1} 00:05:01","72","{tag}","40.1","-73.9","79","B, ""x""",'
            f'"40.2","-74.0","1{i}","Subscriber","\\N","1"' for i in range(n)]
    return "\n".join([OLD_HEADER, *rows, ""])


def new_csv(tag, n=2, ym="2021-03"):
    rows = [f"{tag}{i},classic_bike,{ym}-0{i + 1} 00:00:01,{ym}-0{i + 1} 00:05:01,S,5329.03,E,JC005,40.1,-73.9,40.2,-74.0,member"
            for i in range(n)]
    return "\n".join([NEW_HEADER, *rows, ""])


def make_zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def paths(spark, *rows):
    return spark.createDataFrame([(str(p), ym, r) for p, ym, r in rows], "path string, ym int, src_region string")


def test_archive_names(spark):
    cases = {(201306, "NYC"): f"2013-{STEM}.zip", (202312, "NYC"): f"2023-{STEM}.zip",
             (202403, "NYC"): f"202403-{STEM}.csv.zip", (202405, "NYC"): f"202405-{STEM}.zip",
             (202101, "JC"): f"JC-202101-{STEM}.csv.zip", (202207, "JC"): "JC-202207-typo.csv.zip",
             (201708, "JC"): f"JC-201708 {STEM}.csv.zip"}
    odd = {("JC", 202207): "JC-202207-typo.csv.zip", ("JC", 201708): f"JC-201708 {STEM}.csv.zip"}
    df = spark.createDataFrame(list(cases), "ym int, r string")
    got = {(r["ym"], r["r"]): r["n"] for r in df.select("ym", "r", archive_name(STEM, F.col("ym"), F.col("r"), odd).alias("n")).collect()}
    assert got == cases
    months = source_months(spark, 201508, 201510)
    assert {tuple(r) for r in archive_paths(months, "/d/", STEM).select("path").collect()} == {
        (f"file:/d/2015-{STEM}.zip",), (f"file:/d/JC-201509-{STEM}.csv.zip",)}


def test_year_archive_with_both_member_types(spark, tmp_path):
    base = f"2018-{STEM}"
    archive = tmp_path / f"{base}.zip"
    archive.write_bytes(make_zip({
        f"{base}/3_March/201803-{STEM}_1.csv": old_csv("one"), f"{base}/3_March/201803-{STEM}_2.csv": old_csv("two", 3),
        f"{base}/201803-{STEM}.csv": old_csv("whole", 4), f"{base}/201804-{STEM}.csv": old_csv("april", 1),
        f"__MACOSX/{base}/3_March/._201803-{STEM}_1.csv": "junk"}))
    members = list_members(paths(spark, (archive, 201803, "NYC"), (archive, 201804, "NYC"))).cache()

    def names(kind):
        return {(r["ym"], r["member"].rsplit("/", 1)[1]) for r in choose_members(members, kind).collect()}

    parts, whole = {(201803, f"201803-{STEM}_1.csv"), (201803, f"201803-{STEM}_2.csv")}, {(201803, f"201803-{STEM}.csv")}
    april = {(201804, f"201804-{STEM}.csv")}
    assert names(1) == parts | april and names(2) == whole | april and names(22) == whole | april
    with pytest.raises(PySparkException):
        names(11)
    rides = conform(read_archives(paths(spark, (archive, 201803, "NYC"))), region_column="src_region")
    got = rides.groupBy("Start Station Name").count().collect()
    assert {tuple(r) for r in got} == {("one", 2), ("two", 3)}
    row = rides.first()
    assert row["End Station Name"] == 'B, "x"' and row["Birth Year"] is None and row["Gender"] == 1
    assert row["Rideable Type"] == "unknown" and row["User Type"] == "Subscriber"


def test_nested_archives(spark, tmp_path):
    base = f"2021-{STEM}"
    year = tmp_path / f"{base}.zip"
    year.write_bytes(make_zip({
        f"{base}/202103-{STEM}.zip": make_zip({f"202103-{STEM}.csv": new_csv("m", 2), f"202103-{STEM}_2.csv": new_csv("n", 1)}),
        f"{base}/202104-{STEM}.zip": make_zip({f"202104-{STEM}.csv": new_csv("a", 1)})}))
    split = tmp_path / f"202409-{STEM}.zip"
    split.write_bytes(make_zip({f"202409-{STEM}_{i}.csv.zip": make_zip({f"202409-{STEM}_{i}.csv": new_csv(f"p{i}", 2, "2024-09")})
                                for i in range(3)} | {f"__MACOSX/._202409-{STEM}_1.csv.zip": b"junk"}))
    jc = tmp_path / f"JC-202103-{STEM}.csv.zip"
    jc.write_bytes(make_zip({f"JC-202103-{STEM}.csv": new_csv("j", 2)}))
    raw = read_archives(paths(spark, (year, 202103, "NYC"), (split, 202409, "NYC"), (jc, 202103, "JC")))
    rides = conform(raw, region_column="src_region", keep=["src_ym"])
    got = {r["Ride ID"]: r for r in rides.collect()}
    assert set(got) == {"m0", "m1", "n0", "j0", "j1", *[f"p{i}{k}" for i in range(3) for k in range(2)]}
    assert got["j0"]["Start Region"] == "JC" and got["m0"]["Start Region"] == "NYC"
    assert got["m0"]["Gender"] == 0 and got["p00"]["src_ym"] == 202409 and got["m0"]["User Type"] == "Subscriber"


def test_differing_headers_are_an_error(spark, tmp_path):
    archive = tmp_path / f"202405-{STEM}.zip"
    archive.write_bytes(make_zip({"a.csv": new_csv("a"), "b.csv": old_csv("b")}))
    members = choose_members(list_members(paths(spark, (archive, 202405, "NYC"))))
    with pytest.raises(PySparkException):
        check_headers(members).collect()


def test_months_without_a_file_are_an_error(spark, tmp_path):
    archive = tmp_path / f"2018-{STEM}.zip"
    archive.write_bytes(make_zip({f"2018-{STEM}/201804-{STEM}.csv": old_csv("april")}))
    assert read_archives(paths(spark, (archive, 201804, "NYC"))).count() == 2
    with pytest.raises(PySparkException, match="no file for 201805 NYC"):
        read_archives(paths(spark, (archive, 201804, "NYC"), (archive, 201805, "NYC"))).collect()


def test_archives_are_listed_by_many_tasks(spark, tmp_path):
    rows = []
    for month in range(1, 13):
        archive = tmp_path / f"JC-2021{month:02d}-{STEM}.csv.zip"
        archive.write_bytes(make_zip({f"JC-2021{month:02d}-{STEM}.csv": new_csv("j", 1)}))
        rows.append((archive, 202100 + month, "JC"))
    contents = list_members(paths(spark, *rows))
    plan = contents._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and contents.count() == 12


def test_schemes_arrow_calls_otherwise(monkeypatch):
    from velometric.sources import archives

    seen = []

    class Store:
        def open_input_file(self, path):
            return path

    monkeypatch.setattr(archives, "pa_fs", type("Fs", (), {
            "FileSystem": type("F", (), {"from_uri": staticmethod(lambda uri: (seen.append(uri), (Store(), "b/k.zip"))[1])}),
            "LocalFileSystem": Store}))
    assert archives._open("s3a://b/k.zip") == "b/k.zip" and seen == ["s3://b/k.zip"]
    assert archives._open("file:/d/a b.zip") == "/d/a b.zip" and archives._open("/d/a.zip") == "/d/a.zip"


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(new_csv("a", 2).replace("classic_bike", "NULL"))
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write(new_csv("b", 3))
    header = NEW_HEADER.split(",")
    df = read_trip_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz")], header)
    got = {r["ride_id"]: r["rideable_type"] for r in df.collect()}
    assert got == {"a0": None, "a1": None, "b0": "classic_bike", "b1": "classic_bike", "b2": "classic_bike"}
    with pytest.raises(Exception, match="CSV header"):
        read_trip_csv(spark, str(tmp_path / "a.csv"), header[::-1]).collect()


def test_sorted_csv(spark, tmp_path):
    src, out = tmp_path / "raw.csv", str(tmp_path / "sorted")
    lines = new_csv("x", 9).splitlines()
    src.write_text("\n".join([lines[0], *lines[:0:-1], "", ""]))
    raw = read_trip_csv(spark, str(src), NEW_HEADER.split(","))
    assert nonempty_lines(spark, str(src)) == 9
    assert write_sorted_csv(raw, out, expected_rows=9) == 9
    files = sorted((tmp_path / "sorted").glob("*.csv.gz"))
    starts = [row.split(",")[2] for f in files for row in gzip.open(f, "rt").read().splitlines()[1:]]
    assert starts == sorted(starts) and len(starts) == 9
    with pytest.raises(ValueError):
        write_sorted_csv(raw, str(tmp_path / "bad"), expected_rows=8)
    assert csv_sort_columns(["starttime", "stoptime", "bikeid"]) == ["starttime", "stoptime", "bikeid"]
    assert csv_sort_columns(["ride_id", "started_at", "ended_at", "Bike ID"]) == ["started_at", "ended_at", "ride_id"]
    with pytest.raises(ValueError):
        csv_sort_columns(["starttime", "stoptime"])


RECORD_TEXTS = {
    b"": 0, b"a,b": 1, b"a,b\n": 1, b"a\n\n\nb\n": 2, b"a\r\nb\r\n\r\nc": 3, b"a\rb": 2, b'"a\nb",c\n': 1,
    b'"a""b\n",c\nd\n': 2, b'5" pipe,"x\ny"\nz\n': 2, b'"","a"\n"b",""\n': 2, b'a,",""\n""",b\nc\n': 2, b'"a\n\nb': 1,
}


@pytest.mark.parametrize("text, want", RECORD_TEXTS.items())
def test_records_are_counted_from_bytes(text, want):
    """However the bytes are cut."""
    for step in range(1, len(text) + 2):
        records = Records()
        for at in range(0, len(text), step):
            records.feed(text[at : at + step])
        assert records.total() == want


def test_lost_rows_are_an_error(spark, tmp_path):
    (tmp_path / "JC-202403-x.csv.zip").write_bytes(make_zip({"JC-202403-x.csv": new_csv("a", 9)}))
    (tmp_path / "202403-x.csv.zip").write_bytes(make_zip({"1.csv": new_csv("b", 4), "2.csv": new_csv("c", 3), "3.csv": NEW_HEADER + "\n"}))
    wanted = paths(spark, (tmp_path / "JC-202403-x.csv.zip", 202403, "JC"), (tmp_path / "202403-x.csv.zip", 202403, "NYC"))
    trips = read_archives(wanted, records=True)
    told = {r["src_region"]: r["n"] for r in trips.groupBy("src_region").agg(F.sum(RECORDS).alias("n")).collect()}
    assert told == {"JC": 9, "NYC": 7}
    assert RECORDS not in read_archives(wanted).columns
    rows = trips.drop("src_ym", "src_region")
    assert write_sorted_csv(rows, str(tmp_path / "all"), records=RECORDS) == 16
    for lost in ("a1", "b3", "c0"):
        with pytest.raises(ValueError, match="expected"):
            write_sorted_csv(rows.where(F.col("Ride ID") != lost), str(tmp_path / lost), records=RECORDS)


def test_a_parser_that_loses_rows_is_an_error(monkeypatch):
    class Short:
        def __init__(self, stream):
            stream.read()
            self.rows = pa.record_batch({f"c{i}": pa.array(["x"]) for i in range(13)})

        def __iter__(self):
            return iter([self.rows])

    monkeypatch.setattr(archives.pa_csv, "open_csv", lambda stream, **kw: Short(stream))
    with pytest.raises(ValueError, match="read 1 rows of 2 records"):
        list(archives._member_batches(archives._Rest(io.BytesIO(new_csv("a", 2).encode()))))


def test_stem_parquet_layout(spark, tmp_path):
    for src, stem, n in [(202001, "202001_202001", 2), (202002, "202001_202001", 1)]:
        folder = tmp_path / str(src)
        folder.mkdir(exist_ok=True)
        pq.write_table(pa.table({"Ride ID": [f"{src}-{i}" for i in range(n)]}), folder / f"{stem}.parquet")
    df = read_stem_parquet(spark, f"{tmp_path}/20*/20*_202001.parquet")
    assert {(r["src_ym"], r["stop_ym"], r["Ride ID"]) for r in df.collect()} == {
        (202001, 202001, "202001-0"), (202001, 202001, "202001-1"), (202002, 202001, "202002-0")}
    pq.write_table(pa.table({"n": [1]}), tmp_path / "s_c_202003.parquet")
    assert read_month_files(spark, f"{tmp_path}/s_c_*.parquet").first()["ym"] == 202003


def test_known_bad_part(spark):
    df = spark.createDataFrame([(201306, 201307, 201307), (201307, 201307, 201307)], "src_ym int, start_ym int, stop_ym int")
    assert without_known_bad_parts(df).count() == 1


def test_parts_replace_their_source_month(spark, tmp_path):
    root = str(tmp_path / "rides")
    rows = [(202001, 202001, 202001, "a"), (202001, 202001, 202002, "b"), (202002, 202002, 202002, "c")]
    df = spark.createDataFrame(rows, "src_ym int, start_ym int, stop_ym int, `Ride ID` string").withColumn(
        "Start Time", F.lit(dt.datetime(2020, 1, 1))).withColumn("Stop Time", F.lit(dt.datetime(2020, 1, 1)))
    write_ride_parts(df, root, [202001, 202002])
    write_ride_parts(df.where("`Ride ID` = 'a'"), root, [202001])
    back = spark.read.parquet(root)
    assert {r["Ride ID"] for r in back.collect()} == {"a", "c"}
    # A failing write leaves the old rows; a source month may lose all of its parts.
    bad = df.withColumn("Ride ID", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(PySparkException):
        write_ride_parts(bad, root, [202001, 202002])
    assert {r["Ride ID"] for r in spark.read.parquet(root).collect()} == {"a", "c"}
    write_ride_parts(df.limit(0), root, [202001])
    assert {r["Ride ID"] for r in spark.read.schema(df.schema).parquet(root).collect()} == {"c"}
    write_ride_parts(df.where("`Ride ID` = 'a'"), root, [202001])
    back = spark.read.parquet(root)
    plan = back.where("stop_ym = 202002")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stop_ym" in plan


def test_json_documents(spark, tmp_path):
    dim = spark.createDataFrame([("72", 'A "q"', 1.5, 2.5, 3), ("JC005", None, None, None, 0)],
                                "id string, name string, lat double, lng double, ends bigint")
    write_station_json(dim, str(tmp_path / "st"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "st").glob("part-*")))
    assert json.loads(text) == {"72": {"name": 'A "q"', "lat": 1.5, "lng": 2.5, "ends": 3},
                                "JC005": {"name": None, "lat": None, "lng": None, "ends": 0}}
    assert {tuple(r) for r in read_station_json(spark, str(tmp_path / "st")).collect()} == {tuple(r) for r in dim.collect()}
    pairs = spark.createDataFrame([(0, 1, 5), (0, 10, 7), (2, 0, 1)], "sidx bigint, eidx bigint, count bigint")
    write_pair_json(pair_maps(pairs), str(tmp_path / "se"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "se").glob("part-*")))
    assert json.loads(text) == {"0": {"1": 5, "10": 7}, "2": {"0": 1}}
    (tmp_path / "one.json").write_text('{"0":{"1":5,"10":7},"2":{"0":1}}')
    for source in ("se", "one.json"):
        assert {tuple(r) for r in read_pair_json(spark, str(tmp_path / source)).collect()} == {(0, 1, 5), (0, 10, 7), (2, 0, 1)}
    (tmp_path / "rec.json").write_text('[{"Year":2020,"Month":1,"Count":3,"Duration":60,"Region":"JC","User Type":"Daily","Gender":0,"Rideable Type":"unknown"}]')
    assert read_records(spark, str(tmp_path / "rec.json"), array=True).first()["Count"] == 3


def test_manifests(spark, tmp_path):
    for name in ("a.zip", "b.zip", "note.txt"):
        (tmp_path / name).write_text(name)
    found = file_manifest(spark, str(tmp_path), "*.zip")
    assert {(r["path"].rsplit("/", 1)[1], r["size"]) for r in found.collect()} == {("a.zip", 5), ("b.zip", 5)}
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, etag string")
    current = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, etag string")
    diff = manifest_diff(stored, current)
    assert {r["path"]: r["status"] for r in diff.collect()} == {"a": "same", "b": "changed", "c": "gone", "d": "new"}
    assert {r["path"] for r in to_import(diff).collect()} == {"b", "d"}
    assert choose_keys(stored, include="^[ab]").count() == 2 and choose_keys(stored, exclude="a").count() == 2
    with pytest.raises(ValueError):
        choose_keys(stored, "a", "b")


def test_latest_month(spark):
    def latest(*rows):
        return latest_month(month_regions(spark.createDataFrame(list(rows), "ym int, src_region string")))

    assert latest((201508, "NYC"), (201509, "NYC"), (201509, "JC")) == 201509
    assert latest((201509, "NYC"), (201509, "JC"), (201510, "NYC")) == 201509
    with pytest.raises(RuntimeError):
        latest((201509, "NYC"), (201510, "NYC"))


def test_save_policy(spark, tmp_path):
    path = str(tmp_path / "t")
    save(spark.range(3), path)
    save(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    save(spark.range(5), path, overwrite=True)
    assert spark.read.parquet(path).count() == 5


def test_stream_of_new_files(spark, tmp_path):
    src, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    src.mkdir()

    def catch_up():
        query = append_rollups(new_trip_rows(spark, str(src), NEW_HEADER.split(",")), out, log, "ym", "c")
        query.awaitTermination(120)
        return spark.read.parquet(out).agg(F.sum("Count")).first()[0]

    (src / "a.csv").write_text(new_csv("a", 3))
    assert catch_up() == 3
    (src / "b.csv").write_text(new_csv("b", 2))
    assert catch_up() == 5


def test_old_snapshot_is_split_into_parts(spark, tmp_path):
    rows = [("2020-01-31 23:00:00", "2020-02-01 00:10:00", "72", "M"), ("2020-01-05 01:00:00", "2020-01-05 01:10:00", "SYS001", "F"),
            ("2020-01-06 01:00:00", "2020-01-06 01:10:00", "72.0", "F")]
    old = spark.createDataFrame(rows, "`Start Time` string, `Stop Time` string, `Start Station ID` string, Gender string")
    old = old.withColumn("End Station ID", F.lit("JC005"))
    repartition_snapshot(old, str(tmp_path / "v0"), 202001)
    got = spark.read.parquet(str(tmp_path / "v0")).select("src_ym", "start_ym", "stop_ym", "Start Station ID", "Gender").collect()
    assert {tuple(r) for r in got} == {(202001, 202001, 202002, "72", 1), (202001, 202001, 202001, "72", 2)}
