"""How often the rows of a sorted CSV are made."""

from velometric.plans import monthly
from velometric.sources import archives


def test_archives_are_scanned_once_for_a_sorted_csv(spark, tmp_path, monkeypatch):
    """The sampling of the range bounds does not read the members a second time."""
    scanned = spark.sparkContext.accumulator(0)
    names = ["Start Time", "Stop Time", "Ride ID"]
    schema = ", ".join(f"`{n}` string" for n in names) + f", {archives.RECORDS} bigint, src_ym int, src_region string"

    def scan(batches):
        for batch in batches:
            scanned.add(batch.num_rows)
            yield batch

    rows = [(f"2024-05-{i % 28 + 1:02d}", "2024-06-01", f"r{i}", 500 if i == 499 else None, 202405, "NYC") for i in range(500)]
    trips = spark.createDataFrame(rows, schema).repartition(4).mapInArrow(scan, schema)
    monkeypatch.setattr(monthly, "read_archives", lambda *args, **kwargs: trips)
    paths = spark.createDataFrame([("x.zip", 202405, "NYC")], "path string, ym int, src_region string")
    [(path, region, header)] = monthly.build_sorted_csvs(paths, str(tmp_path))
    assert scanned.value == 500
    assert spark.read.option("header", True).csv(path).count() == 500 and header == names
