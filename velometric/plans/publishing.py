"""Stand-in for the publisher: trips as zip archives in the layouts of different years, for the queries that read them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pa_csv
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velometric.session import scratch_path
from velometric.sources.archives import qualified
from velometric.sources.manifest import file_manifest

# Stand-in for the publisher's file stem.
STEM = "bikeshare-tripdata"
PLACE = ["archive", "nested", "member"]


def _place(archive: str, nested: str | None, member: str) -> Column:
    return F.struct(F.lit(archive).alias("archive"), F.lit(nested).alias("nested"), F.lit(member).alias("member"))


def mixed_layouts() -> Column:
    """Month-folder parts of 2018, a nested month of 2021, a direct and a nested month of 2024, and Jersey City's file."""
    turn = F.col("ride_id").cast("bigint") % 5
    return (
        F.when(F.col("src_region") == "JC", _place(f"JC-202405-{STEM}.csv.zip", None, f"JC-202405-{STEM}.csv"))
        .when(turn == 0, _place(f"2018-{STEM}.zip", None, f"2018-{STEM}/3_March/201803-{STEM}_1.csv"))
        .when(turn == 1, _place(f"2018-{STEM}.zip", None, f"2018-{STEM}/3_March/201803-{STEM}_2.csv"))
        .when(turn == 2, _place(f"2021-{STEM}.zip", f"2021-{STEM}/202103-{STEM}.zip", f"202103-{STEM}.csv"))
        .when(turn == 3, _place(f"202405-{STEM}.zip", None, f"202405-{STEM}_1.csv"))
        .otherwise(_place(f"202406-{STEM}.zip", f"202406-{STEM}_1.csv.zip", f"202406-{STEM}_1.csv"))
    )


def both_member_types() -> Column:
    """One year archive with a month as folder parts (even ids) and as one file (odd ids)."""
    base = f"2018-{STEM}"
    parts = _place(f"{base}.zip", None, f"{base}/3_March/201803-{STEM}_1.csv")
    whole = _place(f"{base}.zip", None, f"{base}/201803-{STEM}.csv")
    return F.when(F.col("ride_id").cast("bigint") % 2 == 0, parts).otherwise(whole)


class _Archives:
    """Writes members one after the other; an archive gets its final name when it is complete."""

    def __init__(self, root: str) -> None:
        if "://" in root:
            self.fs, base = pa_fs.FileSystem.from_uri(root)
        else:
            self.fs, base = pa_fs.LocalFileSystem(), root.removeprefix("file:")
        task = TaskContext.get()
        self.folder, self.attempt = f"{base}/part-{task.partitionId():05d}", task.taskAttemptId()
        self.place: tuple = (None, None, None)
        self.open: list = [None, None, None]
        self.count = 0

    def write(self, place: tuple, rows: pa.Table) -> None:
        fresh = place != self.place
        if fresh:
            self.turn_to(place)
        block = io.BytesIO()
        pa_csv.write_csv(rows, block, pa_csv.WriteOptions(include_header=fresh))
        self.open[2].write(block.getvalue())

    def turn_to(self, place: tuple) -> None:
        self.close(next(i for i in range(3) if place[i] != self.place[i]))
        archive, nested, member = place
        if archive and self.open[0] is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.raw = self.fs.open_output_stream(f"{self.folder}/{archive}.{self.attempt}")
            self.open[0] = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_DEFLATED)
        if nested and self.open[1] is None:
            self.inner = io.BytesIO()
            self.open[1] = zipfile.ZipFile(self.inner, "w", zipfile.ZIP_DEFLATED)
        if member:
            self.open[2] = (self.open[1] or self.open[0]).open(member, "w", force_zip64=True)
        self.place = place

    def close(self, level: int) -> None:
        """Closes the member, and from `level` on what holds it."""
        if self.open[2]:
            self.open[2].close()
        if self.open[1] and level <= 1:
            self.open[1].close()
            self.open[0].writestr(self.place[1], self.inner.getvalue())
        if self.open[0] and level == 0:
            self.open[0].close()
            self.raw.close()
            self.fs.move(f"{self.folder}/{self.place[0]}.{self.attempt}", f"{self.folder}/{self.place[0]}")
            self.count += 1
        self.open[level:] = [None] * (3 - level)
        self.open[2] = None


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Archives(root)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            places = list(zip(*(table[c].to_pylist() for c in PLACE), strict=True))
            rows = table.drop_columns(PLACE)
            begin = 0
            for end in range(1, len(places) + 1):
                if end == len(places) or places[end] != places[begin]:
                    out.write(places[begin], rows.slice(begin, end - begin))
                    begin = end
        out.close(0)
        yield pa.RecordBatch.from_pydict({"archives": pa.array([out.count], pa.int32())})

    return write


def publish(spark: SparkSession, raw: DataFrame, place: Column) -> DataFrame:
    """Writes text rows to archives and lists these: path, month and region of each wanted file."""
    root = qualified(spark, scratch_path(spark, "archives"))
    placed = raw.withColumn("__place", place).select(
        *[F.col("__place")[c].alias(c) for c in PLACE],
        *[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns if c != "src_region"],
    )
    placed.sortWithinPartitions(*PLACE).mapInArrow(_writer(root), "archives int").agg(F.sum("archives")).collect()
    name = F.element_at(F.split("path", "/"), -1)
    month = F.regexp_extract(name, r"(\d{6})-", 1)
    return file_manifest(spark, root, "*.zip").select(
        "path",
        F.when(name.startswith("2018-"), F.lit(201803))
        .when(name.startswith("2021-"), F.lit(202103))
        .otherwise(month.try_cast("int"))
        .alias("ym"),
        F.when(name.startswith("JC-"), F.lit("JC")).otherwise(F.lit("NYC")).alias("src_region"),
    )
