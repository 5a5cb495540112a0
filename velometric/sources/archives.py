"""Zipped and plain CSV files, read member by member in Spark tasks.

The table of contents of each archive becomes rows (one per CSV member); choosing members, checking
headers and spreading the work are DataFrame steps. Tasks only decompress and tokenise: a member is
streamed through Arrow's CSV reader in blocks, never held whole. A member cannot be split
(deflate is sequential), so its rows are spread over the cluster right after the scan.
"""

from __future__ import annotations

import contextlib
import csv
import io
import itertools
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.csv as pa_csv
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velometric.functions.columns import lookup
from velometric.functions.months import months_between
from velometric.schema import (
    DROPPED_COLUMNS,
    FIRST_MONTH,
    HEADER_ALIASES,
    MEMBER_TO_USER,
    NULL_TOKENS,
    squash_header,
)
from velometric.sources.manifest import region_available

MEMBER_SCHEMA = "path string, nested string, member string, bytes bigint, header string"
# Text columns handed on by the scan: every canonical source column, as strings.
TEXT_COLUMNS = sorted(set(HEADER_ALIASES.values()))
# On the last row of every member: how many records its bytes hold.
RECORDS = "__records"
# What a column is taken as when a file lacks it.
MISSING_DEFAULTS = {"Gender": "0", "Rideable Type": "unknown"}
# Arrow's reader runs up to 32 blocks ahead of its consumer, and parses as many as there are cores.
BLOCK_BYTES = 1 << 20
SPOOL_BYTES = 64 << 20
# Spark's names of file systems that Arrow calls otherwise.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfs", "wasb": "abfs"}


def archive_name(stem: str, ym: Column, region: Column, irregular: Mapping[tuple[str, int], str] | None = None) -> Column:
    """Published archive name of a month and region.

    `stem` is the publisher's file stem. Years before 2024 come as one archive for the main region. `irregular` names the
    archives, by region and month, that were published under another name.
    """
    month = ym.cast("string")
    year = F.floor(ym / 100).cast("string")
    regular = (
        F.when(region == "JC", F.concat(F.lit("JC-"), month, F.lit(f"-{stem}.csv.zip")))
        .when(ym.between(202401, 202404), F.concat(month, F.lit(f"-{stem}.csv.zip")))
        .when(ym < 202401, F.concat(year, F.lit(f"-{stem}.zip")))
        .otherwise(F.concat(month, F.lit(f"-{stem}.zip")))
    )
    for (name, at), published in (irregular or {}).items():
        regular = F.when((region == name) & (ym == at), F.lit(published)).otherwise(regular)
    return regular


def source_months(spark: SparkSession, start: int, end: int) -> DataFrame:
    """Months and regions with published data in the half-open range."""
    months = spark.createDataFrame([(m,) for m in months_between(start, end)], "ym int")
    regions = F.explode(F.array(*[F.lit(r) for r in FIRST_MONTH])).alias("src_region")
    return months.select("ym", regions).where(region_available(F.col("ym"), F.col("src_region")))


def archive_paths(
    months: DataFrame, root: str, stem: str, irregular: Mapping[tuple[str, int], str] | None = None
) -> DataFrame:
    """Archive path of every month and region row."""
    name = archive_name(stem, F.col("ym"), F.col("src_region"), irregular)
    root = qualified(months.sparkSession, root)
    return months.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), name))


def _open(path: str):
    """Random-access file on any file system Arrow knows; paths come qualified from `qualified`."""
    scheme, _, rest = path.partition("://")
    uri = f"{ARROW_SCHEMES.get(scheme, scheme)}://{rest}" if rest else path
    if uri.startswith(("file:", "/")):
        fs, inner = pa_fs.LocalFileSystem(), uri.removeprefix("file:").removeprefix("//")
    else:
        fs, inner = pa_fs.FileSystem.from_uri(uri)
    return fs.open_input_file(inner)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark's default file system gives it; worked out once, on the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _is_csv(name: str) -> bool:
    return name.endswith(".csv") and not name.startswith("_")


def _first_line(stream) -> str:
    return io.TextIOWrapper(stream, encoding="utf-8-sig", newline=None).readline().strip("\r\n")


def _contents(archive: zipfile.ZipFile, nested: str | None) -> Iterator[tuple]:
    for info in archive.infolist():
        if _is_csv(info.filename):
            with archive.open(info) as stream:
                yield nested, info.filename, info.file_size, _first_line(stream)


def _spooled(archive: zipfile.ZipFile, name: str):
    """A nested archive inflated once, in memory up to SPOOL_BYTES and else in the task's own spill file.

    A deflated stream can only go forward, and a zip's table of contents is at its end.
    """
    out = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
    with archive.open(name) as inner:
        shutil.copyfileobj(inner, out, 1 << 20)
    out.seek(0)
    return out


def _list_batches(batches: Iterator) -> Iterator:
    import pandas as pd

    for pdf in batches:
        rows = []
        for row in pdf.itertuples(index=False):
            with _open(row.path) as raw, zipfile.ZipFile(raw) as archive:
                found = list(_contents(archive, None))
                for name in archive.namelist():
                    base = name.rsplit("/", 1)[-1]
                    if name.endswith(".zip") and not name.startswith("_") and not base.startswith("_"):
                        with _spooled(archive, name) as inner, zipfile.ZipFile(inner) as inner_zip:
                            found += _contents(inner_zip, name)
            rows += [(row.path, *f) for f in found]
        yield pd.DataFrame(rows, columns=["path", "nested", "member", "bytes", "header"])


def list_members(paths: DataFrame) -> DataFrame:
    """CSV members of each archive (directly or in a nested archive) with size and header line.

    `paths` has path, ym and src_region. Each archive's table of contents is read once, also when
    several months share it; a fixed number of partitions, which is not coalesced, spreads the archives over tasks.
    """
    wanted = paths.select("path", F.col("ym").cast("int"), "src_region")
    tasks = paths.sparkSession.sparkContext.defaultParallelism * 4
    archives = wanted.select("path").distinct().repartition(tasks, "path")
    return wanted.join(archives.mapInPandas(_list_batches, MEMBER_SCHEMA), "path")


def choose_members(members: DataFrame, name_type: int = 1) -> DataFrame:
    """Members holding the wanted month, by the archive's layout.

    * 2024 on: every direct CSV, or the nested archives when there is none.
    * 2020-2023 main region: the month's nested archive inside the year archive.
    * before 2020 main region: `M_Month/` parts (type 1) or one file per month (type 2);
      `name_type` 1/2 prefers and 11/22 requires a type.
    """
    if name_type not in (1, 2, 11, 22):
        raise ValueError(f"unknown name type {name_type}")
    ym, month = F.col("ym"), F.col("ym").cast("string")
    yearly = (F.col("src_region") == "NYC") & (ym < 202401)
    stem = F.regexp_extract("path", r"/\d{4}-([^/]*)\.zip$", 1)
    folder = F.concat(F.floor(ym / 100).cast("string"), F.lit("-"), stem, F.lit("/"))
    own = F.concat(month, F.lit("-"), stem)
    first_day = F.make_date(F.floor(ym / 100).cast("int"), ym % 100, F.lit(1))
    month_folder = F.concat((ym % 100).cast("string"), F.lit("_"), F.date_format(first_day, "MMMM"), F.lit("/"))
    suffix = F.when(F.floor(ym / 100) == 2017, F.lit(".csv_")).otherwise(F.lit("_"))
    member = F.col("member")
    kind = (
        F.when(
            yearly & (ym >= 202001),
            F.when(F.col("nested") == F.concat(folder, own, F.lit(".zip")), F.lit(0)),
        )
        .when(
            yearly,
            F.when(
                F.col("nested").isNull() & member.startswith(F.concat(folder, month_folder, own, suffix)),
                F.lit(1),
            ).when(
                F.col("nested").isNull() & (member == F.concat(folder, own, F.lit(".csv"))), F.lit(2)
            ),
        )
        .when(F.col("nested").isNull(), F.lit(3))
        .when(F.col("nested").endswith(".csv.zip"), F.lit(4))
    )
    typed = members.withColumn("kind", kind).where("kind is not null")
    per_month = Window.partitionBy("path", "ym", "src_region")
    # Layouts are numbered in order of preference; type 2 can be asked for first.
    rank = F.col("kind") if name_type in (1, 11) else F.when(F.col("kind") == 2, F.lit(0)).otherwise(F.col("kind"))
    best = typed.withColumn("__rank", rank).withColumn("__best", F.min("__rank").over(per_month))
    chosen = best.where("__rank = __best")
    required = {11: 1, 22: 2}.get(name_type)
    if required:
        other = F.raise_error(F.concat(F.lit("required member layout missing in "), F.col("path")))
        wrong = F.col("kind").isin(1, 2) & (F.col("kind") != required)
        chosen = chosen.where(F.when(wrong, other.cast("boolean")).otherwise(F.lit(True)))
    return chosen.drop("__rank", "__best", "kind")


def check_headers(members: DataFrame) -> DataFrame:
    """Members unchanged; an error in the plan when a month's members have different headers."""
    per_month = Window.partitionBy("ym", "src_region")
    spread = members.withColumns(
        {"__low": F.min("header").over(per_month), "__high": F.max("header").over(per_month)}
    )
    error = F.raise_error(F.format_string("headers differ in %d %s", "ym", "src_region"))
    same = F.when(F.col("__low") != F.col("__high"), error.cast("boolean")).otherwise(F.lit(True))
    return spread.where(same).drop("__low", "__high")


def _constant(value: str | None, n: int) -> pa.Array:
    return pa.nulls(n, pa.string()) if value is None else pa.repeat(pa.scalar(value, pa.string()), n)


class Records:
    """Counts the records of a CSV stream from its bytes alone, as a check on what the parser made of them.

    A record ends at a line break outside a quoted field; empty lines are none. Only a quote at a field's start opens
    one. Blocks are counted up to the last whole record, the rest is carried on.
    """

    # A quoted field, closed or running to the end of the bytes.
    QUOTED = re.compile(rb'(?<![^,\r\n])"[^"]*+(?:""[^"]*+)*+(?:"|\Z)')

    def __init__(self) -> None:
        self.count, self.rest = 0, b""

    def feed(self, block: bytes) -> None:
        cut = max(block.rfind(b"\n"), block.rfind(b"\r")) + 1
        if not cut:
            self.rest += block
            return
        data, self.rest = self.rest + block[:cut], block[cut:]
        if b'"' in data:
            plain = self.QUOTED.sub(lambda m: b"x" * len(m[0]), data)
            cut = max(plain.rfind(b"\n"), plain.rfind(b"\r")) + 1
            data, self.rest = plain[:cut], data[cut:] + self.rest
        self._add(data)

    def _add(self, data: bytes) -> None:
        at = np.frombuffer(data, np.uint8)
        text = (at != 10) & (at != 13)
        self.count += int(np.count_nonzero(text[1:] & ~text[:-1])) + int(text[:1].any())

    def total(self) -> int:
        """The records, once everything was fed."""
        self._add(self.QUOTED.sub(b"x", self.rest))
        self.rest = b""
        return self.count


def _csv_batches(stream: _Rest, header: list[str]) -> Iterator[pa.RecordBatch]:
    """Canonical all-text batches of one CSV stream whose header line has been read.

    The last row carries the number of records that the stream's bytes hold; fewer or more rows than that are an error.
    """
    targets = {}
    for position, name in enumerate(header):
        target = HEADER_ALIASES.get(squash_header(name))
        if target and name not in DROPPED_COLUMNS:
            targets[target] = f"c{position}"
    names = [f"c{i}" for i in range(len(header))]
    reader = pa_csv.open_csv(
        stream,
        read_options=pa_csv.ReadOptions(column_names=names, block_size=BLOCK_BYTES),
        parse_options=pa_csv.ParseOptions(newlines_in_values=True),
        convert_options=pa_csv.ConvertOptions(
            column_types={n: pa.string() for n in names},
            include_columns=sorted(set(targets.values())),
            null_values=NULL_TOKENS,
            strings_can_be_null=True,
        ),
    )
    rows, held = 0, None
    for batch in reader:
        if not len(batch):
            continue
        columns = [
            batch.column(targets[c])
            if c in targets
            else _constant(MISSING_DEFAULTS.get(c), len(batch))
            for c in TEXT_COLUMNS
        ]
        if held:
            yield _counted(held, None)
        held = pa.RecordBatch.from_arrays(columns, names=TEXT_COLUMNS)
        rows += len(held)
    records = stream.records.total()
    if rows != records:
        raise ValueError(f"read {rows} rows of {records} records")
    if held:
        yield _counted(held, records)


def _counted(batch: pa.RecordBatch, records: int | None) -> pa.RecordBatch:
    told = pa.array([None] * (len(batch) - 1) + [records], pa.int64())
    return pa.RecordBatch.from_arrays([*batch.columns, told], names=[*TEXT_COLUMNS, RECORDS])


def _member_batches(stream: _Rest) -> Iterator[pa.RecordBatch]:
    line = b""
    while not line.endswith(b"\n"):
        byte = stream.read(1)
        if not byte:
            break
        line += byte
    header = next(csv.reader([line.decode("utf-8-sig").strip("\r\n")]), [])
    stream.records = Records()
    if header and stream.peek_more():
        yield from _csv_batches(stream, header)


class _Rest(io.RawIOBase):
    """A readable view that can tell whether data follows (Arrow rejects an empty CSV) and counts the records read."""

    def __init__(self, stream):
        self._stream = stream
        self._ahead = b""
        self.records = Records()

    def readable(self):
        return True

    def peek_more(self) -> bool:
        self._ahead = self._ahead or self._stream.read(1)
        return bool(self._ahead)

    def read(self, size=-1):
        data = b""
        if self._ahead and size != 0:
            data, self._ahead = self._ahead, b""
            size = size - 1 if size > 0 else size
        data += self._stream.read(size)
        self.records.feed(data)
        return data


def _tagged(batch: pa.RecordBatch, ym: int, region: str) -> pa.RecordBatch:
    n = len(batch)
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(ym, pa.int32()), n), _constant(region, n), *batch.columns],
        names=["src_ym", "src_region", *batch.schema.names],
    )


@contextlib.contextmanager
def _naming(*place: str | None):
    try:
        yield
    except ValueError as error:
        raise ValueError(f"{'/'.join(p for p in place if p)}: {error}") from error


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by archive and nested archive: each is opened once for all of its members."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for path, of_path in itertools.groupby(rows, key=lambda r: r["path"]):
        with _open(path) as raw, zipfile.ZipFile(raw) as archive:
            for nested, members in itertools.groupby(of_path, key=lambda r: r["nested"]):
                with contextlib.ExitStack() as stack:
                    holder = archive
                    if nested:
                        holder = stack.enter_context(zipfile.ZipFile(stack.enter_context(_spooled(archive, nested))))
                    for row in members:
                        with holder.open(row["member"]) as stream, _naming(path, nested, row["member"]):
                            for out in _member_batches(_Rest(stream)):
                                yield _tagged(out, row["ym"], row["src_region"])


def _scan_schema() -> str:
    texts = ", ".join(f"`{c}` string" for c in TEXT_COLUMNS)
    return f"src_ym int, src_region string, {texts}, {RECORDS} bigint"


def read_members(
    members: DataFrame, partitions: int | None = None, spread: bool = True, records: bool = False
) -> DataFrame:
    """Rows of the chosen members as text columns with their source month and region.

    Direct members are dealt to tasks by hash, those of one nested archive together, so that it is inflated once;
    `spread` rebalances the rows afterwards so that one huge member does not leave all later work to a single task.
    Every member's rows must be as many as its bytes hold records; `records` keeps that number in the column RECORDS, on
    the member's last row, for a check of what becomes of the rows later.
    """
    count = partitions or members.sparkSession.sparkContext.defaultParallelism * 4
    alone = F.when(F.col("nested").isNull(), F.col("member"))
    dealt = members.select("path", "ym", "src_region", "nested", "member").repartition(count, "path", "nested", alone)
    rows = dealt.sortWithinPartitions("path", "nested", "member").mapInArrow(_scan, _scan_schema())
    # Both eras' user columns exist here; a file fills one of them.
    member = lookup(F.col("Member/Casual"), MEMBER_TO_USER)
    rows = rows.withColumn("User Type", F.coalesce(F.col("User Type"), member)).drop("Member/Casual")
    rows = rows if records else rows.drop(RECORDS)
    return rows.hint("rebalance") if spread else rows


def check_present(members: DataFrame, paths: DataFrame) -> DataFrame:
    """Members unchanged; an error in the plan for a wanted month and region of which no member was found."""
    wanted = paths.select("path", F.col("ym").cast("int").alias("ym"), "src_region")
    all_wanted = wanted.join(members, ["path", "ym", "src_region"], "left")
    error = F.raise_error(F.format_string("no file for %d %s in %s", "ym", "src_region", "path")).cast("boolean")
    found = all_wanted.where(F.when(F.col("member").isNull(), error).otherwise(F.lit(True)))
    return found.select(*members.columns)


def read_archives(paths: DataFrame, name_type: int = 1, spread: bool = True, records: bool = False) -> DataFrame:
    """All trips of the archives: list, choose, check that no month is missing and headers agree, stream."""
    chosen = check_present(choose_members(list_members(paths), name_type), paths)
    return read_members(check_headers(chosen), spread=spread, records=records)
