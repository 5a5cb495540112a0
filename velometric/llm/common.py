"""What the operators of this package share: tables, scratch tables, word rules and row packing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velometric.session import scratch_path

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\v\f\r"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared scratch folder.

    It cuts the lineage durably, gives later joins a measured size (Spark then broadcasts it only below its own
    threshold) and puts a plain scan below their exchanges, so that adaptive execution can split hot keys.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one computation, which can be removed once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """`df` as `written` has it."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        self.tables.append(table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if path := self.paths.pop(id(table), None):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop_others(self, *kept: DataFrame) -> None:
        """All tables but these."""
        self.drop(*[t for t in self.tables if not any(t is k for k in kept)])


def whole_text(column: str) -> Column:
    """A field of the packed `row` as text, null as empty."""
    return F.coalesce(F.col(f"row.`{column}`").cast("string"), F.lit(""))


def text_bytes(column: str) -> Column:
    """The same as UTF-8 bytes, which Arrow functions take without decoding."""
    return whole_text(column).cast("binary")


def row_key(df: DataFrame) -> Column:
    """128 bits over all columns, nulls told from values; equal rows share it."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat_ws("", *[F.isnull(c).cast("int").cast("string") for c in columns])
    return F.struct(
        F.xxhash64(nulls, *columns).alias("low"), F.xxhash64(*columns, nulls, F.lit("second")).alias("high")
    )


def packed(df: DataFrame, keep_key: bool = False) -> DataFrame:
    """Every row as one struct `row`, so that working columns cannot clash with the caller's; `key` is its row key."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(row, row_key(df).alias("key")) if keep_key else df.select(row)


def slices(array: pa.Array, most: int = 2 << 20) -> Iterator[pa.Array]:
    """A binary array in slices of about `most` bytes, so that what a function makes of one stays small.

    Of an array of lists, `most` counts their values.
    """
    length = pc.list_value_length if pa.types.is_list(array.type) else pc.binary_length
    at = np.asarray(pc.fill_null(length(array), 0), dtype=np.int64).cumsum() // most
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(array)]
    for begin, end in zip(cuts, cuts[1:], strict=False):
        yield array.slice(begin, end - begin)


class WordTable:
    """What `make` gives for each of a list of words, kept for later lists.

    The table is emptied before a list that finds it over `most` characters, so it holds that and one list's words.
    """

    def __init__(self, make: Callable[[list], Iterable], most: int = 1 << 20) -> None:
        self.make, self.most = make, most
        self.known: dict[str | bytes, object] = {}
        self.held = 0

    def take(self, words: list) -> list:
        if self.held > self.most:
            self.known.clear()
            self.held = 0
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            known.update(zip(fresh, self.make(fresh), strict=True))
            self.held += sum(map(len, fresh))
        return [known[w] for w in words]


def decoded_texts(array: pa.Array) -> list[str]:
    """The texts of a binary array; nulls are empty."""
    return [str(x.as_buffer(), "utf-8", "replace") if x.is_valid else "" for x in array]
