"""Durable notes beside a table: what a job is about to do, so that the next one can finish it.

A note is a small Parquet table in a hidden folder of the table's root. It counts once its committer has marked it whole, and
goes when the work is done. One writer at a time works on a root.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    files, at = _at(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a written folder was committed."""
    return exists(spark, f"{path}/_SUCCESS")


def folders(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """Folders directly below `root` whose names start so, in order of their names."""
    files, at = _at(spark, root)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
    return [f"{root}/{n}" for n in sorted(names) if n.startswith(prefix)]


def fresh(root: str, prefix: str) -> str:
    return f"{root}/{prefix}{uuid.uuid4().hex}"


def note(spark: SparkSession, path: str, rows: Iterable[Sequence], schema: str) -> None:
    spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(path)


def noted(spark: SparkSession, path: str, schema: str) -> list[tuple]:
    return [tuple(r) for r in spark.read.schema(schema).parquet(path).collect()]
