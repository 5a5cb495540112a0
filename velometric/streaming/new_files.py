"""Process each newly arrived trip file once.

The file source's log plays the part of the stored manifest for files that only ever appear; files
that are replaced in place still need `sources.manifest.manifest_diff`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from velometric.operators.conform import conform, nulls_from_tokens
from velometric.operators.dedupe import exact_dedupe
from velometric.operators.rollup import rollup


def new_trip_rows(spark: SparkSession, folder: str, header: list[str], files_per_batch: int | None = None) -> DataFrame:
    """Stream of text rows of CSV files of one header era."""
    reader = (
        spark.readStream.schema(T.StructType([T.StructField(h, T.StringType()) for h in header]))
        .option("header", True)
        .option("mode", "FAILFAST")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return nulls_from_tokens(reader.csv(folder))


def append_rollups(
    rows: DataFrame, out: str, checkpoint: str, keys: str = "ymrgtb", sums: str = "cd"
):
    """Conform and roll up every batch of new files, appending partial sums; ends when caught up.

    A batch is written below its own `batch` partition and overwritten on retry, so a replayed
    batch does not count twice. Totals are a re-sum over the small partial table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        partial = rollup(exact_dedupe(conform(batch)), keys, sums, by_month=True)
        partial.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
