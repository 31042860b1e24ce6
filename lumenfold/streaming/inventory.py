"""Structured Streaming: an inventory kept current from a stream of scan deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lumenfold.operators.snapshots import latest_rows


def deliveries(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def arrivals_by_window(stream: DataFrame, at: str = "delivered_at", width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Deliveries and bytes by source and window; later rows than the watermark are dropped."""
    return (
        stream.withWatermark(at, late).groupBy(F.window(at, width), "source_name")
        .agg(F.count("*").alias("rows"), F.sum("size_bytes").alias("bytes"))
        .select(F.col("window.start").alias("window_start"), "source_name", "rows", "bytes")
    )


def keep_current(stream: DataFrame, out: str, checkpoint: str, keys: list[str], by: str) -> StreamingQuery:
    """Append each micro-batch, reduced to its latest row a key, as ``out/batch=<epoch>``.

    A batch that is run again after a failure overwrites its own folder, so results are exact;
    ``current`` reads the latest row of each key over all batches.
    """
    values = [c for c in stream.columns if c not in keys and c != by]

    def write(df: DataFrame, epoch: int) -> None:
        latest_rows(df, keys, by, [by, *values]).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, keys: list[str], by: str) -> DataFrame:
    df = spark.read.parquet(out)
    return latest_rows(df, keys, by, [by, *[c for c in df.columns if c not in (*keys, by, "batch")]])
