"""Incremental review: a stream of result documents is merged into the table of proposals, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curatrix.functions import text as T

RESULT = "file string, caption string, seq long"


def result_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines {file, caption, seq} of the files that appear in a folder."""
    return spark.readStream.schema(RESULT).json(folder)


def latest(results: DataFrame) -> DataFrame:
    """name, caption and seq: the last result of each base name; blank and failed ones never replace one."""
    good = results.filter((T.strip(F.col("caption")) != "") & ~F.upper(F.ltrim("caption")).startswith("ERROR:"))
    return good.groupBy(T.basename(F.col("file")).alias("name")).agg(F.max_by("caption", "seq").alias("caption"), F.max("seq").alias("seq"))


def merge_into(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's latest results under its number; a batch that is run again replaces its own folder only, so results count once."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, table: str) -> DataFrame:
    """name and caption over all batches."""
    rows = spark.read.parquet(table)
    return rows.groupBy("name").agg(F.max_by("caption", "seq").alias("caption"))


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension: events by type and window, with a watermark for late ones. events: ts, event_type."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
