"""The corpus operators on streams: stateless tokens, and counts in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import append_end, char_tokens


def corpus_stream(spark: SparkSession, folder: str, key: str = "text") -> DataFrame:
    """JSON lines that arrive in ``folder``; lines without text are left out."""
    rows = spark.readStream.schema(f"`{key}` STRING").json(folder)
    return rows.select(F.col(f"`{key}`").alias("text")).where(F.length("text") > 0)


def tokenize(docs: DataFrame, end: int = 256) -> DataFrame:
    """ids and len; the same plan for batches and streams."""
    ids = append_end(char_tokens(F.col("text")), end)
    return docs.select("text", ids.alias("ids"), F.size(ids).alias("len"))


def windowed_counts(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window; rows later than ``late`` are left out on streams."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width), by)
    return grouped.agg(F.count("*").alias("n_events"), F.sum("value").alias("sum_value")).select(F.col("window.start").alias("window_start"), by, "n_events", "sum_value")


def write_exactly_once(df: DataFrame, path: str, checkpoint: str):
    """Append to Parquet; the checkpoint makes each input row appear once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
