"""The incremental form of ingestion and matching, as structured streams (beyond the batch engine's own scope)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import clean


def deduplicated(stream: DataFrame, time: str = "loaded_at", late: str = "7 days", key: str = "content_hash") -> DataFrame:
    """Rows whose key wasn't seen within the watermark; the state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_totals(stream: DataFrame, time: str = "ts", amount: str = "value", late: str = "1 day") -> DataFrame:
    """(day, n, net) per day of event time."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("net")).select(F.col("w.start").alias("day"), "n", "net")


def exact_pairs(primary: DataFrame, counterpart: DataFrame, days: int = 4, late: str = "7 days") -> DataFrame:
    """(p_id, c_id) of two streams (id, utr, ts) by reference, within days of each other; both sides' state is bounded."""
    side = lambda df, x: df.select(F.col("id").alias(x + "id"), clean.normal_reference(F.col("utr")).alias(x + "key"), F.col("ts").alias(x + "ts")).where(F.length(x + "key") >= 5).withWatermark(x + "ts", late)
    p, c = side(primary, "p_"), side(counterpart, "c_")
    near = F.expr(f"c_ts BETWEEN p_ts - INTERVAL {days} DAYS AND p_ts + INTERVAL {days} DAYS")
    return p.join(c, (F.col("p_key") == F.col("c_key")) & near).select("p_id", "c_id")


def run_into(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet until the input there is now is used up."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_folder(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder to which Parquet files are added, as a stream."""
    return spark.readStream.schema(schema).parquet(path)
