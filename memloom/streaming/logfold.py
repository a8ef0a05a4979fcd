"""Live logs: co-activation counts kept up to date by a stream (an extension; the batch fold gives the same counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from memloom.operators.learning import pair_counts

LOG = "ts double, q string, coactivated array<array<string>>"


def logged_pairs(log: DataFrame) -> DataFrame:
    """(x, y): the pairs of a co-activation log; entries that are no pair are skipped."""
    return log.select(F.explode("coactivated").alias("p")).where(F.size("p") == 2).select(F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def fold_log_stream(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Fold the JSON lines that arrive in ``folder`` into per-batch counts under ``target``/batch=N.

    Each batch overwrites its own folder, so a batch that runs twice counts once. ``folded_counts`` sums the batches.
    """
    stream = spark.readStream.schema(LOG).json(folder)

    def fold(batch: DataFrame, number: int) -> None:
        pair_counts(logged_pairs(batch), "x", "y").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded_counts(spark: SparkSession, target: str) -> DataFrame:
    """(a, b, n) over all batches folded so far."""
    return spark.read.parquet(target).groupBy("a", "b").agg(F.sum("n").alias("n"))


def windowed_activity(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per key and event-time window of a stream or table; on a stream, rows later than ``late`` no longer count."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
