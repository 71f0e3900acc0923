"""The stateless half of the annotation over a stream, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decharged


def decharge_stream(events: DataFrame, charges: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Peaks with their charge removed, row by row."""
    options = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("charge"), F.lit(c).alias("by")) for i, c in enumerate(charges))))
    return events.withColumn("_o", options).withColumn("mass", decharged(F.col("value"), F.col("_o.by"))).withColumn("charge", F.col("_o.charge")).drop("_o").filter("mass > 0")


def windowed_spectra(events: DataFrame, length: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Peaks and their extremes by user and event-time window; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", length).alias("w")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).select("user_id", F.col("w.start").alias("start"), "n", "low", "high")


def annotate_stream(events: DataFrame, annotate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a query that annotates each micro-batch as a table and appends it to ``path``; a batch that is retried replaces its own part."""
    def batch(df: DataFrame, number: int) -> None:
        annotate(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
