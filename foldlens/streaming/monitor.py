"""An extension: subgroup counts of prediction events by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_accuracy(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, end, group, n, correct) of events (ts, group, y_true, y_pred).

    Only two counters per window and group are state, and the watermark bounds it.
    """
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "group")
    rows = counted.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y_true") == F.col("y_pred")).cast("long")).alias("correct"))
    return rows.select("w.start", "w.end", "group", "n", "correct")
