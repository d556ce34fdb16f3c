"""Gaps and standstills in recorded tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.operators.ordering import running_total


def sessions(records: DataFrame, gap_s: int) -> DataFrame:
    """Stretches of each vehicle's records with at most ``gap_s`` seconds from one to the next.

    Returns ``(vehicle_id, begins, ends, records)`` in seconds.  The same form serves a
    table and a stream; a stream needs a watermark on ``event_time`` and gives a
    session once the watermark is ``gap_s`` past its end.
    """
    timed = records if "event_time" in records.columns else records.withColumn("event_time", F.timestamp_seconds("timestamp"))
    return timed.groupBy(F.session_window("event_time", f"{gap_s} seconds"), "vehicle_id").agg(
        F.min("timestamp").alias("begins"), F.max("timestamp").alias("ends"), F.count(F.lit(1)).alias("records")
    ).select("vehicle_id", "begins", "ends", "records")


def standstills(records: DataFrame, slower_mps: float, least_s: int, block_s: int = 3600) -> DataFrame:
    """Stretches of consecutive records slower than ``slower_mps`` that last at least ``least_s`` seconds.

    Returns ``(vehicle_id, begins, ends, records)``; a stretch lasts from its first to its
    last slow record.  The number of moving records before a record names its
    stretch; it is a running total over blocks of time, so a vehicle with very
    many records is dealt to many tasks.
    """
    rows = records.select("vehicle_id", "timestamp", "seq", (F.coalesce(F.col("speed_mps"), F.lit(0.0)) >= slower_mps).cast("long").alias("moving"))
    counted = running_total(rows, ["vehicle_id"], ["timestamp", "seq"], F.floor(F.col("timestamp") / block_s), {"stretch": F.col("moving")})
    return counted.where("moving = 0").groupBy("vehicle_id", "stretch").agg(
        F.min("timestamp").alias("begins"), F.max("timestamp").alias("ends"), F.count(F.lit(1)).alias("records")
    ).where(F.col("ends") - F.col("begins") >= least_s).drop("stretch")
