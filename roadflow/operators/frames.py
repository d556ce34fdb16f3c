"""Aggregation of floating-car data into (frame, segment) rows and a frame index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadflow.functions.scalars import centred_frame, first_half
from roadflow.operators.ordering import running_total, time_order, with_neighbours
from roadflow.session import cut_lineage

FRAME_KEY = ["frame_id", "node_from", "node_to"]
FCD_FIELDS = [
    "timestamp", "node_from", "node_to", "segment_length", "vehicle_id", "start_offset_m", "speed_mps", "active",
]


def require_fields(df: DataFrame, fields=FCD_FIELDS) -> DataFrame:
    """Fail early when a record table lacks a field."""
    missing = [c for c in fields if c not in df.columns]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return df


def time_range(records: DataFrame) -> DataFrame:
    """Exact first and last time and the record count; answered from file statistics where possible."""
    return records.agg(
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
        F.count("*").alias("records"),
    )


def frame_interval(duration_s: int, frames: int | None, round_freq_s: int, explicit_s: int | None = None) -> int:
    """Frame width: explicit, or the run divided by the wanted frames; never below the run's step."""
    if explicit_s:
        return max(explicit_s, round_freq_s)
    if not frames or frames <= 0:
        raise ValueError("the number of frames is needed where no interval is given")
    return max(duration_s // frames, round_freq_s)


def assign_frames(records: DataFrame, interval_s: int) -> DataFrame:
    return records.withColumn("frame_id", centred_frame(F.col("timestamp"), interval_s))


def frame_rows(records: DataFrame, interval_s: int) -> DataFrame:
    """Speed sums, counts and first-seen vehicles per half segment and frame.

    One pass: records are summed per vehicle and half segment first, so what is
    shuffled next, to mark where a vehicle shows up first in a frame, is short.
    """
    framed = assign_frames(records, interval_s).withColumn(
        "in_first", F.coalesce(first_half(F.col("start_offset_m"), F.col("segment_length")), F.lit(False))
    )
    visits = framed.groupBy("frame_id", "vehicle_id", "node_from", "node_to", "in_first").agg(
        F.sum("speed_mps").alias("s"), F.count(F.lit(1)).alias("c"), F.count_if(~F.col("active")).alias("f"), F.min(time_order()).alias("o")
    )
    in_order = W.partitionBy("frame_id", "vehicle_id").orderBy("o")
    first = F.col("in_first")

    def half(condition, value: str):
        return F.sum(F.when(condition, F.col(value)))

    return (
        visits.withColumn("u", F.when(F.row_number().over(in_order) == 1, 1).otherwise(0))
        .groupBy(*FRAME_KEY)
        .agg(
            F.coalesce(half(first, "s"), F.lit(0.0)).alias("speed_sum_first"),
            F.coalesce(half(first, "c"), F.lit(0)).cast("int").alias("speed_count_first"),
            F.coalesce(half(first, "u"), F.lit(0)).cast("int").alias("count_unique_first"),
            F.coalesce(half(~first, "s"), F.lit(0.0)).alias("speed_sum_second"),
            F.coalesce(half(~first, "c"), F.lit(0)).cast("int").alias("speed_count_second"),
            F.coalesce(half(~first, "u"), F.lit(0)).cast("int").alias("count_unique_second"),
            F.sum("f").cast("int").alias("vehicles_finished"),
        )
    )


def added_stats(records: DataFrame, interval_s: int, block_s: int = 3600) -> DataFrame:
    """Driven time and distance per frame from consecutive records of a vehicle.

    The first record of a vehicle counts its offset and the time since the
    first record of the run; a new segment counts only the offset on it.
    """
    framed = assign_frames(records, interval_s)
    paired = with_neighbours(
        framed.select("frame_id", "vehicle_id", "timestamp", "seq", "node_from", "node_to", "start_offset_m"),
        ["vehicle_id"], ["timestamp", "seq"], F.floor(F.col("timestamp") / block_s),
        ["timestamp", "node_from", "node_to", "start_offset_m"],
    )
    p = F.col("prev")
    same = (F.col("node_from") == p["node_from"]) & (F.col("node_to") == p["node_to"])
    moved = F.when(same, F.col("start_offset_m") - p["start_offset_m"]).otherwise(F.col("start_offset_m"))
    start = records.agg(F.min("timestamp").alias("t0")).first()["t0"]
    return paired.groupBy("frame_id").agg(
        F.sum(F.col("timestamp") - F.coalesce(p["timestamp"], F.lit(start))).alias("time_s"),
        F.sum(moved.cast("double")).alias("distance_m"),
    )


def frame_index(rows: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Slice bounds and running totals per frame.

    Without ``stats`` (the chunked mode of the aggregation) distance and time
    stay zero.
    """
    parts = rows.groupBy("frame_id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("count_unique_first") + F.col("count_unique_second")).alias("active_vehicles"),
        F.sum("vehicles_finished").alias("f"),
    )
    if stats is None:
        per_frame = parts.withColumns({"d": F.lit(0).cast("bigint"), "t": F.lit(0).cast("bigint")})
    else:
        per_frame = parts.join(
            stats.select("frame_id", F.col("distance_m").cast("bigint").alias("d"), F.col("time_s").alias("t")),
            "frame_id", "left",
        ).fillna(0, ["d", "t"])
    totals = running_total(
        per_frame, [], ["frame_id"], F.floor(F.col("frame_id") / 4096),
        {
            "end_index": F.col("n"), "vehicles_finished": F.col("f"),
            "total_distance": F.col("d"), "total_time": F.col("t"),
        },
    )
    return totals.select(
        "frame_id", (F.col("end_index") - F.col("n")).alias("start_index"), "end_index", "active_vehicles",
        "vehicles_finished", "total_distance", F.col("total_time").cast("double").alias("total_time"),
    )


def run_summary(records: DataFrame, rows: DataFrame, interval_s: int) -> DataFrame:
    """One row of run metadata.

    ``max_vehicle_id`` is what the aggregation stores as the number of
    vehicles; the true count stands next to it.
    """
    vehicles = records.groupBy("vehicle_id").agg(F.lit(1).alias("one")).agg(
        F.max("vehicle_id").alias("max_vehicle_id"), F.count("*").alias("vehicles")
    )
    per_frame = rows.groupBy("frame_id").agg(
        F.sum(F.col("count_unique_first") + F.col("count_unique_second")).alias("seen"),
        F.max(F.greatest("count_unique_first", "count_unique_second")).alias("on_segment"),
    )
    widest = per_frame.agg(
        F.max("seen").alias("max_unique_vehicles_in_time_segment"),
        F.max("on_segment").alias("max_unique_vehicles_on_segment"),
    )
    return vehicles.select("*", *[widest.select(c).scalar().alias(c) for c in widest.columns], F.lit(interval_s).alias("interval_s"))


def rows_of_frame(rows: DataFrame, frame_id: int) -> DataFrame:
    """Rows of one frame; on a table partitioned by frame bucket this prunes partitions."""
    return rows.where(F.col("frame_id") == frame_id)


def mean_speeds(rows: DataFrame) -> DataFrame:
    """Mean speed and volume of a frame row; 0 where nothing was seen."""
    count = F.col("speed_count_first") + F.col("speed_count_second")
    total = F.col("speed_sum_first") + F.col("speed_sum_second")
    return rows.select(
        *FRAME_KEY,
        F.when(count > 0, total / F.nullif(count, F.lit(0))).otherwise(0.0).alias("avg_speed_mps"),
        (F.col("count_unique_first") + F.col("count_unique_second")).alias("volume"),
    )


def drawing_rows(rows: DataFrame) -> DataFrame:
    """What a renderer needs per frame row: mean speed per half (-1 where empty) and both densities."""

    def half(which):
        n = F.col(f"speed_count_{which}")
        return F.when(n > 0, F.col(f"speed_sum_{which}") / F.nullif(n, F.lit(0))).otherwise(-1.0)

    return rows.select(
        *FRAME_KEY,
        F.array("count_unique_first", "count_unique_second").alias("densities"),
        F.array(half("first"), half("second")).alias("speeds"),
    )


def vehicle_sketches(records: DataFrame, interval_s: int, log_registers: int = 14) -> DataFrame:
    """One mergeable sketch of the vehicles per frame and segment: ``(frame_id, node_from, node_to, sketch)``."""
    return assign_frames(records, interval_s).groupBy(*FRAME_KEY).agg(F.hll_sketch_agg("vehicle_id", log_registers).alias("sketch"))


def vehicles_in_range(sketches: DataFrame, first: int, last: int, by: list[str] | None = None) -> DataFrame:
    """Estimated distinct vehicles of the frames ``first..last`` from stored sketches, per ``by`` (all together by default)."""
    kept = sketches.where(F.col("frame_id").between(first, last))
    return kept.groupBy(*(by or [])).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("vehicles"))


def running_vehicles(sketches: DataFrame) -> DataFrame:
    """Estimated distinct vehicles from the first frame up to each: ``(frame_id, vehicles)``.

    Frames are merged to one sketch each, of bounded size; each frame then
    merges with the frames before it by doubling their reach, so no task holds
    all frames of a long run.
    """
    per_frame = sketches.groupBy("frame_id").agg(F.hll_union_agg("sketch").alias("sketch"))
    low, high = per_frame.agg(F.min("frame_id"), F.max("frame_id")).first()
    reach = 1
    if low is not None:  # frames without a record hand on what is before them
        per_frame = per_frame.sparkSession.range(low, high + 1).withColumnRenamed("id", "frame_id").join(per_frame, "frame_id", "left")
    while low is not None and reach <= high - low:
        later = per_frame.select((F.col("frame_id") + reach).alias("frame_id"), "sketch").where(F.col("frame_id") <= high)
        merged = F.when(F.count("sketch") > 0, F.hll_union_agg("sketch"))  # of nulls alone it would be an empty sketch of another size
        per_frame = cut_lineage(per_frame.union(later).groupBy("frame_id").agg(merged.alias("sketch")))
        reach *= 2
    return per_frame.select("frame_id", F.hll_sketch_estimate("sketch").alias("vehicles"))
