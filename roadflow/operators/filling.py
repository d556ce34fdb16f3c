"""One row per vehicle and report frame, gaps filled, and per-frame totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.functions.scalars import report_frame
from roadflow.operators.ordering import dense_sequence, forward_fill, running_total, with_neighbours

BLOCK_S = 3600


def with_meters_driven(records: DataFrame, block_s: int = BLOCK_S) -> DataFrame:
    """Metres since the previous record of the vehicle; a new segment adds the length of the old one."""
    paired = with_neighbours(
        records, ["vehicle_id"], ["timestamp", "seq"], F.floor(F.col("timestamp") / block_s),
        ["node_from", "node_to", "segment_length", "start_offset_m"],
    )
    p = F.col("prev")
    changed = (F.col("node_from") != p["node_from"]) | (F.col("node_to") != p["node_to"])
    moved = (
        F.col("start_offset_m").cast("double") - p["start_offset_m"].cast("double")
        + F.when(changed, p["segment_length"]).otherwise(0)
    )
    return paired.withColumns({"meters_driven": F.coalesce(moved, F.lit(0.0)), "is_first": p.isNull()}).drop("prev")


def one_row_per_frame(records: DataFrame) -> DataFrame:
    """First record of a vehicle in its first frame, last record in every other frame, metres summed.

    Expects ``frame``, ``meters_driven`` and ``is_first``.
    """
    kept = [c for c in records.columns if c not in ("vehicle_id", "frame", "meters_driven", "is_first", "timestamp", "seq")]
    row = F.struct("timestamp", "seq", *kept, "is_first")
    return (
        records.groupBy("vehicle_id", "frame")
        .agg(F.min(row).alias("a"), F.max(row).alias("z"), F.sum("meters_driven").alias("meters_driven"))
        .withColumn("r", F.when(F.col("a.is_first"), F.col("a")).otherwise(F.col("z")))
        .select("vehicle_id", "frame", "r.*", "meters_driven")
    )


def prepare(records: DataFrame, speed: float = 1, fps: float = 1) -> DataFrame:
    """Report frames, metres driven and one row per vehicle and frame."""
    framed = with_meters_driven(records).withColumn("frame", report_frame(F.col("timestamp"), speed, fps))
    return one_row_per_frame(framed)


def with_next(prepared: DataFrame, block_frames: int = BLOCK_S) -> DataFrame:
    """Each prepared row with the following row of the same vehicle in ``next``."""
    return with_neighbours(
        prepared, ["vehicle_id"], ["frame"], F.floor(F.col("frame") / block_frames),
        ["frame", "timestamp", "node_from", "node_to", "segment_length", "start_offset_m", "speed_mps"],
        prev=None, following="next",
    )


def fill_gaps(paired: DataFrame) -> DataFrame:
    """Linear positions and speeds for the frames between consecutive rows.

    Between two segments the offset runs on past the end of the first one and
    wraps into the second.
    """
    n = F.col("next")
    steps = F.when(n.isNull(), F.lit(1)).otherwise(n["frame"] - F.col("frame"))
    spread = paired.withColumn("steps", steps).where("steps >= 1").withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("steps") - 1))
    )
    share = F.col("i") / F.col("steps")
    same = (F.col("node_from") == n["node_from"]) & (F.col("node_to") == n["node_to"])
    here = F.col("start_offset_m").cast("double")
    there = n["start_offset_m"].cast("double") + F.when(same, F.lit(0)).otherwise(F.col("segment_length"))
    offset = F.when(n.isNull(), here).otherwise(here + (there - here) * share)
    speed = F.when(n.isNull(), F.col("speed_mps")).otherwise(
        F.col("speed_mps") + (n["speed_mps"] - F.col("speed_mps")) * share
    )
    wraps = n.isNotNull() & ~same & (F.col("o") > F.col("segment_length"))
    return spread.withColumns({"o": offset, "v": speed}).select(
        "vehicle_id",
        (F.col("frame") + F.col("i")).alias("frame"),
        F.when(wraps, n["node_from"]).otherwise(F.col("node_from")).alias("node_from"),
        F.when(wraps, n["node_to"]).otherwise(F.col("node_to")).alias("node_to"),
        F.when(wraps, n["segment_length"]).otherwise(F.col("segment_length")).alias("segment_length"),
        F.when(wraps, F.col("o") - F.col("segment_length")).otherwise(F.col("o")).alias("start_offset_m"),
        F.col("v").alias("speed_mps"),
    )


def segment_parts(filled: DataFrame, divide: int = 2) -> DataFrame:
    """Vehicle counts, mean speeds per part and mean offset per (frame, segment).

    The first part counts at the start node and the last part at the end node,
    and a node counts the vehicles of every segment that touches it.
    """
    if divide < 2:
        raise ValueError("a segment has at least two parts")
    part = F.least(
        F.floor(F.col("start_offset_m") / (F.col("segment_length") / divide)).cast("int"), F.lit(divide - 1)
    )
    rows = filled.withColumn("part", part)
    speeds = [F.avg(F.when(F.col("part") == p, F.col("speed_mps"))).alias(f"v{p}") for p in range(divide)]
    inner = [F.count_if(F.col("part") == p).alias(f"n{p}") for p in range(1, divide - 1)]
    per_segment = rows.groupBy("frame", "node_from", "node_to").agg(
        *speeds, *inner, F.avg("start_offset_m").alias("mean_offset")
    )
    at_nodes = (
        rows.where((F.col("part") == 0) | (F.col("part") == divide - 1))
        .select("frame", F.when(F.col("part") == 0, F.col("node_from")).otherwise(F.col("node_to")).alias("node"))
        .groupBy("frame", "node")
        .agg(F.count("*").alias("c"))
    )
    starts = at_nodes.select("frame", F.col("node").alias("node_from"), F.col("c").alias("c_from"))
    ends = at_nodes.select("frame", F.col("node").alias("node_to"), F.col("c").alias("c_to"))
    counts = F.array(
        F.coalesce("c_from", F.lit(0)).cast("bigint"),
        *[F.col(f"n{p}") for p in range(1, divide - 1)],
        F.coalesce("c_to", F.lit(0)).cast("bigint"),
    )
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    return (
        per_segment.join(starts, ["frame", "node_from"], "left")
        .join(ends, ["frame", "node_to"], "left")
        .withColumn("counts", counts)
        .select(
            "frame", "node_from", "node_to", "counts",
            F.array(*[F.coalesce(F.col(f"v{p}"), F.lit(-1.0)) for p in range(divide)]).alias("speeds"),
            F.when(total > 5, F.col("mean_offset")).alias("mean_offset"),
        )
    )


def dense_frames(table: DataFrame, column: str = "frame") -> DataFrame:
    bounds = table.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return dense_sequence(bounds, "low", "high", column)


def active_per_frame(prepared: DataFrame) -> DataFrame:
    """Vehicles per frame, zero in the frames between."""
    counts = prepared.groupBy("frame").agg(F.count("vehicle_id").alias("vehicles"))
    return dense_frames(counts).join(counts, "frame", "left").fillna(0, ["vehicles"])


def running_stats(paired: DataFrame, unfinished: DataFrame | None = None) -> DataFrame:
    """Metres, driving seconds and finished vehicles up to each frame.

    ``unfinished(vehicle_id)`` lists vehicles whose last record is not an arrival.
    """
    n = F.col("next")
    meters = paired.groupBy("frame").agg(F.sum("meters_driven").alias("m"))
    times = paired.where(n.isNotNull()).groupBy(n["frame"].alias("frame")).agg(
        F.sum(n["timestamp"] - F.col("timestamp")).alias("t")
    )
    lasts = paired.where(n.isNull()).select("vehicle_id", "frame")
    if unfinished is not None:
        lasts = lasts.join(unfinished, "vehicle_id", "left_anti")
    finished = lasts.groupBy("frame").agg(F.count("*").alias("f"))
    zero_d, zero_l = F.lit(0.0), F.lit(0).cast("bigint")
    parts = (
        meters.withColumns({"t": zero_l, "f": zero_l})
        .unionByName(times.withColumns({"m": zero_d, "f": zero_l}))
        .unionByName(finished.withColumns({"m": zero_d, "t": zero_l}))
        .unionByName(dense_frames(paired.select("frame")).withColumns({"m": zero_d, "t": zero_l, "f": zero_l}))
        .groupBy("frame")
        .agg(F.sum("m").alias("m"), F.sum("t").alias("t"), F.sum("f").alias("f"))
    )
    return running_total(
        parts, [], ["frame"], F.floor(F.col("frame") / 4096),
        {"meters_driven": F.col("m"), "driving_time_s": F.col("t"), "vehicles_finished": F.col("f")},
    ).drop("m", "t", "f")


def computation_by_frame(steps: DataFrame, last_frame: int, speed: float = 1, fps: float = 1) -> DataFrame:
    """Accumulated computing time per frame, carried forward over frames without a step.

    ``steps(step, time_s, duration_ms)``; the last step is moved to ``last_frame``.
    """
    final = steps.agg(F.max("step").alias("s")).first()["s"]
    frame = F.when(F.col("step") == final, F.lit(last_frame)).otherwise(report_frame(F.col("time_s"), speed, fps))
    per_frame = steps.withColumn("frame", frame.cast("bigint")).groupBy("frame").agg(F.sum("duration_ms").alias("d"))
    block = F.floor(F.col("frame") / 4096)
    summed = running_total(per_frame, [], ["frame"], block, {"computation_time_ms": F.col("d")}).drop("d")
    gapped = dense_frames(summed).join(summed, "frame", "left")
    return forward_fill(gapped, "frame", block, ["computation_time_ms"])
