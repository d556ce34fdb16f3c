"""One step of movement for all due vehicles at once.

The segment view, the queues and the vehicles do not change while a step runs,
so every due vehicle can be judged independently.  Queue order only decides
which of the judged moves take effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.functions.scalars import kph_to_mps
from roadflow.operators.observations import service_levels
from roadflow.operators.vehicles import at_segment_end, route_node, with_segments
from roadflow.session import cut_lineage

SEGMENT = ["node_from", "node_to"]
# Fixed value: a vehicle this close to the segment end counts as arrived there.
END_SNAP_M = 2

FREE, MOVER, WAITER = 0, 1, 2


def proposed_speed(ready: DataFrame, view: DataFrame, segments: DataFrame, tolerance_us: int) -> DataFrame:
    """Speed and whether the vehicle enters its next segment.

    At a segment end the next segment counts from its start, unless it is
    closed.  A jam ahead or a closed segment gives speed 0 on the old segment.
    """
    enters = at_segment_end() & ~F.col("closed1")
    blocked = at_segment_end() & F.col("closed1")
    probes = ready.where(~blocked).select(
        F.col("id").alias("probe_id"), F.col("id").alias("vehicle_id"),
        F.when(enters, route_node(1)).otherwise(route_node(0)).alias("node_from"),
        F.when(enters, route_node(2)).otherwise(route_node(1)).alias("node_to"),
        F.col("time_offset_us").alias("timestamp"),
        F.when(enters, F.lit(0.0)).otherwise(F.col("start_distance_offset")).alias("offset_m"),
    )
    levels = service_levels(probes, view, segments, tolerance_us).select(F.col("probe_id").alias("id"), "los")
    limit = F.when(enters, F.col("limit1")).otherwise(F.col("limit0"))
    stands = F.col("los").isNull() | (F.col("los") == float("inf"))
    return ready.join(levels, "id", "left").withColumns(
        {
            "speed_mps": F.when(stands, F.lit(0.0)).otherwise(kph_to_mps(limit * F.col("los"))),
            "changed": ~stands & enters,
        }
    ).drop("los")


def proposed_move(rows: DataFrame) -> DataFrame:
    """End index, position and time of the move: ``end_index, end_m, end_us``."""
    start = F.when(F.col("changed"), F.lit(0.0)).otherwise(F.col("start_distance_offset"))
    length = F.when(F.col("changed"), F.col("length1")).otherwise(F.col("length0"))
    v = F.col("speed_mps")
    freq = F.col("frequency_us")
    reach = start + freq / 1000000 * v
    index = F.col("start_index") + F.col("changed").cast("int")
    stands = v == 0.0
    ends = reach >= length - END_SNAP_M
    travel_us = F.bround(F.try_divide(length - start, v) * 1000000).cast("bigint")
    t = F.col("time_offset_us")
    return rows.withColumns(
        {
            "end_index": F.when(stands, F.col("start_index")).otherwise(index),
            "end_m": F.when(stands, F.col("start_distance_offset")).when(ends, length.cast("double")).otherwise(reach),
            "end_us": F.when(~stands & ends, t + travel_us).otherwise(t + freq),
        }
    ).withColumn(
        "moved", (F.col("end_index") != F.col("start_index")) | (F.col("end_m") != F.col("start_distance_offset"))
    )


def queue_scan(rows: DataFrame, queue: DataFrame) -> DataFrame:
    """Give each due vehicle its ``phase``: free, queue mover or waiter.

    Heads of a queue move in order until one is not due or does not move; that
    last one still counts as processed.  Both cuts are minima per queue, so no
    queue is walked through.
    """
    placed = queue.join(
        rows.select(F.col("id").alias("vehicle_id"), "moved"), "vehicle_id", "left"
    )
    pos = F.col("pos")
    cuts = placed.groupBy(*SEGMENT).agg(
        F.min(F.when(F.col("moved").isNull(), pos)).alias("first_absent"),
        F.min(F.when(~F.col("moved"), pos)).alias("first_stuck"),
    )
    standing = queue.join(cuts, SEGMENT).select(
        F.col("vehicle_id").alias("id"), F.col("node_from").alias("q_from"), F.col("node_to").alias("q_to"),
        "pos", ((F.col("first_absent").isNull() | (pos < F.col("first_absent")))
                & (F.col("first_stuck").isNull() | (pos <= F.col("first_stuck")))).alias("turn"),
    )
    here = rows.withColumns({"q_from": route_node(0), "q_to": route_node(1)})
    phase = F.when(F.col("turn").isNull(), FREE).when(F.col("turn"), MOVER).otherwise(WAITER)
    return here.join(standing, ["id", "q_from", "q_to"], "left").withColumn("phase", phase).drop("turn")


def settle(rows: DataFrame) -> DataFrame:
    """Apply the moves that take effect.

    Adds ``new_index, new_m, new_us, stays_active, leaves, joins`` and
    ``silent`` for the first-move guard: a vehicle still at the very start of
    its route only lets time pass and leaves no record.
    """
    waits = F.col("phase") == WAITER
    t_wait = F.col("time_offset_us") + F.col("frequency_us")
    guard = ~waits & (F.col("end_index") == 0) & (F.col("end_m") == 0.0)
    still = waits | guard
    out = rows.withColumns(
        {
            "silent": guard,
            "new_index": F.when(still, F.col("start_index")).otherwise(F.col("end_index")),
            "new_m": F.when(still, F.col("start_distance_offset")).otherwise(F.col("end_m")),
            "new_us": F.when(still, t_wait).otherwise(F.col("end_us")),
            "speed_mps": F.when(waits, F.lit(0.0)).otherwise(F.col("speed_mps")),
        }
    )
    crossed = F.col("new_index") != F.col("start_index")
    length = F.when(crossed, F.col("length1")).otherwise(F.col("length0"))
    at_end = ~still & (F.col("new_m") == length)
    arrives = at_end & (F.get("osm_route", F.col("new_index") + 1) == F.col("dest_node"))
    changed_place = crossed | (F.col("new_m") != F.col("start_distance_offset"))
    return out.withColumns(
        {
            "stays_active": ~F.coalesce(arrives, F.lit(False)),
            "leaves": ~still & at_segment_end() & crossed,
            "joins": at_end & ~F.coalesce(arrives, F.lit(False)) & changed_place,
        }
    )


def records(rows: DataFrame) -> DataFrame:
    """Floating-car data of the settled moves, in append order by ``(phase, major, minor, sample)``.

    Samples every period strictly before the end of the move and strictly inside
    the segment, then one record at the end.
    """
    on_next = at_segment_end() & (F.col("new_index") != F.col("start_index"))
    length = F.when(on_next, F.col("length1")).otherwise(F.col("length0"))
    start = F.when(on_next, F.lit(0.0)).otherwise(F.col("start_distance_offset"))
    period = F.col("fcd_sampling_period_us")
    step = F.col("speed_mps") * (period / 1000000)
    by_time = F.ceil(F.try_divide(F.col("new_us") - F.col("time_offset_us"), period)) - 1
    by_place = F.when(step > 0, F.ceil(F.try_divide(length - start, step)) - 1).when(start < length, by_time).otherwise(0)
    n = F.coalesce(F.greatest(F.least(by_time, by_place), F.lit(0)), F.lit(0)).cast("int")
    sampled = F.transform(
        F.sequence(F.lit(1), F.col("n")),
        lambda i: F.struct(
            i.alias("sample"), (F.col("time_offset_us") + i * F.col("period")).alias("timestamp"),
            (F.col("s") + i * F.col("step")).alias("offset_m"), F.lit(True).alias("active"),
        ),
    )
    final = F.array(
        F.struct(
            (F.col("n") + 1).alias("sample"), F.col("new_us").alias("timestamp"),
            F.col("new_m").alias("offset_m"), F.col("stays_active").alias("active"),
        )
    )
    return (
        rows.where(~F.col("silent"))
        .withColumns({"n": n, "s": start, "step": step, "period": period, "segment_length": length, "on_next": on_next.cast("int")})
        .select(
            F.col("id").alias("vehicle_id"), "phase", "pos", "q_from", "q_to",
            F.get("osm_route", F.col("start_index") + F.col("on_next")).alias("node_from"),
            F.get("osm_route", F.col("start_index") + F.col("on_next") + 1).alias("node_to"),
            "segment_length", "speed_mps", "status",
            F.inline(F.when(F.col("n") >= 1, F.concat(sampled, final)).otherwise(final)),
        )
    )


def advance(
    due: DataFrame, queue: DataFrame, view: DataFrame, segments: DataFrame, state: DataFrame,
    tolerance_us: int,
) -> DataFrame:
    """Judge and settle one step; one row per due vehicle."""
    ready = cut_lineage(with_segments(due, segments, state))
    # The queue scan reads the judged moves twice; the table keeps the service levels from running twice.
    judged = cut_lineage(proposed_move(proposed_speed(ready, view, segments, tolerance_us)))
    return settle(queue_scan(judged, queue))


def moved_vehicles(vehicles: DataFrame, settled: DataFrame) -> DataFrame:
    """The vehicle table after the step."""
    news = settled.select("id", "new_index", "new_m", "new_us", "stays_active")
    joined = vehicles.join(news, "id", "left")
    hit = F.col("new_us").isNotNull()

    def put(new: str, old: str) -> Column:
        return F.when(hit, F.col(new)).otherwise(F.col(old))

    return joined.withColumns(
        {
            "start_index": put("new_index", "start_index"),
            "start_distance_offset": put("new_m", "start_distance_offset"),
            "time_offset_us": put("new_us", "time_offset_us"),
            "active": F.col("active") & F.coalesce("stays_active", F.lit(True)),
        }
    ).select(*vehicles.columns)


def queue_after(queue: DataFrame, settled: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Queues after the step: leavers removed, ``arrivals(node_from, node_to, vehicle_id, pos)`` appended."""
    gone = settled.where("leaves").select(F.col("q_from").alias("node_from"), F.col("q_to").alias("node_to"), F.col("id").alias("vehicle_id"))
    return queue.join(gone, [*SEGMENT, "vehicle_id"], "left_anti").unionByName(arrivals)


def arrivals_of(settled: DataFrame) -> DataFrame:
    """Vehicles that queue up at a segment end, with what decides their order."""
    return settled.where("joins").select(
        F.get("osm_route", F.col("new_index")).alias("node_from"), F.get("osm_route", F.col("new_index") + 1).alias("node_to"),
        F.col("id").alias("vehicle_id"), "phase", "q_from", "q_to", "pos",
    )
