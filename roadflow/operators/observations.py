"""Questions asked of the recorded floating-car data: the segment view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadflow.functions.scalars import mps_to_kph
from roadflow.functions.service_level import service_level
from roadflow.operators.ordering import spread, time_order

SEGMENT = ["node_from", "node_to"]


def latest_speeds(view: DataFrame) -> DataFrame:
    """Last speed of each vehicle on each segment; ties on time go to the later append."""
    return view.groupBy(*SEGMENT, "vehicle_id").agg(
        F.max_by("speed_mps", time_order()).alias("speed_mps")
    )


def segment_speed(view: DataFrame) -> DataFrame:
    """Mean of the latest speed per vehicle, km/h."""
    return latest_speeds(view).groupBy(*SEGMENT).agg(mps_to_kph(F.avg("speed_mps")).alias("speed_kph"))


def evict(view: DataFrame, threshold: int) -> DataFrame:
    """Records not older than the threshold."""
    return view.where(F.col("timestamp") >= threshold)


def touched_segments(view: DataFrame, since_seq: int, threshold: int | None = None) -> DataFrame:
    """Segments changed since ``since_seq``: written to, left by a vehicle, or hit by eviction."""
    fresh = view.where(F.col("seq") > since_seq)
    moved = fresh.select("vehicle_id").distinct()
    before = (
        view.where(F.col("seq") <= since_seq)
        .groupBy("vehicle_id")
        .agg(F.max_by(F.struct(*SEGMENT), "seq").alias("s"))
        .join(moved, "vehicle_id", "left_semi")
        .select("s.*")
    )
    changed = fresh.select(*SEGMENT).unionByName(before)
    if threshold is not None:
        changed = changed.unionByName(view.where(F.col("timestamp") < threshold).select(*SEGMENT))
    return changed.distinct()


def take_segment_speeds(view: DataFrame, since_seq: int, threshold: int | None = None) -> DataFrame:
    """Speeds of the changed segments; null where eviction emptied the segment."""
    kept = view if threshold is None else evict(view, threshold)
    return touched_segments(view, since_seq, threshold).join(segment_speed(kept), SEGMENT, "left")


def vehicles_ahead(probes: DataFrame, view: DataFrame, tolerance: int) -> DataFrame:
    """Distinct other vehicles ahead of each probe within a closed time tolerance.

    ``probes(probe_id, vehicle_id, node_from, node_to, timestamp, offset_m)`` and
    ``view(vehicle_id, node_from, node_to, timestamp, offset_m)``; times are
    integers in one unit.  Returns ``probe_id, vehicles_ahead``.  Offsets compare
    exactly, whatever their size.

    No pair of a probe and a record is ever formed, so a crowded segment costs
    n log n and not n squared:

    1. Per vehicle and segment, the largest offset seen within the tolerance is
       a step function of time.  Its steps become signed events ``(time,
       offset, +1/-1)``; a vehicle counts for a probe when its step value lies
       above the probe's offset.
    2. Within a segment and time block the offsets that occur are numbered in
       their order.  ``value > offset`` then holds for exactly one hexadecimal
       place of the two numbers, where all higher digits agree and the value's
       digit is larger.  One row per place, as many places as the block's
       offsets need, turns the comparison into equality on ``(segment, time
       block, place, higher digits)``.
    3. Within such a group the answer is a running sum over time, kept for each
       digit.

    Time is cut into blocks a few tolerances wide, so a segment that is busy all
    day spreads over many groups.  Records of one vehicle at one time are merged
    before the first shuffle.
    """
    width = 8 * tolerance + 16
    key = [*SEGMENT, "vehicle_id"]
    offset = F.col("offset_m").cast("double")
    records = (
        view.select(*key, "timestamp", offset.alias("value"))
        .groupBy(*key, "timestamp")
        .agg(F.max("value").alias("value"))
    )
    t = F.col("timestamp")
    blocks = F.sequence(F.floor((t - tolerance) / width), F.floor((t + tolerance) / width))
    dealt = records.withColumn("block", F.explode(blocks))
    block_start = F.col("block") * width
    # Row kinds: 0 record, 1 time where the step function may change, 2 probe.
    turns = F.filter(
        F.array(F.greatest(t - tolerance, block_start), t + tolerance + 1), lambda x: x < F.col("block") * width + width
    )
    record_rows = dealt.select(*key, "block", "timestamp", "value", F.lit(0).alias("kind"))
    turn_rows = dealt.select(*key, "block", F.explode(turns).alias("timestamp")).select(
        *key, "block", "timestamp", F.lit(None).cast("double").alias("value"), F.lit(1).alias("kind")
    )
    probe_rows = probes.select(
        *key,
        F.floor(t / width).alias("block"),
        "timestamp",
        F.lit(None).cast("double").alias("value"),
        F.lit(2).alias("kind"),
        "probe_id",
        offset.alias("x"),
    )
    union = spread(record_rows.unionByName(turn_rows).unionByName(probe_rows, allowMissingColumns=True), *SEGMENT, "block")
    # One sort serves both windows over a vehicle's rows.
    union = union.sortWithinPartitions(*SEGMENT, "block", "vehicle_id", "timestamp", "kind")
    per_vehicle = W.partitionBy(*SEGMENT, "block", "vehicle_id")
    around = per_vehicle.orderBy("timestamp").rangeBetween(-tolerance, tolerance)
    swept = union.withColumn("peak", F.max("value").over(around)).where("kind > 0")
    # The value before a change; several turns may share one time and then cancel out.
    in_order = per_vehicle.orderBy("timestamp", "kind")
    turned = swept.withColumn("before", F.lag("peak").over(in_order))
    # Two signed events per change and one question per probe; its own vehicle is taken off at the end.
    probe = F.col("kind") == 2
    sides = F.when(probe, F.array(F.struct(F.col("x").alias("v"), F.lit(0).alias("delta")))).when(
        ~F.col("peak").eqNullSafe(F.col("before")),
        F.array(
            F.struct(F.col("peak").alias("v"), F.lit(1).alias("delta")),
            F.struct(F.col("before").alias("v"), F.lit(-1).alias("delta")),
        ),
    )
    own = F.when(F.col("peak") > F.col("x"), 1).otherwise(0)
    here = W.partitionBy(*SEGMENT, "block")
    places = F.floor((F.length(F.bin(F.col("upto"))) + 3) / 4).cast("int")
    digits = (
        turned.select(*SEGMENT, "block", "timestamp", "probe_id", probe.cast("int").alias("rank"), own.alias("own"), F.inline(sides))
        .where("v IS NOT NULL")
        .withColumn("code", F.dense_rank().over(here.orderBy("v")) - 1)
        .withColumn("upto", F.max("code").over(here))
        .withColumn("place", F.explode(F.sequence(F.lit(0), places - 1)))
        .withColumn("higher", F.expr("shiftright(code, 4 * place + 4)"))
        .withColumn("digit", F.expr("shiftright(code, 4 * place) & 15"))
        .where("rank = 1 OR digit > 0")
    )
    upto = (
        W.partitionBy(*SEGMENT, "block", "place", "higher").orderBy("timestamp", "rank")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    above = F.array(*[F.sum(F.when(F.col("digit") >= d, F.col("delta")).otherwise(0)).over(upto) for d in range(1, 16)], F.lit(0).cast("bigint"))
    return (
        digits.withColumn("n", F.get(above, F.col("digit")))
        .where("rank = 1")
        .groupBy("probe_id")
        .agg((F.sum("n") - F.max("own")).alias("vehicles_ahead"))
    )


def service_levels(probes: DataFrame, view: DataFrame, segments: DataFrame, tolerance: int) -> DataFrame:
    """Vehicles ahead and level of service per probe; an unlisted segment gives nulls."""
    ahead = vehicles_ahead(probes, view, tolerance)
    return (
        probes.join(ahead, "probe_id")
        .join(segments.select(*SEGMENT, "length_m", "lanes"), SEGMENT, "left")
        .withColumn("los", service_level(F.col("vehicles_ahead"), F.col("length_m"), F.col("offset_m"), F.col("lanes")))
    )
