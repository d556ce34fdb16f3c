"""Rules from one snapshot to the next: fixture cases."""

import pytest
from pyspark.sql import functions as F

from roadflow.operators import movement

V = 50 * 1000 / 3600
FLEET = (
    "id long, time_offset_us long, frequency_us long, start_index int, start_distance_offset double, origin_node long, "
    "dest_node long, osm_route array<long>, active boolean, fcd_sampling_period_us long, status string"
)
SEGMENTS = "node_from long, node_to long, length_m int, max_speed_kph int, lanes int"
VIEW = "vehicle_id long, node_from long, node_to long, timestamp long, offset_m double"
QUEUE = "node_from bigint, node_to bigint, vehicle_id bigint, pos struct<step:int,phase:int,rank:bigint>"


def one_step(spark, index, position, queue=(), view=(), closed=False, extra=()):
    fleet = spark.createDataFrame(
        [(0, 10_000_000, 10_000_000, index, float(position), 0, 2, [0, 1, 2], True, 5_000_000, ""), *extra], FLEET
    )
    segments = spark.createDataFrame([(0, 1, 1000, 50, 1), (1, 2, 1000, 50, 1)], SEGMENTS)
    speed = F.when(F.lit(closed) & (F.col("node_from") == 1), 0).otherwise(F.col("max_speed_kph"))
    q = spark.createDataFrame([(0, 1, v, (0, 0, n)) for n, v in enumerate(queue)], QUEUE)
    rows = movement.advance(fleet, q, spark.createDataFrame(list(view), VIEW), segments, segments.withColumn("speed_kph", speed), 5_000_000)
    return {r.id: r for r in rows.collect()}, movement.records(rows).where("vehicle_id = 0").orderBy("timestamp").collect()


def jam(segment, count=60):
    return [(100 + n, *segment, 10_000_000, 900.0) for n in range(count)]


@pytest.mark.parametrize("index, position, end, records, active", [
    (0, 0.0, (0, V * 10), 2, True), (0, 990.0, (0, 1000.0), 1, True), (1, 990.0, (1, 1000.0), 1, False),
    (0, 1000.0, (1, V * 10), 2, True), (0, 860.0, (0, 1000.0), 3, True),
])
def test_single_vehicle(spark, index, position, end, records, active):
    rows, fcd = one_step(spark, index, position)
    r = rows[0]
    assert (r.new_index, pytest.approx(r.new_m)) == (end[0], end[1])
    assert len(fcd) == records and r.stays_active is active
    assert fcd[-1].offset_m == pytest.approx(end[1]) and fcd[-1].active is active
    assert r.joins is (end[1] == 1000.0 and active)


def test_jam_stops_on_the_spot(spark):
    rows, fcd = one_step(spark, 0, 20.0, view=jam((0, 1)))
    assert rows[0].speed_mps == 0 and rows[0].new_m == 20.0 and rows[0].new_us == 20_000_000
    assert [r.speed_mps for r in fcd] == [0.0, 0.0]


def test_first_move_in_a_jam_leaves_no_record(spark):
    rows, fcd = one_step(spark, 0, 0.0, view=jam((0, 1)))
    assert rows[0].silent and rows[0].new_us == 20_000_000 and fcd == []


def test_closed_next_segment_holds(spark):
    rows, fcd = one_step(spark, 0, 1000.0, queue=[0], closed=True)
    assert rows[0].speed_mps == 0 and not rows[0].changed and rows[0].new_m == 1000.0 and len(fcd) == 1


def test_waiting_behind_a_vehicle_that_is_not_due(spark):
    rows, fcd = one_step(spark, 0, 1000.0, queue=[9, 0])
    assert rows[0].phase == movement.WAITER and rows[0].new_us == 20_000_000 and fcd[-1].speed_mps == 0


def test_queue_goes_on_until_one_is_stuck(spark):
    extra = [(v, 10_000_000, 10_000_000, 0, 1000.0, 0, 2, [0, 1, 2], True, 5_000_000, "") for v in (1, 2)]
    rows, _ = one_step(spark, 0, 1000.0, queue=[1, 0, 2], extra=extra)
    assert [rows[v].phase for v in (1, 0, 2)] == [movement.MOVER] * 3 and all(rows[v].leaves for v in rows)
    rows, _ = one_step(spark, 0, 1000.0, queue=[1, 0, 2], extra=extra, view=jam((1, 2)))
    assert [rows[v].phase for v in (1, 0, 2)] == [movement.MOVER, movement.WAITER, movement.WAITER]
