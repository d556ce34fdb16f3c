"""Segment view: fixture cases and vehicles ahead against brute force."""

import random

import pytest

from roadflow.functions.service_level import service_level
from roadflow.operators import observations as obs
from pyspark.sql import functions as F

RECORD = "seq long, timestamp long, node_from long, node_to long, vehicle_id long, speed_mps double"


def kph(v):
    return v / 3.6


@pytest.mark.parametrize("rows, want", [
    ([(0, 0, 1, kph(50))], 50), ([(0, 0, 1, kph(50)), (1, 0, 2, kph(60))], 55), ([(0, 0, 1, kph(50)), (1, 10, 1, kph(30))], 30),
])
def test_segment_speed(spark, rows, want):
    view = spark.createDataFrame([(s, t, 100, 200, v, x) for s, t, v, x in rows], RECORD)
    assert obs.segment_speed(view).first().speed_kph == pytest.approx(want)


def test_eviction_marks_segments(spark):
    view = spark.createDataFrame([(0, 0, 1, 2, 1, 5.0), (1, 30, 1, 2, 1, 6.0), (2, 60, 1, 2, 1, 7.0), (3, 10, 3, 4, 2, 8.0)], RECORD)
    got = {(r.node_from, r.node_to): r.speed_kph for r in obs.take_segment_speeds(view, 3, 45).collect()}
    assert got[(1, 2)] == pytest.approx(25.2) and got[(3, 4)] is None


@pytest.mark.parametrize("seed, tolerance, segments", [(1, 5, 3), (2, 0, 1), (3, 40, 1)])
def test_vehicles_ahead_matches_brute_force(spark, seed, tolerance, segments):
    rnd = random.Random(seed)
    # Two thirds of the rows sit on segment 0, and vehicle 7 repeats a lot.
    rows = [
        (n, rnd.choice([7, 7, *range(12)]), rnd.choice([0, 0, *range(segments)]), 9, rnd.randint(0, 120), rnd.choice([0.0, 12.5, float(rnd.randint(0, 99))]))
        for n in range(350)
    ]
    probes = spark.createDataFrame(rows, "probe_id long, vehicle_id long, node_from long, node_to long, timestamp long, offset_m double")
    got = {r.probe_id: r.vehicles_ahead for r in obs.vehicles_ahead(probes, probes.drop("probe_id"), tolerance).collect()}
    for n, v, s, _, t, x in rows:
        assert got[n] == len({r[1] for r in rows if r[2] == s and abs(r[4] - t) <= tolerance and r[5] > x and r[1] != v})


@pytest.mark.parametrize("unit", [1e-9, 1.0, 300_000.0])
def test_offsets_compare_exactly(spark, unit):
    rows = [(n, n, 1, 2, 0, x * unit) for n, x in enumerate((1.007, 15.005, 1.002, 10.0, 1.0070000001))]
    probes = spark.createDataFrame(rows, "probe_id long, vehicle_id long, node_from long, node_to long, timestamp long, offset_m double")
    got = {r.probe_id: r.vehicles_ahead for r in obs.vehicles_ahead(probes, probes.drop("probe_id"), 5).collect()}
    assert got == {0: 3, 1: 0, 2: 4, 3: 1, 4: 2}


def test_service_level_ladder(spark):
    def want(x):
        for (low, high), m in zip(((0, 12), (12, 20), (20, 30), (30, 42), (42, 67)), (0.0, 0.2, 0.4, 0.6, 0.8)):
            if x < high:
                return 1.0 - (m + (x - low) * 0.2 / (high - low))
        return float("inf")

    rows = [(n, 1000, float(o), lanes) for n in range(0, 90, 3) for o in (0, 500, 950) for lanes in (1, 3)]
    df = spark.createDataFrame(rows, "n long, len int, off double, lanes int")
    for r in df.select("*", service_level(F.col("n"), F.col("len"), F.col("off"), F.col("lanes")).alias("los")).collect():
        assert r.los == pytest.approx(want(r.n * 1609.344 / (max(200.0, r.len - r.off) * r.lanes)))


def test_vehicles_ahead_keeps_all_partitions(spark):
    """The rows of the sweep are dealt by a number of partitions that Spark doesn't lower."""
    view = spark.createDataFrame([(1, 1, 2, 10, 5.0)], "vehicle_id long, node_from long, node_to long, timestamp long, offset_m double")
    plan = obs.vehicles_ahead(view.withColumn("probe_id", F.lit(1)), view, 5)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_vehicles_ahead_sorts_three_times(spark):
    view = spark.createDataFrame([(1, 1, 2, 10, 3.0)], "vehicle_id long, node_from long, node_to long, timestamp long, offset_m double")
    probes = view.selectExpr("7L AS probe_id", "2L AS vehicle_id", "node_from", "node_to", "timestamp", "1D AS offset_m")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = obs.vehicles_ahead(probes, view, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count(" Sort [") == 3
