"""Restrictions in force, speeds as versions, sessions, standstills and merged counts against plain loops."""

import random

from pyspark.sql import functions as F

from roadflow.operators import frames, network, pauses
from roadflow.operators.ordering import as_of

RECORDS = "record_id long, node_from long, node_to long, timestamp long"
WINDOWS = "restriction_id long, node_from long, node_to long, speed double, timestamp_from long, timestamp_to long"
UPDATES = "node_from long, node_to long, timestamp long, speed_kph double"
FCD = "seq long, timestamp long, vehicle_id long, node_from long, node_to long, speed_mps double, start_offset_m float, segment_length int"


def test_dyadic_pieces(spark):
    draw = random.Random(4)
    ranges = [(a, a + draw.choice([0, 1, 2, 7, 100, 5000, 10**6])) for a in (draw.randint(-5000, 10**6) for _ in range(150))] + [(5, 4), (0, 2**30), (-8, 7)]
    df = spark.createDataFrame(ranges, "low long, high long").withColumn("p", network.dyadic_pieces(F.col("low"), F.col("high")))
    for low, high, pieces in df.collect():
        spans = sorted((p.piece << p.level, (p.piece + 1 << p.level) - 1) for p in pieces)
        # They follow one another without a hole or an overlap, two of a length at most.
        assert [s[0] for s in spans] == ([low] if spans else []) + [s[1] + 1 for s in spans[:-1]]
        assert (spans[-1][1] == high) if low <= high else not spans
        assert all(sum(p.level == k for p in pieces) <= 2 for k in {p.level for p in pieces})


def _met(records, windows):
    return {(r[0], w[0], w[3]) for r in records for w in windows if r[1:3] == w[1:3] and w[4] <= r[3] <= w[5]}


def test_restrictions_in_force(spark):
    draw = random.Random(9)
    windows = [(k, k % 3, 9, float(k % 50), t, t + draw.randint(-2, 900)) for k, t in ((k, draw.randint(0, 5000)) for k in range(150))]
    records = [(k, k % 4, 9, draw.randint(-10, 6000)) for k in range(300)]
    r, w = spark.createDataFrame(records, RECORDS), spark.createDataFrame(windows, WINDOWS)
    assert {tuple(x) for x in network.restrictions_in_force(r, w).collect()} == _met(records, windows)
    best = {x.record_id: (x.in_force, x.speed) for x in network.winning_restriction(r, w).collect()}
    for record in records:
        own = [q for q in windows if q[1:3] == record[1:3] and q[4] <= record[3] <= q[5]]
        assert best[record[0]] == (len(own), max(own, key=lambda q: (q[4], q[5], q[3]))[3] if own else None)
    none = w.where("false")
    assert network.restrictions_in_force(r, none).count() == 0
    assert network.winning_restriction(r, none).where("in_force = 0 AND speed IS NULL").count() == 300


def test_records_and_pieces_meet_by_merging(spark):
    """Both sides hold many rows per byte Spark sees, so neither may be taken for small and sent to the driver."""
    r, w = spark.createDataFrame([(1, 1, 9, 5)], RECORDS), spark.createDataFrame([(1, 1, 9, 30.0, 0, 9)], WINDOWS)
    for ask in (network.restrictions_in_force, network.winning_restriction):
        plan = ask(r, w)._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and "piece" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_one_segment_with_ten_thousand_overlapping_windows(spark):
    windows = spark.range(10_000).select(
        F.col("id").alias("restriction_id"), F.lit(1).cast("long").alias("node_from"), F.lit(2).cast("long").alias("node_to"),
        (F.col("id") % 90).cast("double").alias("speed"), F.col("id").alias("timestamp_from"), (F.lit(1_000_000) - F.col("id")).alias("timestamp_to"))
    records = spark.range(20_000).select(
        F.col("id").alias("record_id"), F.lit(1).cast("long").alias("node_from"), F.lit(2).cast("long").alias("node_to"), (F.col("id") * 50).alias("timestamp"))
    got = {r.record_id: (r.in_force, r.speed) for r in network.winning_restriction(records, windows).collect()}
    for k in range(0, 20_000, 37):
        t = 50 * k
        n = max(0, min(10_000, t + 1, 1_000_000 - t + 1))
        assert got[k] == (n, float((n - 1) % 90) if n else None)
    few = records.where("record_id IN (3, 10000, 19999)")
    assert network.restrictions_in_force(few, windows).count() == 151 + 10_000 + 51


def test_as_of(spark):
    draw = random.Random(2)
    facts = [(draw.randint(0, 3), draw.randint(0, 500), draw.randint(0, 99)) for _ in range(120)]
    asked = [(k, draw.choice([0, 1, 2, 3, 4, None]), draw.randint(-20, 600)) for k in range(200)]
    out = as_of(
        spark.createDataFrame(asked, "id long, key long, t long"), spark.createDataFrame(facts, "key long, t long, v long"),
        ["key"], "t", F.floor(F.col("t") / 40), ["v"])
    for r in out.collect():
        known = [(t, v) for key, t, v in facts if key == r.key and t <= r.t]
        assert (r.fact.v if r.fact else None) == (max(known)[1] if known else None)


def test_versions_and_route_times(spark):
    updates = [(0, 1, 100, 36.0), (0, 1, 500, 0.0), (0, 1, 90_000, 18.0), (1, 2, 50, 72.0), (0, 1, 100, 30.0)]
    u = spark.createDataFrame(updates, UPDATES)
    versions = {tuple(r) for r in network.speed_versions(u).collect()}
    assert versions == {(0, 1, 100, 500, 36.0), (0, 1, 500, 90_000, 0.0), (0, 1, 90_000, None, 18.0), (1, 2, 50, None, 72.0)}
    segments = spark.createDataFrame([(0, 1, 100, 50), (1, 2, 200, 36)], "node_from long, node_to long, length_m int, max_speed_kph int")
    routes = [(1, 10, [0, 1, 2]), (2, 100, [0, 1, 2]), (3, 600, [0, 1]), (4, 200_000, [0, 1]), (5, 0, [0]), (6, 0, [0, 1, 7]), (7, 0, [])]
    got = {r.id: r.travel_time_s for r in network.route_times_as_of(
        spark.createDataFrame(routes, "id long, departure long, osm_route array<long>"), segments, u).collect()}
    assert abs(got[1] - (7.2 + 20)) < 1e-9 and abs(got[2] - (10 + 20)) < 1e-9 and got[3] == float("inf") and abs(got[4] - 20) < 1e-9
    assert got[5] is None and got[6] is None and got[7] is None


def _track(count):
    draw = random.Random(6)
    t, rows = 1000, []
    for k in range(count):
        t += draw.choice([1, 5, 5, 30, 61, 60, 59])
        rows.append((k, t, k % 2, 0, 9, draw.choice([0.0, 0.0, 0.5, 8.0]), 0.0, 100))
    return rows


def test_sessions(spark):
    rows, want = _track(300), []
    for v in (0, 1):
        times = sorted(r[1] for r in rows if r[2] == v)
        start = 0
        for k in range(1, len(times) + 1):
            if k == len(times) or times[k] - times[k - 1] > 60:
                want.append((v, times[start], times[k - 1], k - start))
                start = k
    got = pauses.sessions(spark.createDataFrame(rows, FCD), 60)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_standstills_cross_blocks(spark):
    rows, want = _track(400), []
    for v in (0, 1):
        own, run = sorted(r for r in rows if r[2] == v), []
        for r in [*own, None]:
            if r is not None and r[5] < 1:
                run.append(r[1])
            else:
                if run and run[-1] - run[0] >= 40:
                    want.append((v, run[0], run[-1], len(run)))
                run = []
    for block in (10, 3600):
        got = pauses.standstills(spark.createDataFrame(rows, FCD), 1.0, 40, block)
        assert sorted(map(tuple, got.select("vehicle_id", "begins", "ends", "records").collect())) == sorted(want)


def test_merged_sketches(spark):
    r = spark.range(60_000).select(
        F.col("id").alias("seq"), (F.col("id") % 50 * 100 + F.when(F.col("id") % 50 > 30, 400).otherwise(0)).alias("timestamp"),
        (F.col("id") * 7919 % 20_011).alias("vehicle_id"), (F.col("id") % 3).alias("node_from"), F.lit(9).cast("long").alias("node_to"))
    stored = frames.vehicle_sketches(r, 100).cache()
    framed = frames.assign_frames(r, 100)
    for low, high in ((0, 60), (3, 9), (31, 40)):
        want = framed.where(F.col("frame_id").between(low, high)).agg(F.count_distinct("vehicle_id")).first()[0]
        got = frames.vehicles_in_range(stored, low, high).first()[0]
        assert abs(got - want) <= 0.03 * want
    per_segment = {x.node_from: x.vehicles for x in frames.vehicles_in_range(stored, 0, 60, ["node_from"]).collect()}
    exact = {x.node_from: x.n for x in r.groupBy("node_from").agg(F.count_distinct("vehicle_id").alias("n")).collect()}
    assert per_segment.keys() == exact.keys() and all(abs(per_segment[k] - exact[k]) <= 0.03 * exact[k] for k in exact)
    running = {x.frame_id: x.vehicles for x in frames.running_vehicles(stored).collect()}
    assert sorted(running) == list(range(0, 54))
    for frame in (0, 7, 30, 33, 53):
        want = framed.where(F.col("frame_id") <= frame).agg(F.count_distinct("vehicle_id")).first()[0]
        assert abs(running[frame] - want) <= 0.03 * want
    assert frames.running_vehicles(stored.where("false")).count() == 0
