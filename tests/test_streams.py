"""Streams on Spark's own state against their batch forms."""

import json

import pytest
from pyspark.sql import functions as F

from roadflow.operators import frames, observations
from roadflow.sources import tables
from roadflow.streaming import stateful

RECORD = (
    "seq long, timestamp long, vehicle_id long, node_from long, node_to long, speed_mps double, start_offset_m float, "
    "segment_length int, active boolean"
)
FAR = 10_000_000


def rows(count=60):
    return [(n, 1000 + n * 3, n % 5, n % 2, 9, float(n % 7), float(n * 13 % 90), 100, n % 11 > 0) for n in range(count)]


def far(k=0):
    """A record far ahead closes what lies before it; its own windows stay open."""
    return [(FAR + k, FAR + k, 99, 77, 9, 0.0, 0.0, 100, True)]


def run(spark, tmp_path, form, parts, name="s"):
    """Feed the parts one after the other, each to a query restarted from the checkpoint; returns the outcome and the last query."""
    source, query = str(tmp_path / name / "in"), None
    for part in [*parts, far()]:
        spark.createDataFrame(part, RECORD).coalesce(1).write.mode("append").parquet(source)
        stream = form(spark.readStream.schema(RECORD).parquet(source))
        query = stateful.append_available(stream, str(tmp_path / name / "out"), str(tmp_path / name / "log"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name / "out")), query


def cut(all_rows, size):
    return [all_rows[k : k + size] for k in range(0, len(all_rows), size)]


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_frame_rows(spark, tmp_path):
    r = spark.createDataFrame(rows(), RECORD)
    got, _ = run(spark, tmp_path, lambda s: stateful.frame_rows(s, 30), cut(rows(), 20))
    want = frames.frame_rows(r, 30)
    same(got.select(want.columns), want)
    got, _ = run(spark, tmp_path, lambda s: stateful.windowed_frames(s, 30), cut(rows(), 30), "w")
    same(got, frames.assign_frames(r, 30).groupBy("frame_id", "node_from", "node_to").agg(F.sum("speed_mps"), F.count("*")))


def test_late_records_count_within_the_lateness(spark, tmp_path):
    mixed = [rows()[k] for k in sorted(range(60), key=lambda k: k // 8 * 8 - k % 8)]
    got, _ = run(spark, tmp_path, lambda s: stateful.frame_rows(s, 30, "60 seconds"), cut(mixed, 15))
    want = frames.frame_rows(spark.createDataFrame(rows(), RECORD), 30)
    same(got.select(want.columns), want)


def test_added_stats(spark, tmp_path):
    blocks, _ = run(spark, tmp_path, lambda s: stateful.stretches(s, 30, block_s=20), cut(rows(), 25))
    same(stateful.added_stats_of(blocks), frames.added_stats(spark.createDataFrame(rows(), RECORD), 30))


def test_latest_speeds_and_eviction(spark, tmp_path):
    r = spark.createDataFrame(rows(), RECORD)
    latest, _ = run(spark, tmp_path, lambda s: stateful.latest_speeds(s, window="40 seconds"), cut(rows(), 25))
    same(stateful.segment_speed_of(latest), observations.segment_speed(r))
    # Evicted are windows' latest records: the latest of a vehicle decides, so the outcome is that of the records.
    same(stateful.segment_speed_of(latest, 1100), observations.segment_speed(observations.evict(r, 1100)))


def test_a_batch_repeated_after_a_failure_counts_once(spark, tmp_path):
    first, second = cut(rows(), 30)
    run(spark, tmp_path, lambda s: stateful.frame_rows(s, 30), [first, second])
    log = tmp_path / "s" / "log"
    last = max(int(p.name) for p in (log / "commits").iterdir() if p.name.isdigit())
    for p in [log / "commits" / str(last), log / "commits" / f".{last}.crc"]:
        p.unlink(missing_ok=True)  # the driver was lost before it noted the batch as done
    stream = stateful.frame_rows(spark.readStream.schema(RECORD).parquet(str(tmp_path / "s" / "in")), 30)
    stateful.append_available(stream, str(tmp_path / "s" / "out"), str(log))
    want = frames.frame_rows(spark.createDataFrame(rows(), RECORD), 30)
    same(spark.read.parquet(str(tmp_path / "s" / "out")).select(want.columns), want)


def test_broken_state_is_an_error(spark, tmp_path):
    source, log = str(tmp_path / "in"), tmp_path / "log"

    def take(part):
        spark.createDataFrame(part, RECORD).coalesce(1).write.mode("append").parquet(source)
        stream = stateful.latest_speeds(spark.readStream.schema(RECORD).parquet(source), window="1 hour")
        stateful.append_available(stream, str(tmp_path / "out"), str(log))

    take(rows()[:30])
    spark.sparkContext._jvm.org.apache.spark.sql.execution.streaming.state.StateStore.stop()
    for file in [*(log / "state").rglob("*.delta"), *(log / "state").rglob("*.snapshot"), *(log / "state").rglob(".*.crc")]:
        file.write_bytes(b"no state") if file.suffix != ".crc" else file.unlink()
    with pytest.raises(Exception):
        take(rows()[30:])


def _sides(stream):
    view = stream.select("seq", "vehicle_id", "node_from", "node_to", "timestamp", F.col("start_offset_m").cast("double").alias("offset_m"))
    return view.withColumnRenamed("seq", "probe_id"), view


def test_record_pairs(spark, tmp_path):
    got, _ = run(spark, tmp_path, lambda s: stateful.record_pairs(*_sides(s), 10).select("probe_id", "seq"), cut(rows(), 20))
    want = {(a[0], b[0]) for a in rows() for b in rows() if a[3] == b[3] and abs(a[1] - b[1]) <= 10}
    pairs = [tuple(x) for x in got.where(f"seq < {FAR}").collect()]
    assert set(pairs) == want and len(pairs) == len(want)


def test_vehicles_ahead_and_levels(spark, tmp_path):
    ahead, _ = run(spark, tmp_path, lambda s: stateful.vehicles_ahead(*_sides(s), 10), cut(rows(), 30))
    r = spark.createDataFrame(rows(), RECORD)
    segments = spark.createDataFrame([(0, 9, 100, 1), (1, 9, 100, 2)], "node_from long, node_to long, length_m int, lanes int")
    want = observations.service_levels(*_sides(r), segments, 10).select("probe_id", "vehicles_ahead", "los")
    same(stateful.service_levels_of(ahead, segments).select("probe_id", "vehicles_ahead", "los"), want)


def test_state_of_the_range_join_does_not_grow_with_the_stream(spark, tmp_path):
    """Ten times the records in ten times the time: both states hold what the band needs and no more."""
    sizes = {}
    for name, count in (("short", 200), ("long", 2000)):
        source, held = str(tmp_path / name / "in"), []
        for part in cut(rows(count), 100):
            spark.createDataFrame(part, RECORD).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(source)
        query = stateful.append_available(
            stateful.record_pairs(*_sides(stream), 10).select("probe_id", "seq"), str(tmp_path / name / "out"), str(tmp_path / name / "log"))
        for progress in query.recentProgress:
            held += [op["numRowsTotal"] for op in json.loads(progress.json if isinstance(progress.json, str) else json.dumps(progress))["stateOperators"]]
        sizes[name] = max(held)
    assert sizes["long"] <= 1.1 * sizes["short"] + 20


def test_vehicles_ahead_keeps_no_pairs(spark, tmp_path):
    """All records of a crowded segment within the tolerance: the state holds lists by window, not probe and vehicle."""
    crowd = [(n, 1000 + n % 7, n, 1, 9, 5.0, float(n), 1000, True) for n in range(80)]
    ahead, query = run(spark, tmp_path, lambda s: stateful.vehicles_ahead(*_sides(s), 10), cut(crowd, 40))
    assert {r.probe_id: r.vehicles_ahead for r in ahead.collect()} == {n: 79 - n for n in range(80)}
    held = [op["numRowsTotal"] for entry in query.recentProgress
            for op in json.loads(entry.json if isinstance(entry.json, str) else json.dumps(entry))["stateOperators"]]
    assert 0 < max(held) <= 10


def test_vehicles_ahead_at_the_ends_of_the_tolerance(spark, tmp_path):
    """Probes at the borders of the blocks of time, negative tolerance ends included, late records within the lateness."""
    placed = [(n, t, n, 1, 9, 5.0, float(n), 1000, True) for n, t in enumerate([980, 999, 1000, 1001, 1019, 1020, 1021, 1030, 1040, 1041, 1000, 990])]
    for tolerance in (0, 1, 10, 20):
        ahead, _ = run(spark, tmp_path, lambda s, w=tolerance: stateful.vehicles_ahead(*_sides(s), w, "100 seconds"), cut(placed, 5), f"t{tolerance}")
        want = {a[0]: len({b[2] for b in placed if abs(a[1] - b[1]) <= tolerance and b[6] > a[6] and b[2] != a[2]}) for a in placed}
        assert {r.probe_id: r.vehicles_ahead for r in ahead.collect()} == want


def test_record_time(spark):
    row = tables.with_datetime(spark.createDataFrame([(1704067207,)], "timestamp long")).first()
    assert str(row.datetime) == "2024-01-01 00:00:07"
