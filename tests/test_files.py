"""Readers and writers: order, strictness, metadata and round trips."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roadflow import session
from roadflow.plans import jobs
from roadflow.sources import tables

FCD = "seq long, timestamp long, node_from long, node_to long, segment_length int, vehicle_id long, start_offset_m float, speed_mps float, active boolean"


def fcd(spark, rows):
    return spark.createDataFrame([(s, t, 1, 2, 100, v, 5.0, 10.0, True) for s, t, v in rows], FCD)


def test_merged_runs_keep_time_order_and_attributes(spark, tmp_path):
    for name, rows, attributes in (("a", [(0, 5, 1), (1, 9, 1)], {"departure_time": "x", "round_freq_s": 5}), ("b", [(0, 2, 2), (1, 9, 2)], {"departure_time": "y", "note": "n"}), ("c", [(0, 1, 3)], {})):
        store = tables.RecordStore(spark, f"{tmp_path}/{name}")
        store.append(fcd(spark, rows))
        if attributes:
            store.write_metadata(**attributes)
    tables.merge_records(spark, [f"{tmp_path}/{n}" for n in "abc"], f"{tmp_path}/all")
    merged = tables.RecordStore(spark, f"{tmp_path}/all", resume=True)
    files = sorted((tmp_path / "all" / "fcd").glob("*.parquet"))
    rows = [r for f in files for r in spark.read.parquet(str(f)).collect()]
    assert [(r.timestamp, r.seq) for r in rows] == [(1, 0), (2, 0), (5, 0), (9, 1), (9, 1)]
    assert merged.attributes() == {"departure_time": "x", "round_freq_s": 5, "note": "n"}
    width = jobs.aggregate(spark, merged.records(), f"{tmp_path}/frames", None, 5, 5, merged.attributes())
    meta = spark.read.parquet(f"{tmp_path}/frames/run_metadata").first().asDict()
    assert width == 5 and meta["departure_time"] == "x" and meta["interval_s"] == 5 and meta["vehicles"] == 3


def test_first_rows_follow_the_file(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text("v,o,d\n" + "".join(f"{k},{k * 7 % 1000},{k}\n" for k in range(9_007_199_254_740_993, 9_007_199_254_745_000)))
    rows = tables.read_routing_pairs(spark, str(path), 5).collect()
    assert [r.request_id for r in rows] == list(range(9_007_199_254_740_993, 9_007_199_254_740_998))
    od = tmp_path / "od.csv"
    od.write_text("id;lat_from;lon_from;lat_to;lon_to;start_offset_s\n" + "".join(f"{9_007_199_254_740_993 + k};1;2;3;4;{k}.0\n" for k in range(50, 0, -1)))
    rows = tables.read_od(spark, str(od), limit=3).collect()
    assert [(r.id, r.start_offset_s) for r in rows] == [(9_007_199_254_740_993 + k, k) for k in (50, 49, 48)]


def test_restrictions_are_read_strictly(spark, tmp_path):
    path = tmp_path / "speeds.csv"
    head = "node_from;node_to;speed;timestamp_from;timestamp_to\n"
    good = "1;2;30;2021-01-01 00:00:00;2021-01-01 01:00:00\n"
    path.write_text(head + good + "1;2;30\n\n")
    assert [r.speed for r in tables.read_restrictions(spark, str(path)).collect()] == [30.0]
    for bad in ("x;2;30;2021-01-01 00:00:00;2021-01-01 01:00:00\n", "1;2;30;2021-01-01 00:00:00;soon\n"):
        path.write_text(head + good + bad)
        with pytest.raises(PySparkException):
            tables.read_restrictions(spark, str(path)).collect()


def test_profiles_have_a_value_per_quarter_hour(spark, tmp_path):
    week = "array_repeat(named_struct('values', array(1D), 'cumprobs', array(1D)), {n})"
    for n in (672, 671):
        spark.sql(f"SELECT 's' AS segment_id, 1D AS length, 2D AS max_speed, {week.format(n=n)} AS profiles").write.parquet(f"{tmp_path}/{n}")
    assert tables.read_profiles(spark, f"{tmp_path}/672").first().segment_id == "s"
    with pytest.raises(PySparkException, match="672"):
        tables.read_profiles(spark, f"{tmp_path}/671").collect()


def test_map_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 14.5, 50.25), (2, 14.75, 50.5), (3, 1e-7, -3.0)], "node_id long, lon double, lat double")
    segments = spark.createDataFrame(
        [(1, 2, 120, 50, 2, "primary"), (2, 3, 80, 30, 1, "a<b&c"), (3, 1, 10, 90, 3, None)],
        "node_from long, node_to long, length_m int, max_speed_kph int, lanes int, highway string")
    tables.write_graphml(nodes, segments, f"{tmp_path}/map")
    back_nodes, back_edges = tables.read_graphml(spark, f"{tmp_path}/map")
    assert sorted(map(tuple, back_nodes.collect())) == sorted(map(tuple, nodes.collect()))
    rows = {(r.node_from, r.node_to): r for r in back_edges.collect()}
    assert [(rows[k].length, rows[k].maxspeed, rows[k].lane_tags, rows[k].highway, rows[k].oneway) for k in ((1, 2), (2, 3), (3, 1))] == [
        (120.0, 50.0, ["2"], "primary", True), (80.0, 30.0, ["1"], "a<b&c", True), (10.0, 90.0, ["3"], "unknown", True)]
    import xml.dom.minidom

    parts = sorted((tmp_path / "map").glob("part-*"))
    xml.dom.minidom.parseString("".join(p.read_text() for p in parts))


def test_vehicles_carry_box_and_day(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 14.0, 50.0), (2, 14.1, 50.1), (3, 14.2, 50.0)], "node_id long, lon double, lat double")
    segments = spark.createDataFrame([(1, 2, 1000, 50, 1), (2, 3, 1000, 50, 1)], "node_from long, node_to long, length_m int, max_speed_kph int, lanes int")
    od = spark.createDataFrame([(7, 50.0, 14.0, 50.01, 14.21, 30), (8, 50.0, 14.2, 50.0, 14.2, 40)], "id long, lat_from double, lon_from double, lat_to double, lon_to double, start_offset_s long")
    made = jobs.od_to_vehicles(spark, od, nodes, segments, download_date="2021-06-16T10:11:12", north=51.0)
    tables.save_table(made, f"{tmp_path}/vehicles")
    kept, meta = tables.load_vehicles(spark, f"{tmp_path}/vehicles")
    assert meta == {"bbox_lat_max": 51.0, "bbox_lon_min": 14.0, "bbox_lat_min": 50.0, "bbox_lon_max": 14.21, "download_date": "2021-06-16T00:00:00"}
    assert [(r.id, r.osm_route, r.time_offset_us) for r in kept.collect()] == [(7, [1, 2, 3], 30_000_000)]
    assert {r.status for r in made.collect()} == {"not started", "same origin and destination"}


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
    assert F is not None
