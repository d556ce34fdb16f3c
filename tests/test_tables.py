"""Fixture cases of frames, restrictions, quotas and demand; sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from roadflow.functions import scalars as s
from roadflow.operators import demand, filling, frames, network, positions, vehicles
from roadflow.plans import config, jobs
from roadflow.sources import tables

RECORD = (
    "seq long, timestamp long, vehicle_id long, node_from long, node_to long, speed_mps double, start_offset_m float, "
    "segment_length int, active boolean"
)


def records(spark, rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], RECORD)


def test_frame_speed_sums(spark):
    rows = frames.frame_rows(records(spark, [(1000, 1, 10, 20, 10.0, 25.0, 100, True), (1000, 2, 10, 20, 20.0, 25.0, 100, True)]), 5000).collect()
    assert len(rows) == 1 and rows[0].speed_count_first == 2 and rows[0].speed_sum_first == 30.0


def test_vehicle_counts_once_per_frame(spark):
    r = records(spark, [(1000, 1, 10, 20, 10.0, 50.0, 100, True), (1000, 1, 30, 40, 10.0, 50.0, 100, True), (1000, 2, 10, 20, 15.0, 60.0, 100, False)])
    rows = frames.frame_rows(r, 5000).collect()
    assert len(rows) == 2
    assert sum(x.count_unique_first + x.count_unique_second for x in rows) == 2
    assert sum(x.vehicles_finished for x in rows) == 1


def test_frame_interval():
    assert frames.frame_interval(1000, 100, 5) == 10 and frames.frame_interval(100, 100, 5) == 5
    assert frames.frame_interval(1000, None, 5, 3) == 5
    with pytest.raises(ValueError):
        frames.frame_interval(1000, None, 5)


def test_frame_ties_round_up_and_report_ties_to_even(spark):
    df = spark.createDataFrame([(t,) for t in (4, 5, 15, 25)], "t long")
    got = df.select(s.centred_frame(F.col("t"), 10).alias("c"), s.report_frame(F.col("t"), 10, 1).alias("r")).collect()
    assert [r.c for r in got] == [0, 1, 2, 3] and [r.r for r in got] == [0, 0, 2, 2]


@pytest.mark.parametrize("value, want", [(49.4, 49), (49.5, 50), (0.4, 0), (0.5, 1), (100.5, 101)])
def test_round_speed(spark, value, want):
    assert spark.range(1).select(s.round_speed(F.lit(value)).alias("x")).first().x == want


def test_restrictions(spark):
    segments = spark.createDataFrame([(25664661, 27349583, 753, 50, 1), (27349583, 27350859, 133, 50, 1)], "node_from long, node_to long, length_m int, max_speed_kph int, lanes int")
    rules = spark.sql(
        "SELECT 25664661L AS node_from, 27349583L AS node_to, 0D AS speed, TIMESTAMP_NTZ'2021-01-01 00:02:00' AS timestamp_from, TIMESTAMP_NTZ'2021-01-01 00:05:00' AS timestamp_to "
        "UNION ALL SELECT 27349583L, 27350859L, 29.5D, TIMESTAMP_NTZ'2021-01-01 00:06:00', TIMESTAMP_NTZ'2021-01-01 00:09:00'"
    )
    at = lambda m: F.expr(f"TIMESTAMP_NTZ'2021-01-01 00:0{m}:00'")
    state = network.apply_restrictions(network.initial_state(segments), network.restriction_changes(rules, segments, at(3), at(0)))
    first = {r.length_m: r for r in state.collect()}
    assert first[753].speed_kph == 0 and first[753].travel_time_s == float("inf") and first[133].speed_kph == 50
    later = {r.length_m: r for r in network.apply_restrictions(state, network.restriction_changes(rules, segments, at(7), at(3))).collect()}
    assert later[753].speed_kph == 50 and later[753].current_speed == 0 and later[133].speed_kph == 30


def fleet(spark, n):
    return spark.createDataFrame([(v,) for v in range(n)], "id long")


def test_quotas(spark):
    got = vehicles.assign_behaviour(fleet(spark, 10), [0.5, 0.5, 0, 0], [0.5, 0.5, 0, 0]).groupBy("alternatives", "route_selection").count()
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {("default", "no_alternative"): 5, ("dijkstra_fastest", "first"): 5}
    four = vehicles.assign_behaviour(fleet(spark, 4), [0.25] * 4, [0.25] * 4)
    assert {r.alternatives for r in four.collect()} == set(vehicles.ALTERNATIVES)
    assert {r.route_selection for r in four.collect()} == set(vehicles.SELECTIONS)


@pytest.mark.parametrize("a, b", [([0.4, 0.6, 0, 0], [0.5, 0.5, 0, 0]), ([0.5, 0.4, 0, 0], [0.5, 0.5, 0, 0])])
def test_bad_quotas(a, b):
    with pytest.raises(ValueError):
        vehicles.check_ratios(a, b)


@pytest.mark.parametrize("offer, switches", [(40.0, True), (60.0, False), (50.0, False)])
def test_route_switch(spark, offer, switches):
    v = spark.createDataFrame(
        [(1, 0, 0.0, [1, 2, 3], "dijkstra_fastest", 100.0, 1, 0)],
        "id long, start_index int, start_distance_offset double, osm_route array<long>, alternatives string, tt_s double, tt_map_id int, tt_index int",
    )
    state = spark.createDataFrame([(1, 2, 50.0, 50), (2, 3, 50.0, 50), (1, 3, 40.0, 50)], "node_from long, node_to long, travel_time_s double, speed_kph int")
    offer_table = spark.createDataFrame([(1, [1, 3], offer)], "id long, path array<long>, time_s double")
    r = vehicles.switch_routes(v, offer_table, state, 1, 0.5).first()
    assert r.switched is switches and r.osm_route == ([1, 3] if switches else [1, 2, 3])


def test_remapped_routes(spark):
    v = spark.createDataFrame([(1, [1, 2, 3, 4], True, 1, 4), (2, [1, 9], True, 1, 9)], "id long, osm_route array<long>, active boolean, origin_node long, dest_node long")
    merged = spark.createDataFrame([(3, 2)], "node long, label long")
    segments = spark.createDataFrame([(1, 2), (2, 4)], "node_from long, node_to long")
    got = {r.id: r for r in network.remap_routes(v, merged, segments).collect()}
    assert got[1].osm_route == [1, 2, 4] and got[1].active and got[2].osm_route == [] and not got[2].active


def test_components_of_long_chain(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.label for r in network.components(links).collect()}
    assert {got[n] for n in range(41)} == {0} and got[101] == 100


def test_nearest_nodes_small(spark):
    nodes = spark.createDataFrame([(n, 14 + (n * 37 % 50) / 1000, 50 + (n * 11 % 40) / 1000) for n in range(80)], "node_id long, lon double, lat double")
    points = spark.createDataFrame([(p, 14 + p * 0.0071, 50 + (p * 13 % 9) * 0.005) for p in range(8)], "point_id long, lon double, lat double")
    import math

    def d(a, b):
        h = math.sin(math.radians(b.lat - a.lat) / 2) ** 2 + math.cos(math.radians(a.lat)) * math.cos(math.radians(b.lat)) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
        return h

    got = {r.point_id: r.node_id for r in positions.nearest_nodes(points, nodes).collect()}
    all_nodes = nodes.collect()
    for p in points.collect():
        assert d(p, next(n for n in all_nodes if n.node_id == got[p.point_id])) == pytest.approx(min(d(p, n) for n in all_nodes))


def test_flow_file_to_od(spark, tmp_path):
    box = "POLYGON((14.4 50.0,14.4 50.1,14.5 50.1,14.5 50.0,14.4 50.0))"
    path = tmp_path / "flow.csv"
    path.write_text(
        '"id_flow","count_devices","start_time","end_time","id_rectangle_from","geom_rectangle_from","id_rectangle_to","geom_rectangle_to","geom_flow"\n'
        f'"7","4","2021-06-16 08:00:00+02","2021-06-16 08:15:00+02","a","{box}","b","{box}","00"\n'
        f'"8","0","2021-06-16 08:00:00+02","2021-06-16 08:15:00+02","a","{box}","b","{box}","00"\n'
    )
    jobs.flows_to_od(spark, str(path), str(tmp_path / "od"))
    rows = tables.read_od(spark, str(tmp_path / "od")).orderBy("id").collect()
    assert [r.id for r in rows] == [0, 1, 2, 3] and rows[0].start_offset_s == 0 and rows[-1].start_offset_s < 900
    assert all(14.4 <= r.lon_from <= 14.5 and 50.0 <= r.lat_to <= 50.1 and r.route_step_s == 20 for r in rows)


def test_combined_matrices(spark, tmp_path):
    od = tmp_path / "m.csv"
    od.write_text("id;lat_from;lon_from;lat_to;lon_to;start_offset_s\n1;1;2;3;4;5\n2;5;6;7;8;0\n")
    rules = tmp_path / "rules.csv"
    rules.write_text(f"timestamp;swap;path\n7:00:00;0;{od}\n12:35:00;1;{od}\n")
    jobs.combine_od(spark, str(rules), str(tmp_path / "out"))
    rows = tables.read_od(spark, str(tmp_path / "out")).orderBy("id").collect()
    assert [(r.id, r.lat_from, r.start_offset_s) for r in rows] == [(1, 1.0, 25205), (2, 5.0, 25200), (3, 3.0, 45305), (4, 7.0, 45300)]


def test_vehicle_file(spark, tmp_path):
    spark.sql(
        "SELECT 1L AS id, INTERVAL '5' SECOND AS time_offset, INTERVAL '20' SECOND AS frequency, INTERVAL '5' SECOND AS fcd_sampling_period, array(1L, 2L) AS osm_route, true AS active, "
        "50D AS bbox_lat_max, 14D AS bbox_lon_min, 49D AS bbox_lat_min, 15D AS bbox_lon_max, '2024-01-10' AS download_date "
        "UNION ALL SELECT 2L, INTERVAL '5' SECOND, INTERVAL '20' SECOND, INTERVAL '5' SECOND, array(1L), true, 50D, 14D, 49D, 15D, '2024-01-10'"
    ).write.parquet(str(tmp_path / "v"))
    got, meta = tables.load_vehicles(spark, str(tmp_path / "v"))
    rows = got.collect()
    assert len(rows) == 1 and rows[0].time_offset_us == 5_000_000 and rows[0].frequency_us == 5_000_000
    assert meta["download_date"] == "2024-01-10" and meta["bbox_lat_max"] == 50


def test_record_store(spark, tmp_path):
    r = records(spark, [(n, 1, 1, 2, 1.0, 1.0, 10, True) for n in range(10)])
    store = tables.RecordStore(spark, str(tmp_path / "run"), 4)
    store.append(r.coalesce(1))
    store.write_metadata(departure_time="2021-01-01 00:00:00")
    store.write_metadata(departure_time="later")
    assert store.records().count() == 10 and len(list((tmp_path / "run" / "fcd").glob("*.parquet"))) == 3
    assert store.metadata().first().departure_time == "2021-01-01 00:00:00"
    with pytest.raises(FileExistsError):
        tables.RecordStore(spark, str(tmp_path / "run"))
    tables.RecordStore(spark, str(tmp_path / "run"), resume=True).append(r)
    assert store.records().count() == 20
    assert tables.load_records(spark, str(tmp_path / "run" / "fcd"), per_file=1).count() == len(list((tmp_path / "run" / "fcd").glob("*.parquet")))


def test_aggregate_job_and_frame_lookup(spark, tmp_path):
    r = records(spark, [(n * 7, n % 3, 1, 2, 2.0, float(n % 10), 10, n != 29) for n in range(30)])
    assert jobs.aggregate(spark, r, str(tmp_path / "f"), 10, 5) == 20
    rows = tables.read_frame(spark, str(tmp_path / "f"), 5).collect()
    assert rows and {x.frame_id for x in rows} == {5}
    edges = spark.createDataFrame([(1, 2, 36.0)], "node_from long, node_to long, max_speed double")
    jobs.enrich(spark, str(tmp_path / "f"), edges, str(tmp_path / "e"))
    assert {x.los for x in spark.read.parquet(str(tmp_path / "e")).collect()} == {20}
    with pytest.raises(Exception, match="Edge not found"):
        jobs.enrich(spark, str(tmp_path / "f"), edges.where("node_from = 9"), str(tmp_path / "e2"))


def test_restriction_file(spark, tmp_path):
    path = tmp_path / "speeds.csv"
    path.write_text("node_from;node_to;speed;timestamp_from;timestamp_to\n1;2;0;2021-01-01 00:00:00;2021-01-01 00:05:00\n3;4\n")
    rows = tables.read_restrictions(spark, str(path)).collect()
    assert len(rows) == 1 and rows[0].timestamp_to.minute == 5


def test_graphml(spark, tmp_path):
    path = tmp_path / "map.graphml"
    edge = '<edge source="{a}" target="{b}" id="0"><data key="d2">{w}</data><data key="d3">residential</data><data key="d4">50</data><data key="d5">{lanes}</data></edge>'
    path.write_text(
        '<graphml><key id="d0" for="node" attr.name="x" attr.type="string"/><key id="d1" for="node" attr.name="y" attr.type="string"/>'
        '<key id="d2" for="edge" attr.name="length" attr.type="string"/><key id="d3" for="edge" attr.name="highway" attr.type="string"/>'
        '<key id="d4" for="edge" attr.name="maxspeed" attr.type="string"/><key id="d5" for="edge" attr.name="lanes" attr.type="string"/><graph edgedefault="directed">\n'
        '<node id="1"><data key="d0">14.1</data><data key="d1">50.1</data></node>\n<node id="2"><data key="d0">14.2</data><data key="d1">50.2</data></node>\n'
        + edge.format(a=1, b=2, w=10.5, lanes="['2', '4']") + "\n" + edge.format(a=2, b=1, w=20.4, lanes="1") + "\n</graph></graphml>"
    )
    jobs.build_map(spark, str(path), str(tmp_path / "m"))
    rows = {r.node_from: r for r in spark.read.parquet(str(tmp_path / "m" / "segments")).collect()}
    assert rows[1].length_m == 11 and rows[2].length_m == 20 and rows[1].max_speed_kph == 50 and rows[1].lanes == 2
    assert spark.read.parquet(str(tmp_path / "m" / "nodes")).count() == 2


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({
        "traffic-simulator": {"round-frequency-s": 10, "speeds-path": "", "seed": 7, "max_records_per_file": 5},
        "run": {"vehicles-path": "v.parquet"}, "alternatives": {"plateau-fastest": 0.4}, "route-selection": {"first": 0.4},
    }))
    c = config.load_config(str(path), "/data")
    assert c.vehicles_path == "/data/v.parquet" and c.settings.round_us == 10_000_000 and c.speeds_path is None
    assert c.alternatives.as_list() == [0.6, 0.0, 0.0, 0.4] and c.max_records_per_file == 5
    with pytest.raises(ValueError):
        config.AlternativesRatio(0.7, 0.7).as_list()


def test_polyline_point(spark):
    line = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 3D, 'y', 0D), named_struct('x', 3D, 'y', 1D))"
    df = spark.sql(f"SELECT {line} AS line, explode(array(0D, 0.5D, 0.75D, 0.875D, 1D)) AS w")
    got = [(r.p.x, r.p.y) for r in df.select(s.polyline_point(F.col("line"), F.col("w")).alias("p")).collect()]
    assert got == [(0, 0), (2, 0), (3, 0), (3, 0.5), (3, 1)]


def test_gap_filling_wraps_into_next_segment(spark):
    r = records(spark, [(0, 1, 1, 2, 10.0, 80.0, 100, True), (4, 1, 2, 3, 20.0, 20.0, 50, True)])
    got = filling.fill_gaps(filling.with_next(filling.prepare(r))).orderBy("frame").collect()
    assert [(x.frame, x.node_from, x.start_offset_m, x.speed_mps) for x in got] == [
        (0, 1, 80.0, 10.0), (1, 1, 90.0, 12.5), (2, 1, 100.0, 15.0), (3, 2, 10.0, 17.5), (4, 2, 20.0, 20.0)
    ]


def test_bounding_box_clamps(spark):
    od = spark.createDataFrame([(80.0, 10.0, 60.0, 170.0)], "lat_from double, lon_from double, lat_to double, lon_to double")
    assert tuple(demand.bounding_box(od, 1.0, 1.0).first()) == (90.0, -150.0, 40.0, 180.0)


def test_straight_line_near_the_axes(spark):
    """Numbers below a thousandth are written without an exponent, digit by digit."""
    pairs = [(0.000244140625, -0.000204), (-0.0002, 0.00101), (0.0, 14.5), (0.00012345678901234567, -50.0)]
    got = spark.createDataFrame(pairs, "x double, y double").select("x", "y", s.straight_line(*map(F.col, "xyyx")).alias("line")).collect()
    assert {r.line for r in got} == {f"LINESTRING ({x} {y}, {y} {x})" for x, y in pairs}


def test_shuffle_files_go_when_a_table_is_written(spark):
    """An iteration writes many tables; the shuffle files of those written are gone before the driver collects its garbage."""
    import glob
    import os

    from roadflow.session import cut_lineage

    def files():
        folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
        return {x for f in folders for x in glob.glob(os.path.join(f, "*", "shuffle_*.data"))}

    kept, before = [], files()
    for n in range(3):
        rows = spark.range(20000).groupBy((F.col("id") % 5000).alias("k")).agg(F.sum("id").alias(f"s{n}"))
        kept.append((rows, cut_lineage(rows)))
    assert not files() - before
    assert [t.count() for _, t in kept] == [5000] * 3 and kept[0][0].count() == 5000
