"""Draws: uniform, independent of each other, for ids of any size; nearest nodes at any closeness."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from roadflow.operators import demand, positions, vehicles


def _correlation(pairs):
    n = len(pairs)
    mx, my = sum(x for x, _ in pairs) / n, sum(y for _, y in pairs) / n
    sxy = sum((x - mx) * (y - my) for x, y in pairs)
    return sxy / (sum((x - mx) ** 2 for x, _ in pairs) * sum((y - my) ** 2 for _, y in pairs)) ** 0.5


@pytest.mark.parametrize("first_id", [0, 4_000_000_000_000])
def test_points_fill_their_boxes(spark, first_id):
    box = "POLYGON((0 0,0 1,1 1,1 0))"
    flows = spark.createDataFrame(
        [(first_id + k, 40, "2021-06-16 00:00:00+00", "2021-06-16 01:00:00+00", box, box) for k in range(50)],
        "id_flow long, count_devices long, start_time string, end_time string, geom_rectangle_from string, geom_rectangle_to string")
    rows = demand.od_from_flows(flows).collect()
    assert len(rows) == 2000
    names = ["lat_from", "lon_from", "lat_to", "lon_to", "start_offset_s"]
    for n, a in enumerate(names):
        for b in names[:n]:
            assert abs(_correlation([(r[a], r[b]) for r in rows])) < 0.1
        # Every cell of a 4 x 4 grid over two draws is met about as often.
    cells = Counter((int(r["lat_from"] * 4), int(r["lon_from"] * 4)) for r in rows)
    assert len(cells) == 16 and min(cells.values()) > 70
    assert len({(r["lat_from"], r["lon_from"]) for r in rows}) == 2000


def test_every_alternative_gets_its_share_of_selections(spark):
    fleet = spark.range(4_000_000_000, 4_000_006_000)
    rows = vehicles.assign_behaviour(fleet, [0.3, 0.3, 0.2, 0.2], [0.3, 0.5, 0.2, 0.0], 42).collect()
    met = defaultdict(Counter)
    for r in rows:
        met[r["alternatives"]][r["route_selection"]] += 1
    assert Counter(r["alternatives"] for r in rows) == {"default": 1800, "dijkstra_fastest": 1800, "dijkstra_shortest": 1200, "plateau_fastest": 1200}
    for name, size in (("dijkstra_fastest", 1800), ("dijkstra_shortest", 1200), ("plateau_fastest", 1200)):
        assert abs(met[name]["random"] - size * 2 / 7) < 90


def test_route_picks_are_not_a_round_robin(spark):
    routes = F.array(*[F.lit(k) for k in range(4)])
    picks = spark.range(2000).select(*[
        vehicles.choose_route(routes, F.lit("random"), F.col("id"), step, 1).alias(f"s{step}") for step in (1, 2)]).collect()
    assert all(400 < n < 600 for n in Counter(r["s1"] for r in picks).values())
    assert all(80 < n < 170 for n in Counter((r["s1"], r["s2"]) for r in picks).values())
    assert all(350 < n < 650 for n in Counter((b["s1"] - a["s1"]) % 4 for a, b in zip(picks, picks[1:])).values())


def test_nearest_nodes_lie_as_close_as_they_like(spark):
    nodes = [(1, 14.0, 50.0), (2, 14.0 + 2e-9, 50.0), (3, 14.0 + 1e-14, 50.0), (4, 1e-300, 0.0), (5, 2e-300, 0.0), (6, -120.0, -40.0)]
    points = [(10, 14.0 + 2e-9, 50.0), (11, 14.0, 50.0), (12, 14.5, 50.0), (13, 0.0, 0.0), (14, -119.0, -41.0)]
    got = positions.nearest_nodes(
        spark.createDataFrame(points, "point_id long, lon double, lat double"), spark.createDataFrame(nodes, "node_id long, lon double, lat double"))
    assert dict(map(tuple, got.collect())) == {10: 2, 11: 1, 12: 2, 13: 4, 14: 6}
