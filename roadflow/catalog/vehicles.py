"""Queries of vehicle selection and routing behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow.catalog import inputs as i
from roadflow.catalog.registry import query
from roadflow.catalog.routing import ROUTES_SQL, street_state
from roadflow.operators import routing, vehicles

BASE = i.sql_with(i.STREETS_SQL, i.VEHICLES_SQL, ROUTES_SQL)
CLOCK_US, ROUND_US = 100000000, 5000000
DUE = f"active AND round_even(time_offset_us / {ROUND_US}.0, 0) * {ROUND_US} = {CLOCK_US}"


@query("due_vehicles_p1", BASE + f"SELECT id FROM vehicles WHERE {DUE}")
def due_vehicles(spark, folder):
    return vehicles.due(i.vehicles(spark, folder), CLOCK_US, ROUND_US).select("id")


@query(
    "clock_o6_p7",
    BASE + "SELECT min(time_offset_us) FILTER (active AND time_offset_us <> 0) AS clock_us, count(*) FILTER (active) AS active FROM vehicles",
)
def clock(spark, folder):
    return vehicles.clock(i.vehicles(spark, folder))


@query(
    "routing_positions_p11",
    BASE
    + """
    , p AS (SELECT *, start_index + CASE WHEN start_distance_offset = 0 THEN 0 ELSE 1 END AS r FROM vehicles)
    SELECT id, osm_route[start_index + 1] AS current_node, osm_route[start_index + 2] AS next_node, CAST(r AS INTEGER) AS routing_index,
           osm_route[r + 1] AS routing_origin, dest_node, array_to_string(osm_route[r + 1:], ',') AS open_route FROM p""",
)
def routing_positions(spark, folder):
    out = vehicles.routing_positions(i.vehicles(spark, folder))
    return out.withColumn("open_route", F.array_join(F.transform("open_route", lambda x: x.cast("string")), ","))


@query(
    "segment_end_checks_p3_p4_j1",
    BASE
    + """
    SELECT v.id, a.length_m AS length_now, b.length_m AS length_next, start_distance_offset = a.length_m AS at_end,
           coalesce(c.speed_kph = 0, false) AS next_closed
    FROM vehicles v LEFT JOIN streets a ON a.node_from = osm_route[start_index + 1] AND a.node_to = osm_route[start_index + 2]
    LEFT JOIN streets b ON b.node_from = osm_route[start_index + 2] AND b.node_to = osm_route[start_index + 3]
    LEFT JOIN street_state c ON c.node_from = b.node_from AND c.node_to = b.node_to""",
)
def segment_end_checks(spark, folder):
    out = vehicles.with_segments(i.vehicles(spark, folder), i.streets(spark, folder), street_state(spark, folder))
    return out.select(
        "id", F.col("length0").alias("length_now"), F.col("length1").alias("length_next"),
        vehicles.at_segment_end().alias("at_end"), F.col("closed1").alias("next_closed"),
    )


ALT, SEL = [0.3, 0.3, 0.2, 0.2], [0.3, 0.5, 0.2, 0.0]


def assigned(spark, folder):
    return vehicles.assign_behaviour(i.vehicles(spark, folder), ALT, SEL, 42)


def _rank_case(rank, bounds, names):
    parts = " ".join(f"WHEN {rank} <= {b} THEN '{n}'" for b, n in zip(bounds, names))
    return f"CASE {parts} ELSE '{names[-1]}' END"


BEHAVIOUR_SQL = """
n AS (SELECT count(*) AS n FROM vehicles),
r AS (SELECT v.*, n, row_number() OVER (ORDER BY ('0x' || substr(md5('42:0:' || id), 1, 12))::BIGINT, id) AS rk FROM vehicles v, n),
q AS (SELECT n, n - CAST(floor(0.3::DOUBLE * n) AS BIGINT) - 2 * CAST(floor(0.2::DOUBLE * n) AS BIGINT) AS q0,
             CAST(floor(0.3::DOUBLE * n) AS BIGINT) AS q1, CAST(floor(0.2::DOUBLE * n) AS BIGINT) AS q2,
             CAST(floor(0.5::DOUBLE * n) AS BIGINT) AS s1, CAST(floor(0.2::DOUBLE * n) AS BIGINT) AS s2 FROM n),
a AS (SELECT r.*, q0, s1, s2, CASE WHEN rk <= q0 THEN 'default' WHEN rk <= q0 + q1 THEN 'dijkstra_fastest'
             WHEN rk <= q0 + q1 + q2 THEN 'dijkstra_shortest' ELSE 'plateau_fastest' END AS alternatives FROM r, q),
behaved AS (
  SELECT *, CASE WHEN alternatives = 'default' THEN 'no_alternative'
         WHEN rk2 <= s1 THEN 'first' WHEN rk2 <= s1 + s2 THEN 'random' ELSE 'no_alternative' END AS route_selection
  FROM (SELECT *, row_number() OVER (PARTITION BY alternatives = 'default' ORDER BY ('0x' || substr(md5('42:1:' || id), 1, 12))::BIGINT, id) AS rk2 FROM a))
"""


@query(
    "assigned_behaviour_v18",
    BASE.rstrip() + "," + BEHAVIOUR_SQL + "SELECT id, alternatives, route_selection FROM behaved",
)
def assigned_behaviour(spark, folder):
    return assigned(spark, folder).select("id", "alternatives", "route_selection")


@query(
    "chosen_routes_v19",
    """SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_orderkey % 2 = 1
         THEN CAST(floor(('0x' || substr(md5('42:7:' || o_orderkey), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * (o_custkey % 4)) AS BIGINT)
         ELSE 0 END AS choice FROM orders""",
)
def chosen_routes(spark, folder):
    n = (F.col("o_custkey") % 4).cast("int")
    routes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda x: x.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    selection = F.when(F.col("o_orderkey") % 2 == 1, F.lit("random")).otherwise(F.lit("first"))
    return i.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), vehicles.choose_route(routes, selection, F.col("o_orderkey"), 7, 42).alias("choice")
    )


@query(
    "needs_route_p3_j9",
    BASE.rstrip() + "," + BEHAVIOUR_SQL
    + """SELECT alternatives, count(*) AS vehicles FROM behaved b JOIN streets s ON s.node_from = osm_route[start_index + 1] AND s.node_to = osm_route[start_index + 2]
    WHERE active AND start_distance_offset = length_m AND alternatives <> 'default' GROUP BY alternatives""",
)
def needs_route(spark, folder):
    ready = vehicles.with_segments(assigned(spark, folder).where("active"), i.streets(spark, folder), street_state(spark, folder))
    return vehicles.needs_route(ready).groupBy("alternatives").agg(F.count("*").alias("vehicles"))


@query(
    "switched_routes_v17_t24",
    BASE.rstrip() + "," + BEHAVIOUR_SQL
    + """
    , v AS (SELECT b.*, start_index + CASE WHEN start_distance_offset = 0 THEN 0 ELSE 1 END AS r, id % 3 AS mid FROM behaved b),
    t AS (SELECT v.id, v.alternatives, r, mid, start_index, osm_route, bool_or(s.node_from IS NULL) AS miss, coalesce(bool_or(speed_kph = 0), false) AS shut,
                 coalesce(sum(CASE WHEN speed_kph > 0 THEN s.length_m / (speed_kph / 3.6::DOUBLE) END), 0) AS own
          FROM v LEFT JOIN (SELECT v2.id, j, osm_route[j] AS a, osm_route[j + 1] AS b FROM v v2, LATERAL (SELECT unnest(range(r + 1, len(osm_route))) AS j)) l ON l.id = v.id
          LEFT JOIN street_state s ON s.node_from = l.a AND s.node_to = l.b GROUP BY ALL),
    fresh AS (SELECT *, CASE WHEN miss OR shut THEN 'infinity'::DOUBLE ELSE own END AS own_s,
                     alternatives NOT IN ('default', 'dijkstra_shortest') AND mid <> 5 AS stale FROM t),
    j AS (SELECT *, CASE WHEN stale THEN own_s ELSE 300.0::DOUBLE END AS tt, start_index + 1 AS ti FROM fresh),
    k AS (SELECT j.*, CASE WHEN ti <> r AND alternatives <> 'dijkstra_shortest' THEN tt - CASE WHEN s.speed_kph = 0 THEN 'infinity'::DOUBLE ELSE s.length_m / (s.speed_kph / 3.6::DOUBLE) END ELSE tt END AS rest
          FROM j LEFT JOIN street_state s ON s.node_from = osm_route[ti + 1] AND s.node_to = osm_route[ti + 2])
    SELECT id, coalesce(alternatives = 'dijkstra_shortest' OR 10.0 + id % 100 < rest * (1 - 0.5::DOUBLE), false) AS switched FROM k
    WHERE alternatives <> 'default'""".replace("THEN s.length_m / (speed_kph", "THEN s.length_m / (s.speed_kph").replace("CASE WHEN speed_kph > 0", "CASE WHEN s.speed_kph > 0").replace("bool_or(speed_kph = 0)", "bool_or(s.speed_kph = 0)"),
)
def switched_routes(spark, folder):
    state = street_state(spark, folder)
    fleet = assigned(spark, folder).where("alternatives <> 'default'").withColumns(
        {"tt_s": F.lit(300.0), "tt_map_id": (F.col("id") % 3).cast("int"), "tt_index": F.col("start_index") + 1}
    )
    fresh = vehicles.refresh_travel_times(fleet, state, 5)
    open_route = vehicles.routing_positions(fresh).select(
        "id", F.col("open_route").alias("path"), (F.lit(10.0) + F.col("id") % 100).alias("time_s")
    )
    return vehicles.switch_routes(fresh, open_route, state, 5, 0.5).select("id", "switched")


@query(
    "baseline_routes_g14",
    BASE
    + """
    , p AS (SELECT *, start_index + CASE WHEN start_distance_offset = 0 THEN 0 ELSE 1 END AS r FROM vehicles),
    q AS (SELECT *, len(osm_route[r + 1:]) >= 4 AS found FROM p)
    SELECT id, active AND found AS active, CASE WHEN found THEN '' ELSE 'no plateau route' END AS status,
           CASE WHEN found THEN array_to_string(osm_route, ',') ELSE '' END AS route FROM q""",
)
def baseline_routes(spark, folder):
    fleet = i.vehicles(spark, folder)
    found = vehicles.routing_positions(fleet).where(F.size("open_route") >= 4).select("id", F.col("open_route").alias("path"))
    return vehicles.baseline_routes(fleet, found).select(
        "id", "active", "status", F.array_join(F.transform("osm_route", lambda x: x.cast("string")), ",").alias("route")
    )
