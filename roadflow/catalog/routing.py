"""Queries of the path search."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow.catalog import inputs as i
from roadflow.catalog.network import CHANGES_SQL, STATE_SQL, state_after_updates
from roadflow.catalog.registry import query
from roadflow.functions.scalars import segment_weight
from roadflow.operators import routing


def requests(spark, folder):
    """One request per supplier over the road graph."""
    n = i.table(spark, folder, "part").count()
    k = F.col("s_suppkey")
    return i.table(spark, folder, "supplier").select(
        k.cast("bigint").alias("request_id"), (k * 17 % n).cast("bigint").alias("origin"), ((k * 13 + 7) % n).cast("bigint").alias("dest")
    )


def lengths(spark, folder):
    weight = segment_weight(F.col("length_m"), F.col("node_from"), F.col("node_to"))
    return routing.weighted(i.road(spark, folder), weight)


REQUESTS_SQL = """
requests AS (
  SELECT CAST(s_suppkey AS BIGINT) AS request_id, CAST(s_suppkey * 17 % n AS BIGINT) AS origin, CAST((s_suppkey * 13 + 7) % n AS BIGINT) AS dest
  FROM supplier, part_count)
"""
WEIGHTS_SQL = """
weights AS (SELECT node_from, node_to, length_m + CAST('0.' || node_from || node_to AS DOUBLE) AS w FROM road)
"""
# The recursion keeps one row per request and node and stops when nothing improves.
SEARCH_SQL = """
labels(request_id, node, cost) USING KEY (request_id, node) AS (
  SELECT request_id, origin, 0.0::DOUBLE FROM requests
  UNION
  SELECT d.request_id, e.node_to, min(d.cost + e.w)
  FROM labels d JOIN weights e ON e.node_from = d.node
  LEFT JOIN recurring.labels r ON r.request_id = d.request_id AND r.node = e.node_to
  WHERE d.cost + e.w < coalesce(r.cost, 'infinity'::DOUBLE)
  GROUP BY d.request_id, e.node_to)
"""


@query(
    "distances_from_hub_g1",
    i.sql_with(i.ROAD_SQL, WEIGHTS_SQL, "requests AS (SELECT CAST(0 AS BIGINT) AS request_id, CAST(0 AS BIGINT) AS origin)", SEARCH_SQL)
    + "SELECT request_id, node, round(cost, 3) AS cost FROM labels",
)
def distances_from_hub(spark, folder):
    hub = i.table(spark, folder, "part").agg(F.min("p_partkey").cast("bigint").alias("origin")).select(
        F.lit(0).cast("bigint").alias("request_id"), "origin"
    )
    return routing.distances(lengths(spark, folder), hub).withColumn("cost", F.round("cost", 3))


@query(
    "shortest_paths_g1",
    i.sql_with(i.ROAD_SQL, WEIGHTS_SQL, REQUESTS_SQL, SEARCH_SQL)
    + "SELECT request_id, round(cost, 6) AS cost FROM labels JOIN requests USING (request_id) WHERE node = dest",
)
def shortest_paths(spark, folder):
    return routing.best_paths(lengths(spark, folder), requests(spark, folder)).select("request_id", F.round("cost", 6).alias("cost"))


@query(
    "fastest_paths_g1",
    i.sql_with(
        i.ROAD_SQL, i.RESTRICTIONS_SQL, CHANGES_SQL, STATE_SQL,
        """weights AS (SELECT node_from, node_to, CASE WHEN current_speed = 0 THEN 'infinity'::DOUBLE
           ELSE length_m / (current_speed / 3.6::DOUBLE) END AS w FROM state3)""",
        REQUESTS_SQL, SEARCH_SQL,
    )
    + "SELECT request_id, round(cost, 6) AS cost FROM labels JOIN requests USING (request_id) WHERE node = dest AND cost < 'infinity'::DOUBLE",
)
def fastest_paths(spark, folder):
    # A closed segment is on no path with a time, so it is not searched.
    edges = routing.weighted(state_after_updates(spark, folder), F.col("travel_time_s")).where(F.col("weight") < float("inf"))
    found = routing.best_paths(edges, requests(spark, folder))
    return found.select("request_id", F.round("cost", 6).alias("cost"))


def _as_text(paths):
    return paths.withColumns({"cost": F.round("cost", 6), "path": F.array_join(F.transform("path", lambda n: n.cast("string")), ",")})


@query(
    "k_shortest_streets_g2_g3_o4",
    i.sql_with(i.STREETS_SQL, """
weights AS (SELECT node_from, node_to, length_m + (node_from * 7919 + node_to * 104729) % 999983 / 1048576.0::DOUBLE AS w FROM streets WHERE node_to > node_from),
requests AS (SELECT CAST(s_suppkey AS BIGINT) AS request_id, CAST(s_suppkey AS BIGINT) AS origin, CAST(least(s_suppkey + 9, m - 1) AS BIGINT) AS dest FROM supplier, supplier_count),
ways(request_id, dest, node, cost, path) AS (
  SELECT request_id, dest, origin, 0.0::DOUBLE, [origin] FROM requests
  UNION ALL
  SELECT request_id, dest, e.node_to, cost + w, list_append(path, e.node_to) FROM ways JOIN weights e ON e.node_from = node WHERE node <> dest AND e.node_to <= dest),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cost, path) AS rank FROM ways WHERE node = dest)""")
    + "SELECT request_id, CAST(rank AS INTEGER) AS rank, round(cost, 6) AS cost, array_to_string(path, ',') AS path FROM ranked WHERE rank <= 4",
)
def k_shortest_streets(spark, folder):
    """Over the streets that lead to a larger node, where all paths can be enumerated."""
    m = i.table(spark, folder, "supplier").count()
    k = F.col("s_suppkey")
    asked = i.table(spark, folder, "supplier").select(
        k.cast("bigint").alias("request_id"), k.cast("bigint").alias("origin"), F.least(k + 9, F.lit(m - 1)).cast("bigint").alias("dest"))
    onwards = i.streets(spark, folder).where("node_to > node_from")
    # Fractions with a finite binary form: sums are exact, so engines agree on the order.
    fraction = (F.col("node_from") * 7919 + F.col("node_to") * 104729) % 999983 / 1048576
    edges = routing.weighted(onwards, F.col("length_m") + fraction)
    return _as_text(routing.k_best_paths(edges, asked, 4))


@query("k_shortest_paths_g2_g3_o4")
def k_shortest_paths(spark, folder):
    return routing.k_best_paths(lengths(spark, folder), requests(spark, folder), 3)


# Both trees with the node before, maximal shared chains, and the routes through them.
_PLATEAU_SQL = """
ahead(request_id, node, cost, pred) USING KEY (request_id, node) AS (
  SELECT request_id, origin, 0.0::DOUBLE, NULL::BIGINT FROM requests
  UNION
  SELECT d.request_id, e.node_to, min(d.cost + e.w), arg_min(d.node, (d.cost + e.w, d.node))
  FROM ahead d JOIN weights e ON e.node_from = d.node
  LEFT JOIN recurring.ahead r ON r.request_id = d.request_id AND r.node = e.node_to
  WHERE d.cost + e.w < coalesce(r.cost, 'infinity'::DOUBLE) GROUP BY d.request_id, e.node_to),
behind(request_id, node, cost, pred) USING KEY (request_id, node) AS (
  SELECT request_id, dest, 0.0::DOUBLE, NULL::BIGINT FROM requests
  UNION
  SELECT d.request_id, e.node_from, min(d.cost + e.w), arg_min(d.node, (d.cost + e.w, d.node))
  FROM behind d JOIN weights e ON e.node_to = d.node
  LEFT JOIN recurring.behind r ON r.request_id = d.request_id AND r.node = e.node_from
  WHERE d.cost + e.w < coalesce(r.cost, 'infinity'::DOUBLE) GROUP BY d.request_id, e.node_from),
overlay AS (SELECT a.request_id, a.node, a.cost AS f, a.pred, b.cost AS b, b.pred AS next FROM ahead a JOIN behind b ON a.request_id = b.request_id AND a.node = b.node),
shared AS (SELECT v.request_id, v.pred AS u, v.node AS v FROM overlay v JOIN overlay u ON u.request_id = v.request_id AND u.node = v.pred AND u.next = v.node),
heads(request_id, node, head) AS (
  SELECT request_id, u, u FROM shared WHERE (request_id, u) NOT IN (SELECT (request_id, v) FROM shared)
  UNION ALL
  SELECT h.request_id, s.v, h.head FROM heads h JOIN shared s ON s.request_id = h.request_id AND s.u = h.node),
ends AS (SELECT * FROM heads WHERE node <> head AND (request_id, node) NOT IN (SELECT (request_id, u) FROM shared)),
there(request_id, node, path) AS (
  SELECT request_id, origin, [origin] FROM requests
  UNION ALL
  SELECT t.request_id, a.node, list_append(t.path, a.node) FROM there t JOIN ahead a ON a.request_id = t.request_id AND a.pred = t.node),
onwards(request_id, node, path) AS (
  SELECT request_id, dest, [dest] FROM requests
  UNION ALL
  SELECT t.request_id, a.node, list_prepend(a.node, t.path) FROM onwards t JOIN behind a ON a.request_id = t.request_id AND a.pred = t.node),
found AS (
  SELECT e.request_id, s.f + o.b AS off, o.f + o.b AS cost, list_concat(t.path, w.path[2:]) AS path
  FROM ends e JOIN overlay o ON o.request_id = e.request_id AND o.node = e.node JOIN overlay s ON s.request_id = e.request_id AND s.node = e.head
  JOIN there t ON t.request_id = e.request_id AND t.node = e.node JOIN onwards w ON w.request_id = e.request_id AND w.node = e.node),
single AS (SELECT request_id, path, min(off) AS off, min(cost) AS cost FROM found WHERE len(list_distinct(path)) = len(path) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(off, 9), round(cost, 9), path) AS rank FROM single)
"""


@query(
    "plateau_paths_g4",
    i.sql_with(i.ROAD_SQL, WEIGHTS_SQL, REQUESTS_SQL, _PLATEAU_SQL)
    + "SELECT request_id, CAST(rank AS INTEGER) AS rank, round(cost, 6) AS cost, array_to_string(path, ',') AS path FROM ranked WHERE rank <= 3",
)
def plateau_paths(spark, folder):
    return _as_text(routing.plateau_paths(lengths(spark, folder), requests(spark, folder), 3))


ROUTES_SQL = """
routes AS (SELECT id AS request_id, CASE WHEN id % 50 = 5 THEN list_append(osm_route, (dest_node + 7) % m) ELSE osm_route END AS path FROM vehicles, supplier_count),
links AS (SELECT request_id, path[j] AS node_from, path[j + 1] AS node_to
          FROM routes, LATERAL (SELECT unnest(range(1, len(path))) AS j)),
street_state AS (
  SELECT *, CASE WHEN (node_from + node_to) % 37 = 0 THEN 0 ELSE max_speed_kph END AS speed_kph FROM streets)
"""


def street_state(spark, folder):
    """Streets, some of them closed."""
    from roadflow.functions.scalars import travel_time

    speed = F.when((F.col("node_from") + F.col("node_to")) % 37 == 0, 0).otherwise(F.col("max_speed_kph"))
    return i.streets(spark, folder).withColumn("speed_kph", speed).withColumn(
        "travel_time_s", travel_time(F.col("length_m"), F.col("speed_kph"))
    )


def with_dead_ends(spark, folder):
    """Routes of which some end in a link that is no street."""
    m = i.table(spark, folder, "supplier").count()
    beyond = F.array(((F.col("dest_node") + 7) % m).cast("bigint"))
    return F.when(F.col("id") % 50 == 5, F.concat("osm_route", beyond)).otherwise(F.col("osm_route"))


@query(
    "route_times_a24_g6_p5",
    i.sql_with(i.STREETS_SQL, i.VEHICLES_SQL, ROUTES_SQL)
    + """
    , sums AS (
      SELECT request_id, bool_or(s.node_from IS NULL) AS missing, coalesce(bool_or(speed_kph = 0), false) AS closed,
             sum(CASE WHEN speed_kph > 0 THEN length_m / (speed_kph / 3.6::DOUBLE) END) AS t
      FROM links l LEFT JOIN street_state s USING (node_from, node_to) GROUP BY request_id)
    SELECT request_id, CASE WHEN missing THEN NULL WHEN closed THEN 'infinity'::DOUBLE ELSE round(t, 6) END AS travel_time_s, closed,
           CASE WHEN missing OR closed THEN -1 ELSE round(t, 6) END AS exchange_time_s FROM sums""",
)
def route_times(spark, folder):
    routes = i.vehicles(spark, folder).select(F.col("id").alias("request_id"), with_dead_ends(spark, folder).alias("path"))
    out = routing.route_times(routes, street_state(spark, folder))
    inf = float("inf")
    t = F.col("travel_time_s")
    return out.withColumns(
        {"travel_time_s": F.when(t == inf, t).otherwise(F.round(t, 6)), "exchange_time_s": F.round("exchange_time_s", 6)}
    )
