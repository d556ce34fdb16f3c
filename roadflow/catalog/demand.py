"""Queries of the demand preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow.catalog import inputs as i
from roadflow.catalog.registry import query
from roadflow.operators import demand, positions
from roadflow.functions import scalars as s

_BOX = "'POLYGON((' || {x} || ' ' || {y} || ',' || {x} || ' ' || ({y} + 1) || ',' || ({x} + 2) || ' ' || ({y} + 1) || ',' || ({x} + 2) || ' ' || {y} || '))'"


def _polygon(x, y):
    return _BOX.format(x=f"({x})", y=f"({y})")


FLOW_COLUMNS = f"""
  CAST(s_suppkey AS BIGINT) AS id_flow, s_suppkey % 7 AS count_devices,
  '2021-06-16 ' || lpad(CAST(s_suppkey % 24 AS {{text}}), 2, '0') || ':00:00+02' AS start_time,
  '2021-06-16 ' || lpad(CAST(s_suppkey % 24 AS {{text}}), 2, '0') || ':15:00+02' AS end_time,
  {_polygon('s_suppkey % 90', 's_nationkey')} AS geom_rectangle_from,
  {_polygon('-3 - s_suppkey % 80', 's_nationkey + 10')} AS geom_rectangle_to
"""


def flows(spark, folder):
    return i.table(spark, folder, "supplier").selectExpr(
        *[c for c in _split_columns(FLOW_COLUMNS.format(text="string"))]
    ).withColumn("count_devices", F.col("count_devices").cast("bigint"))


def _split_columns(text):
    """Split a SELECT list at its top-level commas."""
    out, depth, quoted, start = [], 0, False, 0
    for n, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                out.append(text[start:n].strip())
                start = n + 1
    return [*out, text[start:].strip()]


def _draw(n, low, high):
    chance = f"('0x' || substr(md5('0:{n}:' || id_flow || ':' || device), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"
    return f"({low}) + (({high}) - ({low})) * ({chance})"


FLOWS_SQL = f"""
devices AS (
  SELECT CAST(s_suppkey AS BIGINT) AS id_flow, d AS device, s_suppkey AS k, s_nationkey AS c,
         epoch(TIMESTAMP '2021-06-15 22:00:00') + (s_suppkey % 24) * 3600 AS t0
  FROM supplier, LATERAL (SELECT unnest(range(0, CAST(s_suppkey % 7 AS BIGINT))) AS d)),
drawn AS (
  SELECT id_flow, device, {_draw(1, 'c', 'c + 1')} AS lat_from, {_draw(2, 'k % 90', 'k % 90 + 2')} AS lon_from,
         {_draw(3, 'c + 10', 'c + 11')} AS lat_to, {_draw(4, '-3 - k % 80', '-1 - k % 80')} AS lon_to,
         {_draw(5, 't0', 't0 + 900')} AS t
  FROM devices),
od AS (
  SELECT row_number() OVER (ORDER BY t, id_flow, device) - 1 AS id, lat_from, lon_from, lat_to, lon_to,
         CAST(floor(t - min(t) OVER ()) AS BIGINT) AS start_offset_s FROM drawn)
"""


@query(
    "flow_bounds_f18_f19_f17",
    """SELECT CAST(s_suppkey AS BIGINT) AS id_flow, CAST(s_suppkey % 90 AS DOUBLE) AS min_x, CAST(s_nationkey AS DOUBLE) AS min_y,
       CAST(s_suppkey % 90 + 2 AS DOUBLE) AS max_x, CAST(s_nationkey + 1 AS DOUBLE) AS max_y, s_suppkey % 90 + 1.0::DOUBLE AS centre_x,
       CAST(epoch(TIMESTAMP '2021-06-15 22:00:00') + (s_suppkey % 24) * 3600 AS BIGINT) AS starts FROM supplier""",
)
def flow_bounds(spark, folder):
    b = s.wkt_bounds(F.col("geom_rectangle_from"))
    return flows(spark, folder).withColumn("b", b).select(
        "id_flow", "b.*", s.box_centre(F.col("b"))["x"].alias("centre_x"), F.unix_seconds(s.zoned_time(F.col("start_time"))).alias("starts")
    )


@query(
    "od_from_flows_s24_o7",
    i.sql_with(FLOWS_SQL)
    + """SELECT id, round(lat_from, 9) AS lat_from, round(lon_from, 9) AS lon_from, round(lat_to, 9) AS lat_to, round(lon_to, 9) AS lon_to,
      start_offset_s, CAST(20 AS BIGINT) AS route_step_s, CAST(5 AS BIGINT) AS log_step_s FROM od""",
)
def od_from_flows(spark, folder):
    out = demand.od_from_flows(flows(spark, folder))
    return out.withColumns({c: F.round(c, 9) for c in ("lat_from", "lon_from", "lat_to", "lon_to")})


def matrices(spark, folder):
    """OD rows of five named matrices from customer."""
    k = F.col("c_custkey")
    return i.table(spark, folder, "customer").select(
        F.concat(F.lit("od"), (k % 5).cast("string"), F.lit(".csv")).alias("path"), k.cast("bigint").alias("row"),
        (F.lit(50.0) + (k * 37 % 1000) / 8192).alias("lat_from"), (F.lit(14.0) + (k * 91 % 1000) / 8192).alias("lon_from"),
        (F.lit(50.0) + (k * 53 % 1000) / 8192).alias("lat_to"), (F.lit(14.0) + (k * 71 % 1000) / 8192).alias("lon_to"),
        (k % 600).cast("bigint").alias("start_offset_s"),
    )


def rules(spark, folder):
    n = F.col("n_nationkey")
    clock = F.concat((n % 24).cast("string"), F.lit(":"), F.lpad((n * 7 % 60).cast("string"), 2, "0"), F.lit(":00"))
    return i.table(spark, folder, "nation").select(
        n.cast("bigint").alias("rule"), clock.alias("timestamp"), (n % 2).alias("swap"),
        F.concat(F.lit("od"), (n % 5).cast("string"), F.lit(".csv")).alias("path"),
    )


MATRICES_SQL = """
matrices AS (
  SELECT 'od' || (c_custkey % 5) || '.csv' AS path, CAST(c_custkey AS BIGINT) AS row,
         50.0::DOUBLE + (c_custkey * 37 % 1000) / 8192.0::DOUBLE AS lat_from, 14.0::DOUBLE + (c_custkey * 91 % 1000) / 8192.0::DOUBLE AS lon_from,
         50.0::DOUBLE + (c_custkey * 53 % 1000) / 8192.0::DOUBLE AS lat_to, 14.0::DOUBLE + (c_custkey * 71 % 1000) / 8192.0::DOUBLE AS lon_to,
         CAST(c_custkey % 600 AS BIGINT) AS start_offset_s FROM customer),
combined AS (
  SELECT CAST(n_nationkey AS BIGINT) AS rule, row, CASE WHEN n_nationkey % 2 = 1 THEN lat_to ELSE lat_from END AS lat_from,
         CASE WHEN n_nationkey % 2 = 1 THEN lon_to ELSE lon_from END AS lon_from,
         CASE WHEN n_nationkey % 2 = 1 THEN lat_from ELSE lat_to END AS lat_to, CASE WHEN n_nationkey % 2 = 1 THEN lon_from ELSE lon_to END AS lon_to,
         CAST(start_offset_s + n_nationkey % 24 * 3600 + n_nationkey * 7 % 60 * 60 AS BIGINT) AS start_offset_s
  FROM nation JOIN matrices ON path = 'od' || (n_nationkey % 5) || '.csv')
"""


@query(
    "combine_od_u1_j13_p14_f20",
    i.sql_with(MATRICES_SQL) + "SELECT row_number() OVER (ORDER BY rule, row) AS id, * EXCLUDE (rule, row) FROM combined",
)
def combine_od(spark, folder):
    return demand.combine(rules(spark, folder), matrices(spark, folder))


@query(
    "bounding_box_a21",
    i.sql_with(MATRICES_SQL)
    + """
    , b AS (SELECT min(least(lat_from, lat_to)) AS s, max(greatest(lat_from, lat_to)) AS n, min(least(lon_from, lon_to)) AS w, max(greatest(lon_from, lon_to)) AS e FROM combined)
    SELECT least(n + (n - s) * 0.25, 90) AS north, greatest(w - (e - w) * 0.5, -180) AS west,
           greatest(s - (n - s) * 0.25, -90) AS south, least(e + (e - w) * 0.5, 180) AS east FROM b""",
)
def bounding_box(spark, folder):
    return demand.bounding_box(matrices(spark, folder), 0.25, 0.5)


@query(
    "vehicle_status_p6",
    """SELECT o_orderkey, o_orderkey % 7 <> 0 AND o_custkey % 5 >= 2 AS active,
       CASE WHEN o_orderkey % 7 = 0 THEN 'same origin and destination' WHEN o_custkey % 5 < 2 THEN 'no route between origin and destination' ELSE 'not started' END AS status FROM orders""",
)
def vehicle_status(spark, folder):
    c = (F.col("o_custkey") % 5).cast("int")
    route = F.when(c > 0, F.sequence(F.lit(1), c))
    active, status = demand.vehicle_status(F.lit(0), (F.col("o_orderkey") % 7).cast("int"), route)
    return i.table(spark, folder, "orders").select("o_orderkey", active.alias("active"), status.alias("status"))


def map_nodes(spark, folder):
    """Nodes from part, and a twin a billionth of a degree beside each."""
    p = F.col("p_partkey")
    nodes = i.table(spark, folder, "part").select(
        p.cast("bigint").alias("node_id"), (F.lit(14.0) + (p * 617 % 1009) / 8192).alias("lon"), (F.lit(50.0) + (p * 433 % 997) / 8192).alias("lat")
    )
    return nodes.union(nodes.select(F.col("node_id") + 10**9, F.col("lon") + 1e-9, F.col("lat") - 1e-9))


NODES_SQL = """
part_nodes AS (SELECT CAST(p_partkey AS BIGINT) AS node_id, 14.0::DOUBLE + (p_partkey * 617 % 1009) / 8192.0::DOUBLE AS lon,
                      50.0::DOUBLE + (p_partkey * 433 % 997) / 8192.0::DOUBLE AS lat FROM part),
nodes AS (SELECT * FROM part_nodes UNION ALL SELECT node_id + 1000000000, lon + 1e-9::DOUBLE, lat - 1e-9::DOUBLE FROM part_nodes)
"""


@query(
    "nearest_nodes_j12",
    i.sql_with(MATRICES_SQL, NODES_SQL)
    + """
    , ends AS (SELECT row * 2 AS point_id, lon_from AS x, lat_from AS y FROM matrices
               UNION ALL SELECT row * 2 + 1, lon_to, lat_to FROM matrices)
    SELECT point_id, arg_min(node_id, (sin(radians(lat - y) / 2) ** 2
             + cos(radians(y)) * cos(radians(lat)) * sin(radians(lon - x) / 2) ** 2, node_id)) AS node_id
    FROM ends, nodes GROUP BY point_id""",
)
def nearest(spark, folder):
    row = F.col("row")
    points = matrices(spark, folder).select(F.explode(F.array(
        F.struct((row * 2).alias("point_id"), F.col("lon_from").alias("lon"), F.col("lat_from").alias("lat")),
        F.struct((row * 2 + 1).alias("point_id"), F.col("lon_to").alias("lon"), F.col("lat_to").alias("lat")),
    )).alias("p")).select("p.*")
    return positions.nearest_nodes(points, map_nodes(spark, folder))
