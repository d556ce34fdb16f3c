"""Traffic-shaped views of the driver tables.

Every view is a deterministic integer formula over a whole table.  The
functions give the Spark side, the ``*_SQL`` strings the same view as common
table expressions for the SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.operators.ordering import time_order

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- floating-car data from events -----------------------------------------------------------

def fcd(spark: SparkSession, folder: str, with_active: bool = True) -> DataFrame:
    events = table(spark, folder, "events")
    base = (
        events.select(
            F.col("event_id").alias("seq"),
            F.expr(f"timestampdiff(SECOND, {EPOCH}, ts)").alias("timestamp"),
            F.col("user_id").alias("vehicle_id"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            (F.round(F.col("value") * 100).cast("bigint") % 3000).alias("cms"),
        )
        .withColumn("segment_length", (F.lit(100) + (F.col("k") * 7919) % 900).cast("int"))
        .select(
            "seq",
            "timestamp",
            F.floor(F.col("k") / 10).cast("bigint").alias("node_from"),
            (F.col("k") % 10).alias("node_to"),
            "segment_length",
            "vehicle_id",
            ((F.col("seq") * 37) % F.col("segment_length")).cast("float").alias("start_offset_m"),
            (F.col("cms") / 100.0).cast("double").alias("speed_mps"),
        )
    )
    if not with_active:
        return base
    ends = (
        base.where(F.col("vehicle_id") % 5 != 0)
        .groupBy("vehicle_id")
        .agg(F.max_by("seq", time_order()).alias("__end"))
    )
    return base.join(ends, "vehicle_id", "left").withColumn("active", ~F.coalesce(F.col("seq") == F.col("__end"), F.lit(False))).select(
        *base.columns, "active")


FCD_SQL = """
fcd_base AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000000 AS timestamp, user_id AS vehicle_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(round(value * 100) AS BIGINT) % 3000 AS cms
  FROM events),
fcd_cols AS (
  SELECT seq, timestamp, k // 10 AS node_from, k % 10 AS node_to,
         CAST(100 + (k * 7919) % 900 AS INTEGER) AS segment_length, vehicle_id,
         CAST((seq * 37) % (100 + (k * 7919) % 900) AS FLOAT) AS start_offset_m,
         cms / 100.0::DOUBLE AS speed_mps
  FROM fcd_base),
fcd AS (
  SELECT c.*, NOT (vehicle_id % 5 <> 0 AND row_number() OVER (
           PARTITION BY vehicle_id ORDER BY timestamp DESC, seq DESC) = 1) AS active
  FROM fcd_cols c)
"""


def fcd_segments(records: DataFrame) -> DataFrame:
    """Segments travelled in ``fcd`` with speed limit and lanes."""
    k = F.col("node_from") * 10 + F.col("node_to")
    return (
        records.groupBy("node_from", "node_to")
        .agg(F.max("segment_length").alias("length_m"))
        .withColumn("max_speed_kph", (F.lit(30) + 10 * (k % 7)).cast("int"))
        .withColumn("lanes", (F.lit(1) + k % 3).cast("int"))
    )


FCD_SEGMENTS_SQL = """
fcd_segments AS (
  SELECT node_from, node_to, max(segment_length) AS length_m,
         CAST(30 + 10 * ((node_from * 10 + node_to) % 7) AS INTEGER) AS max_speed_kph,
         CAST(1 + (node_from * 10 + node_to) % 3 AS INTEGER) AS lanes
  FROM fcd GROUP BY node_from, node_to)
"""


# --- routable road graph from part -----------------------------------------------------------

def road_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Parallel edges of the raw road graph: a ring plus chords."""
    part = table(spark, folder, "part")
    n = part.count()
    p = F.col("p_partkey")
    ends = F.array(
        F.struct(((p + 1) % n).alias("node_to"), F.lit(0).alias("edge_key")),
        F.struct(((p * 7 + F.col("p_size")) % n).alias("node_to"), F.lit(1).alias("edge_key")),
    )
    return part.select("*", F.explode(ends).alias("e")).select(
        p.cast("bigint").alias("node_from"),
        F.col("e.node_to").cast("bigint").alias("node_to"),
        F.col("e.edge_key").alias("edge_key"),
        (F.lit(20) * F.col("p_size")).cast("int").alias("length_m"),
        (F.lit(30) + F.col("p_size") % 60).cast("int").alias("max_speed_kph"),
        (F.lit(1) + F.col("p_size") % 3).cast("int").alias("lanes"),
    )


def road(spark: SparkSession, folder: str) -> DataFrame:
    """One edge per node pair (the shortest), no self loops."""
    best = F.min(F.struct("length_m", "max_speed_kph", "lanes")).alias("e")
    return (
        road_edges(spark, folder)
        .where("node_from <> node_to")
        .groupBy("node_from", "node_to")
        .agg(best)
        .select("node_from", "node_to", "e.*")
    )


ROAD_SQL = """
part_count AS (SELECT count(*) AS n FROM part),
road_edges AS (
  SELECT p_partkey AS node_from, (p_partkey + 1) % n AS node_to, 0 AS edge_key, p_size FROM part, part_count
  UNION ALL
  SELECT p_partkey, (p_partkey * 7 + p_size) % n, 1, p_size FROM part, part_count),
road AS (
  SELECT CAST(node_from AS BIGINT) AS node_from, CAST(node_to AS BIGINT) AS node_to,
         CAST(20 * min(p_size) AS INTEGER) AS length_m,
         CAST(30 + min(p_size) % 60 AS INTEGER) AS max_speed_kph,
         CAST(1 + min(p_size) % 3 AS INTEGER) AS lanes
  FROM road_edges WHERE node_from <> node_to GROUP BY node_from, node_to)
"""


def restrictions(spark: SparkSession, folder: str) -> DataFrame:
    """Temporary speeds: each part's chord carries a one-hour window."""
    part = table(spark, folder, "part")
    n = part.count()
    p = F.col("p_partkey")
    start = F.expr("timestampadd(HOUR, p_partkey % 24, TIMESTAMP_NTZ'2021-01-01 00:00:00')")
    return part.select(
        p.cast("bigint").alias("node_from"),
        ((p * 7 + F.col("p_size")) % n).cast("bigint").alias("node_to"),
        F.when(F.col("p_size") % 2 == 0, F.lit(0.0)).otherwise(F.lit(19.5)).alias("speed"),
        start.alias("timestamp_from"),
        F.expr("timestampadd(HOUR, p_partkey % 24 + 1, TIMESTAMP_NTZ'2021-01-01 00:00:00')").alias("timestamp_to"),
    ).where("node_from <> node_to")


RESTRICTIONS_SQL = """
restrictions AS (
  SELECT CAST(p_partkey AS BIGINT) AS node_from, CAST((p_partkey * 7 + p_size) % n AS BIGINT) AS node_to,
         CASE WHEN p_size % 2 = 0 THEN 0.0::DOUBLE ELSE 19.5::DOUBLE END AS speed,
         TIMESTAMP '2021-01-01 00:00:00' + to_hours(CAST(p_partkey % 24 AS INTEGER)) AS timestamp_from,
         TIMESTAMP '2021-01-01 00:00:00' + to_hours(CAST(p_partkey % 24 + 1 AS INTEGER)) AS timestamp_to
  FROM part, part_count WHERE p_partkey <> (p_partkey * 7 + p_size) % n)
"""


# --- a street ring with six strides per supplier, and vehicles from orders -------------------

def streets(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier")
    m = supplier.count()
    return (
        supplier.select(F.col("s_suppkey").cast("bigint").alias("node_from"),
                        F.explode(F.sequence(F.lit(1), F.lit(6))).alias("s"))
        .select(
            "node_from",
            ((F.col("node_from") + F.col("s")) % m).alias("node_to"),
            (F.lit(100) + (F.col("node_from") * 37 + F.col("s") * 211) % 900).cast("int").alias("length_m"),
            (F.lit(30) + 10 * ((F.col("node_from") + F.col("s")) % 7)).cast("int").alias("max_speed_kph"),
            (F.lit(1) + (F.col("node_from") + F.col("s")) % 3).cast("int").alias("lanes"),
        )
    )


STREETS_SQL = """
supplier_count AS (SELECT count(*) AS m FROM supplier),
streets AS (
  SELECT CAST(s_suppkey AS BIGINT) AS node_from, CAST((s_suppkey + s) % m AS BIGINT) AS node_to,
         CAST(100 + (s_suppkey * 37 + s * 211) % 900 AS INTEGER) AS length_m,
         CAST(30 + 10 * ((s_suppkey + s) % 7) AS INTEGER) AS max_speed_kph,
         CAST(1 + (s_suppkey + s) % 3 AS INTEGER) AS lanes
  FROM supplier, supplier_count, range(1, 7) AS r(s))
"""


def vehicles(spark: SparkSession, folder: str) -> DataFrame:
    """One vehicle per order in the middle of a 5..9 node route over ``streets``."""
    m = table(spark, folder, "supplier").count()
    o = F.col("o_orderkey")
    base = table(spark, folder, "orders").select(
        o.cast("bigint").alias("id"),
        (F.lit(5) + o % 5).cast("int").alias("n"),
        (F.lit(1) + o % 6).cast("bigint").alias("stride"),
        ((F.col("o_custkey") * 13 + o) % m).cast("bigint").alias("start"),
        F.floor(o / 7).cast("bigint").alias("h"),
        (F.col("o_orderstatus") != "P").alias("active"),
    )
    route = F.expr(f"transform(sequence(0, n - 1), j -> (start + j * stride) % {m})")
    position = (
        F.when(F.col("h") % 4 == 0, F.col("length_m").cast("double"))
        .when(F.col("h") % 4 == 1, F.lit(0.0))
        .when(F.col("h") % 4 == 2, ((F.col("id") * 31) % F.col("length_m")).cast("double"))
        .otherwise((F.col("length_m") - 10).cast("double"))
    )
    staged = (
        base.withColumn("osm_route", route)
        .withColumn("start_index", (F.col("h") % (F.col("n") - 2)).cast("int"))
        .withColumn("node_from", F.expr("osm_route[start_index]"))
        .withColumn("node_to", F.expr("osm_route[start_index + 1]"))
    )
    return staged.join(streets(spark, folder), ["node_from", "node_to"]).select(
        "id",
        ((F.lit(98) + F.col("id") % 6) * 1000000).alias("time_offset_us"),
        F.lit(5000000).cast("bigint").alias("frequency_us"),
        "start_index",
        position.alias("start_distance_offset"),
        F.expr("osm_route[0]").alias("origin_node"),
        F.expr("osm_route[n - 1]").alias("dest_node"),
        "osm_route",
        "active",
        F.lit(2000000).cast("bigint").alias("fcd_sampling_period_us"),
        F.lit("").alias("status"),
    )


VEHICLES_SQL = """
vehicle_base AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(5 + o_orderkey % 5 AS INTEGER) AS n, 1 + o_orderkey % 6 AS stride,
         (o_custkey * 13 + o_orderkey) % m AS start, o_orderkey // 7 AS h, m,
         o_orderstatus <> 'P' AS active
  FROM orders, supplier_count),
vehicle_route AS (
  SELECT *, CAST(h % (n - 2) AS INTEGER) AS start_index,
         [CAST((start + j * stride) % m AS BIGINT) FOR j IN range(0, n)] AS osm_route
  FROM vehicle_base),
vehicles AS (
  SELECT id, CAST((98 + id % 6) * 1000000 AS BIGINT) AS time_offset_us, CAST(5000000 AS BIGINT) AS frequency_us,
         start_index,
         CAST(CASE h % 4 WHEN 0 THEN length_m WHEN 1 THEN 0
              WHEN 2 THEN (id * 31) % length_m ELSE length_m - 10 END AS DOUBLE) AS start_distance_offset,
         osm_route[1] AS origin_node, osm_route[n] AS dest_node, osm_route, active,
         CAST(2000000 AS BIGINT) AS fcd_sampling_period_us, '' AS status
  FROM vehicle_route r JOIN streets s
    ON s.node_from = r.osm_route[r.start_index + 1] AND s.node_to = r.osm_route[r.start_index + 2])
"""


def sql_with(*parts: str) -> str:
    """Join CTE blocks into one WITH prefix."""
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts) + "\n"
