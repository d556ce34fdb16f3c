"""Queries of the rules that carry a fleet from one snapshot to the next."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow.catalog import inputs as i
from roadflow.catalog.registry import query
from roadflow.catalog.routing import ROUTES_SQL, street_state
from roadflow.catalog.vehicles import CLOCK_US, DUE, ROUND_US
from roadflow.operators import movement, vehicles
from roadflow.session import cut_lineage

TOLERANCE_US = 2000000


def snapshot_view(fleet):
    """The last record of each active vehicle, up to two seconds old."""
    return fleet.where("active").select(
        F.col("id").alias("vehicle_id"), vehicles.route_node(0).alias("node_from"), vehicles.route_node(1).alias("node_to"),
        (F.col("time_offset_us") - F.col("id") % 3 * 1000000).alias("timestamp"), F.col("start_distance_offset").alias("offset_m"),
    )


def snapshot_queue(fleet, streets):
    """Vehicles waiting at their segment end, odd numbers behind even ones."""
    here = vehicles.with_lengths(fleet.where("active"), streets)
    rank = (F.col("id") % 2 * 1000000000 + F.col("id")).alias("rank")
    return here.where(vehicles.at_segment_end()).select(
        vehicles.route_node(0).alias("node_from"), vehicles.route_node(1).alias("node_to"), F.col("id").alias("vehicle_id"),
        F.struct(F.lit(0).alias("step"), F.lit(0).alias("phase"), rank).alias("pos"),
    )


def settled(spark, folder):
    """The queues before the step, and the settled moves."""
    # Only active vehicles have a part in a step; due ones, queues and view are read from one table of them.
    streets, fleet = cut_lineage(i.streets(spark, folder)), cut_lineage(i.vehicles(spark, folder).where("active"))
    queue = cut_lineage(snapshot_queue(fleet, streets))
    return queue, movement.advance(
        vehicles.due(fleet, CLOCK_US, ROUND_US), queue, snapshot_view(fleet), streets, street_closures(streets), TOLERANCE_US)


def street_closures(streets):
    speed = F.when((F.col("node_from") + F.col("node_to")) % 37 == 0, 0).otherwise(F.col("max_speed_kph"))
    return streets.withColumn("speed_kph", speed)


STEP_SQL = f"""
s0 AS (
  SELECT v.*, a.node_from AS f0, a.node_to AS t0n, a.length_m AS length0, a.max_speed_kph AS limit0, a.lanes AS lanes0,
         b.node_from AS f1, b.node_to AS t1n, b.length_m AS length1, b.max_speed_kph AS limit1, b.lanes AS lanes1,
         coalesce((b.node_from + b.node_to) % 37 = 0, false) AS closed1, start_distance_offset = a.length_m AS at_end
  FROM vehicles v JOIN streets a ON a.node_from = osm_route[start_index + 1] AND a.node_to = osm_route[start_index + 2]
  LEFT JOIN streets b ON b.node_from = osm_route[start_index + 2] AND b.node_to = osm_route[start_index + 3]),
seen AS (SELECT id AS vid, f0 AS vf, t0n AS vt, time_offset_us - id % 3 * 1000000 AS ts, start_distance_offset AS off FROM s0 WHERE active),
queue AS (SELECT id AS qid, f0 AS qf, t0n AS qt, id % 2 * 1000000000 + id AS qpos FROM s0 WHERE active AND at_end),
due AS (
  SELECT *, at_end AND NOT closed1 AS enters, at_end AND closed1 AS blocked,
         CASE WHEN at_end AND NOT closed1 THEN f1 ELSE f0 END AS pf, CASE WHEN at_end AND NOT closed1 THEN t1n ELSE t0n END AS pt,
         CASE WHEN at_end AND NOT closed1 THEN 0 ELSE start_distance_offset END AS px FROM s0 WHERE {DUE}),
ahead AS (
  SELECT d.id, count(DISTINCT vid) AS n FROM due d LEFT JOIN seen ON vf = pf AND vt = pt AND vid <> id AND off > px
   AND ts BETWEEN time_offset_us - {TOLERANCE_US} AND time_offset_us + {TOLERANCE_US} WHERE NOT blocked GROUP BY d.id),
dens AS (
  SELECT d.*, n, n * 1609.344::DOUBLE / (greatest(200.0::DOUBLE, CASE WHEN enters THEN length1 ELSE length0 - px END)
              * CASE WHEN enters THEN lanes1 ELSE lanes0 END) AS x FROM due d LEFT JOIN ahead USING (id)),
los AS (
  SELECT *, CASE WHEN blocked OR x >= 67 THEN NULL WHEN x < 12 THEN 1.0::DOUBLE - x * 0.2::DOUBLE / 12 WHEN x < 20 THEN 0.8::DOUBLE - (x - 12) * 0.2::DOUBLE / 8
        WHEN x < 30 THEN 0.6::DOUBLE - (x - 20) * 0.2::DOUBLE / 10 WHEN x < 42 THEN 0.4::DOUBLE - (x - 30) * 0.2::DOUBLE / 12
        ELSE 0.2::DOUBLE - (x - 42) * 0.2::DOUBLE / 25 END AS l FROM dens),
spd AS (
  SELECT *, CASE WHEN l IS NULL THEN 0 ELSE CASE WHEN enters THEN limit1 ELSE limit0 END * l * (1000 / 3600.0::DOUBLE) END AS v, l IS NOT NULL AND enters AS changed FROM los),
mv AS (
  SELECT *, CASE WHEN changed THEN 0 ELSE start_distance_offset END AS s, CASE WHEN changed THEN length1 ELSE length0 END AS len FROM spd),
prop AS (
  SELECT *, CASE WHEN v = 0 THEN start_index ELSE start_index + CAST(changed AS INTEGER) END AS ei,
         CASE WHEN v = 0 THEN start_distance_offset WHEN s + 5 * v >= len - 2 THEN len ELSE s + 5 * v END AS em,
         CASE WHEN v > 0 AND s + 5 * v >= len - 2 THEN time_offset_us + CAST(round_even((len - s) / v * 1000000, 0) AS BIGINT) ELSE time_offset_us + 5000000 END AS eu
  FROM mv),
moved AS (SELECT *, ei <> start_index OR em <> start_distance_offset AS moved FROM prop),
cuts AS (SELECT qf, qt, min(qpos) FILTER (m.id IS NULL) AS fa, min(qpos) FILTER (NOT moved) AS fs FROM queue LEFT JOIN moved m ON m.id = qid GROUP BY qf, qt),
phased AS (
  SELECT m.*, CASE WHEN qpos IS NULL THEN 0 WHEN (fa IS NULL OR qpos < fa) AND (fs IS NULL OR qpos <= fs) THEN 1 ELSE 2 END AS phase
  FROM moved m LEFT JOIN queue q ON q.qid = m.id LEFT JOIN cuts c ON c.qf = q.qf AND c.qt = q.qt),
fin AS (
  SELECT *, phase <> 2 AND ei = 0 AND em = 0 AS silent, CASE WHEN phase = 2 OR (ei = 0 AND em = 0) THEN start_index ELSE ei END AS ni,
         CASE WHEN phase = 2 OR (ei = 0 AND em = 0) THEN start_distance_offset ELSE em END AS nm,
         CASE WHEN phase = 2 OR (ei = 0 AND em = 0) THEN time_offset_us + 5000000 ELSE eu END AS nu, CASE WHEN phase = 2 THEN 0 ELSE v END AS vv
  FROM phased),
settled AS (
  SELECT *, NOT (phase <> 2 AND NOT silent AND nm = CASE WHEN ni <> start_index THEN length1 ELSE length0 END AND osm_route[ni + 2] = dest_node) AS stays,
         phase <> 2 AND NOT silent AND at_end AND ni <> start_index AS leaves FROM fin),
joined AS (
  SELECT *, stays AND phase <> 2 AND NOT silent AND nm = CASE WHEN ni <> start_index THEN length1 ELSE length0 END
            AND (ni <> start_index OR nm <> start_distance_offset) AS joins FROM settled)
"""
BASE = i.sql_with(i.STREETS_SQL, i.VEHICLES_SQL, ROUTES_SQL, STEP_SQL)


@query(
    "step_outcome_v2_v3_v4_v5_v7",
    BASE
    + """SELECT id, CAST(phase AS INTEGER) AS phase, round(vv, 6) AS speed_mps, CAST(ni AS INTEGER) AS start_index, round(nm, 6) AS start_distance_offset,
      nu AS time_offset_us, stays AS active, leaves, joins, silent FROM joined""",
)
def step_outcome(spark, folder):
    return settled(spark, folder)[1].select(
        "id", "phase", F.round("speed_mps", 6).alias("speed_mps"), F.col("new_index").alias("start_index"),
        F.round("new_m", 6).alias("start_distance_offset"), F.col("new_us").alias("time_offset_us"),
        F.col("stays_active").alias("active"), "leaves", "joins", "silent",
    )


@query(
    "queue_split_j8_v8",
    BASE
    + """, kept AS (SELECT qf AS node_from, qt AS node_to, qid FROM queue WHERE qid NOT IN (SELECT id FROM joined WHERE leaves)
         UNION ALL SELECT osm_route[ni + 1], osm_route[ni + 2], id FROM joined WHERE joins)
      SELECT node_from, node_to, count(*) AS waiting, CAST(sum(qid) AS BIGINT) AS checksum FROM kept GROUP BY ALL""",
)
def queue_split(spark, folder):
    before, after = settled(spark, folder)
    order = F.struct(F.lit(1).alias("step"), "phase", F.col("vehicle_id").alias("rank"))
    arrivals = movement.arrivals_of(after).select("node_from", "node_to", "vehicle_id", order.alias("pos"))
    queue = movement.queue_after(before, after, arrivals)
    return queue.groupBy("node_from", "node_to").agg(F.count("*").alias("waiting"), F.sum("vehicle_id").alias("checksum"))


@query(
    "step_records_v6",
    BASE
    + """
    , g AS (
      SELECT *, CASE WHEN at_end AND ni <> start_index THEN length1 ELSE length0 END AS glen, CASE WHEN at_end AND ni <> start_index THEN 0 ELSE start_distance_offset END AS gs,
             at_end AND ni <> start_index AS onnext, vv * 2 AS stepm FROM joined WHERE NOT silent),
    h AS (SELECT *, greatest(0, least(ceil((nu - time_offset_us) / 2000000.0::DOUBLE) - 1,
            CASE WHEN stepm > 0 THEN ceil((glen - gs) / stepm) - 1 WHEN gs < glen THEN 1e9 ELSE 0 END)) AS extra FROM g),
    e AS (SELECT h.*, k FROM h, LATERAL (SELECT unnest(range(1, CAST(extra AS BIGINT) + 2)) AS k))
    SELECT id AS vehicle_id, CAST(k AS INTEGER) AS sample, CASE WHEN k > extra THEN nu ELSE time_offset_us + k * 2000000 END AS timestamp,
           CASE WHEN onnext THEN f1 ELSE f0 END AS node_from, CASE WHEN onnext THEN t1n ELSE t0n END AS node_to, CAST(glen AS INTEGER) AS segment_length,
           round(CASE WHEN k > extra THEN nm ELSE gs + k * stepm END, 6) AS offset_m, round(vv, 6) AS speed_mps, CASE WHEN k > extra THEN stays ELSE true END AS active
    FROM e""",
)
def step_records(spark, folder):
    return movement.records(settled(spark, folder)[1]).select(
        "vehicle_id", "sample", "timestamp", "node_from", "node_to", "segment_length",
        F.round("offset_m", 6).alias("offset_m"), F.round("speed_mps", 6).alias("speed_mps"), "active",
    )
