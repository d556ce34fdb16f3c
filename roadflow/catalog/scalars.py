"""Queries of the scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow.catalog import inputs as i
from roadflow.catalog.registry import query
from roadflow.functions import scalars as s
from roadflow.operators import positions


@query(
    "speed_and_length_rules_f1_f2_f3_f4_f5",
    i.sql_with(i.ROAD_SQL)
    + """
    SELECT node_from, node_to, round(max_speed_kph * (1000 / 3600.0::DOUBLE), 9) AS speed_mps,
           round(max_speed_kph / 3.6::DOUBLE * 3.6, 9) AS speed_kph,
           CAST(floor(length_m / 7.0::DOUBLE + 0.5) AS INTEGER) AS rounded,
           round(length_m + CAST('0.' || node_from || node_to AS DOUBLE), 9) AS weight,
           'OSM' || node_from || 'T' || node_to AS label,
           CASE WHEN max_speed_kph % 10 = 0 THEN 'infinity'::DOUBLE
                ELSE round(length_m / (max_speed_kph / 3.6::DOUBLE), 9) END AS travel_time_s
    FROM road""",
)
def speed_and_length_rules(spark, folder):
    length, limit = F.col("length_m"), F.col("max_speed_kph")
    closed = F.when(limit % 10 == 0, 0).otherwise(limit)
    return i.road(spark, folder).select(
        "node_from", "node_to",
        F.round(s.kph_to_mps(limit), 9).alias("speed_mps"),
        F.round(s.mps_to_kph(limit / 3.6), 9).alias("speed_kph"),
        s.round_speed(length / 7).alias("rounded"),
        F.round(s.segment_weight(length, F.col("node_from"), F.col("node_to")), 9).alias("weight"),
        s.segment_label(F.col("node_from"), F.col("node_to")).alias("label"),
        F.when(closed == 0, s.travel_time(length, closed)).otherwise(F.round(s.travel_time(length, closed), 9)).alias("travel_time_s"),
    )


@query(
    "route_labels_f4_w12",
    i.sql_with(i.STREETS_SQL, i.VEHICLES_SQL)
    + """
    , twice AS (SELECT id, flatten([[x, x] FOR x IN osm_route]) AS r FROM vehicles),
    once AS (SELECT id, [r[j] FOR j IN range(1, len(r) + 1) IF j = 1 OR r[j] <> r[j - 1]] AS r FROM twice)
    SELECT id, array_to_string(r, ',') AS nodes,
           array_to_string(['OSM' || r[j] || 'T' || r[j + 1] FOR j IN range(1, len(r))], ',') AS segments FROM once""",
)
def route_labels(spark, folder):
    doubled = F.flatten(F.transform("osm_route", lambda x: F.array(x, x)))
    return i.vehicles(spark, folder).withColumn("r", s.drop_repeats(doubled)).select(
        "id",
        F.array_join(F.transform("r", lambda x: x.cast("string")), ",").alias("nodes"),
        F.array_join(s.route_segment_labels(F.col("r")), ",").alias("segments"),
    )


@query(
    "clock_rounding_p2_f6_f7_f9_f12",
    """
    SELECT event_id, date_trunc('minute', ts)
             + to_microseconds(CAST(round_even(epoch_us(ts) % 60000000 / 20000000.0, 0) * 20000000 AS BIGINT)) AS snapped_20s,
           date_trunc('hour', ts)
             + to_microseconds(CAST(round_even(epoch_us(ts) % 3600000000 / 300000000.0, 0) * 300000000 AS BIGINT)) AS snapped_5m,
           CAST(round_even(epoch_us(ts) % 86400000000 / 5000000.0::DOUBLE, 0) * 5000000 AS BIGINT) AS offset_us,
           epoch_us(ts) / 1000000.0::DOUBLE AS epoch_s,
           CAST(round_even((epoch_us(ts) // 1000000 * 1000) / (1000 * 2.5::DOUBLE), 0) AS BIGINT) AS report_frame,
           (epoch_us(ts) // 1000000 + 7 // 2) // 7 AS centred_frame,
           ((epoch_us(date_trunc('second', ts)) - epoch_us(date_trunc('week', ts)) + user_id * 10000000000) % 604800000000)
             / 1000.0::DOUBLE AS week_ms
    FROM events""",
)
def clock_rounding(spark, folder):
    ts = F.col("ts")
    seconds = F.expr(f"timestampdiff(SECOND, {i.EPOCH}, ts)")
    day_us = F.timestamp_diff("MICROSECOND", F.date_trunc("DAY", ts).cast("timestamp_ntz"), ts)
    return i.table(spark, folder, "events").select(
        "event_id",
        s.round_datetime(ts, 20).alias("snapped_20s"),
        s.round_datetime(ts, 300).alias("snapped_5m"),
        s.round_to_step(day_us, 5000000).alias("offset_us"),
        s.epoch_seconds(ts).alias("epoch_s"),
        s.report_frame(seconds, 2.5, 1).alias("report_frame"),
        s.centred_frame(seconds, 7).alias("centred_frame"),
        s.week_offset_ms(ts, F.col("user_id") * 10000000000).alias("week_ms"),
    )


@query(
    "interval_slices_p9_v14",
    i.sql_with(i.FCD_SQL)
    + """SELECT (timestamp - (SELECT min(timestamp) FROM fcd)) // 5400 AS slice, count(*) AS records,
      count(DISTINCT vehicle_id) AS vehicles FROM fcd GROUP BY ALL""",
)
def interval_slices(spark, folder):
    records = i.fcd(spark, folder, False)
    start = records.agg(F.min("timestamp").alias("t")).first().t
    return records.withColumn("slice", F.floor((F.col("timestamp") - start) / 5400)).groupBy("slice").agg(
        F.count("*").alias("records"), F.count_distinct("vehicle_id").alias("vehicles")
    )


@query(
    "edge_tags_f14_f15_f16_s13",
    """
    WITH t AS (SELECT p_partkey, p_size, p_retailprice,
        CASE p_size % 4 WHEN 0 THEN [CAST(p_size % 7 AS VARCHAR), '2', 'many'] WHEN 1 THEN ['x'] WHEN 2 THEN [CAST(p_size % 9 AS VARCHAR)] ELSE [] END AS tags,
        CASE WHEN p_size % 3 = 0 THEN 'max ' || p_size || ' km/h' ELSE 'none' END AS speed_tag FROM part),
    l AS (SELECT *, coalesce(list_max([CAST(x AS INTEGER) FOR x IN tags IF regexp_full_match(x, '[0-9]+')]), 1) AS n FROM t)
    SELECT p_partkey, greatest(CASE WHEN p_size % 2 = 0 AND n > 1 THEN (n + 1) // 2 ELSE n END, 1) AS lanes,
           coalesce(TRY_CAST(tags[1] AS DOUBLE), -1.0) AS max_speed, coalesce(tags[1], 'unknown') AS highway,
           CASE WHEN p_size % 5 = 0 THEN CAST(p_size AS INTEGER)
                ELSE coalesce(CAST(nullif(regexp_extract(speed_tag, '([0-9]+)', 1), '') AS INTEGER), 50) END AS speed,
           CAST(round_even(p_retailprice / 64 * 1000000, 0) AS INTEGER) AS coord FROM l""",
)
def edge_tags(spark, folder):
    size = F.col("p_size")
    tags = (
        F.when(size % 4 == 0, F.array((size % 7).cast("string"), F.lit("2"), F.lit("many")))
        .when(size % 4 == 1, F.array(F.lit("x"))).when(size % 4 == 2, F.array((size % 9).cast("string")))
        .otherwise(F.array().cast("array<string>"))
    )
    speed_tag = F.when(size % 3 == 0, F.concat(F.lit("max "), size.cast("string"), F.lit(" km/h"))).otherwise("none")
    return i.table(spark, folder, "part").withColumn("tags", tags).select(
        "p_partkey",
        s.lanes_per_direction(F.col("tags"), size % 2 != 0).alias("lanes"),
        s.first_speed(F.col("tags")).alias("max_speed"),
        s.first_class(F.col("tags")).alias("highway"),
        s.speed_or_default(F.when(size % 5 == 0, size), F.lit(None), speed_tag).alias("speed"),
        s.coord_to_int(F.col("p_retailprice") / 64).alias("coord"),
    )


_RANKED = ", ".join(f"('{c}', {n})" for n, c in enumerate(s.HIGHWAY_RANK))


@query(
    "highway_order_o9",
    f"""
    WITH ranks(c, r) AS (VALUES {_RANKED}),
    t AS (SELECT p_partkey, [p_partkey % 40, (p_partkey * 7 + 3) % 40, (p_partkey * 11 + 5) % 40] AS q FROM part),
    u AS (SELECT p_partkey, unnest(q) AS r FROM t)
    SELECT p_partkey, string_agg(c, ',' ORDER BY r) AS classes FROM u JOIN ranks USING (r) GROUP BY p_partkey""",
)
def highway_order(spark, folder):
    names = F.array(*[F.lit(c) for c in s.HIGHWAY_RANK])
    p = F.col("p_partkey")
    picks = F.array(p % 40, (p * 7 + 3) % 40, (p * 11 + 5) % 40)
    tags = F.transform(picks, lambda k: F.element_at(names, (k + 1).cast("int")))
    return i.table(spark, folder, "part").select("p_partkey", F.array_join(s.sort_classes(tags), ",").alias("classes"))


@query(
    "map_classes_p15_p16_f24_f25_f27",
    """
    SELECT p_partkey, CASE WHEN p_size % 10 <= 2 THEN 'motorway|trunk|primary' WHEN p_size % 10 <= 6 THEN 'motorway|trunk|primary|secondary' END AS road_filter,
      CASE WHEN w > 320000 THEN 'one' WHEN w > 161000 THEN 'two' WHEN w > 40000 THEN 'three' WHEN w > 0 THEN 'four' END AS zoom,
      CASE WHEN p_size < 20 THEN 'red' WHEN p_size < 40 THEN 'orange' ELSE 'green' END AS colour,
      replace(concat_ws('-', CAST(p_size + 0.5 AS VARCHAR), CAST(-p_size - 0.25 AS VARCHAR), '1.0', '2.5'), '.', '_') AS box
    FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_size / 400.0::DOUBLE / 10 * 111 * 39370.0787::DOUBLE AS w FROM part)""",
)
def map_classes(spark, folder):
    size = F.col("p_size")
    return i.table(spark, folder, "part").select(
        "p_partkey",
        s.admin_road_filter(size % 10).alias("road_filter"),
        s.zoom_level(size / 400, F.lit(10)).alias("zoom"),
        s.speed_colour(size).alias("colour"),
        s.box_name(size + F.lit(0.5), -size - F.lit(0.25), F.lit(1.0), F.lit(2.5)).alias("box"),
    )


@query(
    "part_values_f22",
    i.sql_with(i.FCD_SQL)
    + """
    , v AS (SELECT seq, [speed_mps, start_offset_m::DOUBLE, 5.0::DOUBLE] AS a FROM fcd),
    p AS (SELECT seq, a, unnest(range(0, 5)) AS i FROM v),
    x AS (SELECT *, least(CAST(floor(i * 3 / 5.0::DOUBLE) AS INTEGER), 2) AS lo, i * 3 / 5.0::DOUBLE AS x FROM p)
    SELECT seq, i AS point, round(a[lo + 1] + (a[least(lo + 1, 2) + 1] - a[lo + 1]) * least(x - lo, 1), 6) AS value FROM x""",
)
def part_values(spark, folder):
    values = F.array("speed_mps", F.col("start_offset_m").cast("double"), F.lit(5.0))
    spread = i.fcd(spark, folder, False).select("seq", F.posexplode(s.interpolate_array(values, F.lit(5))).alias("p", "v"))
    return spread.select("seq", F.col("p").cast("bigint").alias("point"), F.round("v", 6).alias("value"))


_NODES_SQL = """
nodes AS (SELECT CAST(k AS BIGINT) AS node_id, 14.0::DOUBLE + k * 0.01 AS lon, 50.0::DOUBLE + (k * 7 % 10) * 0.005 AS lat
          FROM (SELECT DISTINCT node_from AS k FROM fcd UNION SELECT DISTINCT node_to FROM fcd))
"""


def fcd_nodes(spark, folder):
    records = i.fcd(spark, folder, False)
    ids = records.select(F.col("node_from").alias("node_id")).union(records.select("node_to")).distinct()
    k = F.col("node_id")
    return ids.select("node_id", (F.lit(14.0) + k * 0.01).alias("lon"), (F.lit(50.0) + (k * 7 % 10) * 0.005).alias("lat"))


@query(
    "gps_points_f21_j6_s29",
    i.sql_with(i.FCD_SQL, _NODES_SQL)
    + """
    , day AS (SELECT arg_min(timestamp, seq) // 86400 AS d FROM fcd),
    pos AS (SELECT f.*, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2, start_offset_m / segment_length::DOUBLE AS w
            FROM fcd f, day JOIN nodes a ON a.node_id = node_from JOIN nodes b ON b.node_id = node_to
            WHERE timestamp // 86400 = d)
    SELECT seq, CAST(timestamp % 86400 AS DOUBLE) AS seconds,
           round(CASE WHEN node_from = 3 AND w < 0.5 THEN y1 + (0.2 + y1 - y1) * w * 2 WHEN node_from = 3 THEN y1 + 0.2 - 0.2 * (w * 2 - 1) ELSE y1 + (y2 - y1) * w END, 9) AS st_y,
           round(CASE WHEN node_from = 3 THEN x1 ELSE x1 + (x2 - x1) * w END, 9) AS st_x, CAST(0 AS INTEGER) AS direction,
           round_even(speed_mps * 3.6, 2) AS speed, vehicle_id FROM pos""".replace(
        "FROM fcd f, day JOIN nodes a", "FROM fcd f JOIN day ON timestamp // 86400 = d JOIN nodes a"
    ).replace("WHERE timestamp // 86400 = d)", ")"),
)
def gps_points(spark, folder):
    records = i.fcd(spark, folder, False)
    nodes = fcd_nodes(spark, folder)
    # Segments from node 3 have a drawn line: 0.2 degrees north and back; all others are straight.
    x, y = F.col("lon"), F.col("lat")
    corner = [F.struct(x.alias("x"), (y + dy).alias("y")) for dy in (0.0, 0.2, 0.0)]
    ends = records.where("node_from = 3").select("node_from", "node_to").distinct()
    lines = ends.join(nodes.withColumnRenamed("node_id", "node_from"), "node_from").select(
        "node_from", "node_to", F.array(*corner).alias("line")
    )
    out = positions.gps_points(records, nodes, lines)
    return out.withColumns({"st_x": F.round("st_x", 9), "st_y": F.round("st_y", 9)})
