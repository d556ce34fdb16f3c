"""Queries of the frame aggregation and the filled report frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow.catalog import inputs as i
from roadflow.catalog.registry import query
from roadflow.operators import filling, frames
from roadflow.session import cut_lineage

DAY = 86400

FRAMED_SQL = f"""
framed AS (
  SELECT *, (timestamp + {DAY // 2}) // {DAY} AS frame_id, 2 * start_offset_m < segment_length AS in_first,
         row_number() OVER (PARTITION BY (timestamp + {DAY // 2}) // {DAY}, vehicle_id ORDER BY timestamp, seq) AS rn
  FROM fcd),
frame_rows AS (
  SELECT frame_id, node_from, node_to,
         round(coalesce(sum(speed_mps) FILTER (in_first), 0), 6) AS speed_sum_first,
         CAST(count(*) FILTER (in_first) AS INTEGER) AS speed_count_first,
         CAST(count(*) FILTER (in_first AND rn = 1) AS INTEGER) AS count_unique_first,
         round(coalesce(sum(speed_mps) FILTER (NOT in_first), 0), 6) AS speed_sum_second,
         CAST(count(*) FILTER (NOT in_first) AS INTEGER) AS speed_count_second,
         CAST(count(*) FILTER (NOT in_first AND rn = 1) AS INTEGER) AS count_unique_second,
         CAST(count(*) FILTER (NOT active) AS INTEGER) AS vehicles_finished
  FROM framed GROUP BY ALL),
deltas AS (
  SELECT frame_id,
         timestamp - coalesce(lag(timestamp) OVER w, min(timestamp) OVER ()) AS dt,
         start_offset_m::DOUBLE - CASE WHEN lag(node_from) OVER w = node_from AND lag(node_to) OVER w = node_to
                                  THEN lag(start_offset_m) OVER w ELSE 0 END AS dx
  FROM framed WINDOW w AS (PARTITION BY vehicle_id ORDER BY timestamp, seq)),
stats AS (SELECT frame_id, CAST(sum(dt) AS BIGINT) AS time_s, sum(dx) AS distance_m FROM deltas GROUP BY frame_id)
"""
BASE = i.sql_with(i.FCD_SQL, FRAMED_SQL)


def rows(spark, folder):
    return frames.frame_rows(i.fcd(spark, folder), DAY)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("frame_rows_a6_w4", BASE + "SELECT * FROM frame_rows")
def frame_rows(spark, folder):
    return rounded(rows(spark, folder), "speed_sum_first", "speed_sum_second")


@query(
    "frame_means_a11",
    BASE
    + """SELECT frame_id, node_from, node_to,
      round((speed_sum_first + speed_sum_second) / (speed_count_first + speed_count_second), 9) AS avg_speed_mps,
      count_unique_first + count_unique_second AS volume FROM frame_rows""",
)
def frame_means(spark, folder):
    return frames.mean_speeds(rows(spark, folder)).withColumn("avg_speed_mps", F.round("avg_speed_mps", 9))


@query(
    "drawing_rows_c12",
    BASE
    + """SELECT frame_id, node_from, node_to, count_unique_first AS density_first, count_unique_second AS density_second,
      CASE WHEN speed_count_first > 0 THEN round(speed_sum_first / speed_count_first, 9) ELSE -1 END AS speed_first,
      CASE WHEN speed_count_second > 0 THEN round(speed_sum_second / speed_count_second, 9) ELSE -1 END AS speed_second
      FROM frame_rows""",
)
def drawing_rows(spark, folder):
    return frames.drawing_rows(rows(spark, folder)).select(
        "frame_id", "node_from", "node_to",
        F.get("densities", F.lit(0)).alias("density_first"), F.get("densities", F.lit(1)).alias("density_second"),
        F.round(F.get("speeds", F.lit(0)), 9).alias("speed_first"),
        F.round(F.get("speeds", F.lit(1)), 9).alias("speed_second"),
    )


@query("added_stats_w8", BASE + "SELECT frame_id, time_s, round(distance_m, 3) AS distance_m FROM stats")
def added_stats(spark, folder):
    out = frames.added_stats(i.fcd(spark, folder, False), DAY)
    return out.withColumn("distance_m", F.round("distance_m", 3))


@query(
    "frame_index_a10_w5",
    BASE
    + """
    , per_frame AS (
      SELECT frame_id, count(*) AS n, sum(count_unique_first + count_unique_second) AS a, sum(vehicles_finished) AS f
      FROM frame_rows GROUP BY frame_id)
    SELECT frame_id, CAST(sum(n) OVER w - n AS BIGINT) AS start_index, CAST(sum(n) OVER w AS BIGINT) AS end_index,
           CAST(a AS BIGINT) AS active_vehicles, CAST(sum(f) OVER w AS BIGINT) AS vehicles_finished,
           CAST(sum(CAST(trunc(distance_m) AS BIGINT)) OVER w AS BIGINT) AS total_distance,
           CAST(sum(time_s) OVER w AS DOUBLE) AS total_time
    FROM per_frame JOIN stats USING (frame_id) WINDOW w AS (ORDER BY frame_id)""",
)
def frame_index(spark, folder):
    # Rows and statistics read one prepared table, not the raw events.
    records = cut_lineage(i.fcd(spark, folder))
    return frames.frame_index(frames.frame_rows(records, DAY), frames.added_stats(records, DAY))


@query(
    "run_summary_a9_a25",
    BASE
    + f"""
    , per_frame AS (SELECT frame_id, count(DISTINCT vehicle_id) AS seen FROM framed GROUP BY frame_id)
    SELECT (SELECT max(vehicle_id) FROM fcd) AS max_vehicle_id, (SELECT count(DISTINCT vehicle_id) FROM fcd) AS vehicles,
           (SELECT CAST(max(seen) AS BIGINT) FROM per_frame) AS max_unique_vehicles_in_time_segment,
           (SELECT max(greatest(count_unique_first, count_unique_second)) FROM frame_rows) AS max_unique_vehicles_on_segment,
           {DAY} AS interval_s""",
)
def run_summary(spark, folder):
    return frames.run_summary(i.fcd(spark, folder), rows(spark, folder), DAY)


@query(
    "time_range_s18",
    i.sql_with(i.FCD_SQL)
    + "SELECT min(timestamp) AS min_timestamp, max(timestamp) AS max_timestamp, count(*) AS records FROM fcd",
)
def time_range(spark, folder):
    return frames.time_range(i.fcd(spark, folder, False))


@query(
    "round_and_chunk_o1",
    i.sql_with(i.FCD_SQL)
    + """
    , w AS (SELECT greatest((max(timestamp) - min(timestamp)) // 100, 5) AS r FROM fcd)
    SELECT (timestamp + r // 2) // r AS frame_id, count(*) AS records FROM fcd, w GROUP BY ALL""",
)
def round_and_chunk(spark, folder):
    records = i.fcd(spark, folder, False)
    span = frames.time_range(records).first()
    width = frames.frame_interval(span.max_timestamp - span.min_timestamp, 100, 5)
    return frames.assign_frames(records, width).groupBy("frame_id").agg(F.count("*").alias("records"))


# --- report frames ----------------------------------------------------------------------------

PREPARED_SQL = f"""
stepped AS (
  SELECT *, CAST(round_even(timestamp * 1000 / (1000.0 * {DAY}), 0) AS BIGINT) AS frame,
         coalesce(start_offset_m::DOUBLE - lag(start_offset_m) OVER w
           + CASE WHEN lag(node_from) OVER w <> node_from OR lag(node_to) OVER w <> node_to
             THEN lag(segment_length) OVER w ELSE 0 END, 0) AS meters,
         row_number() OVER w AS nth
  FROM fcd WINDOW w AS (PARTITION BY vehicle_id ORDER BY timestamp, seq)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vehicle_id, frame ORDER BY timestamp, seq) AS up,
         row_number() OVER (PARTITION BY vehicle_id, frame ORDER BY timestamp DESC, seq DESC) AS down,
         min(nth) OVER (PARTITION BY vehicle_id, frame) = 1 AS opens,
         sum(meters) OVER (PARTITION BY vehicle_id, frame) AS meters_driven
  FROM stepped),
prepared AS (SELECT * FROM ranked WHERE CASE WHEN opens THEN up = 1 ELSE down = 1 END)
"""
PREPARED = i.sql_with(i.FCD_SQL, PREPARED_SQL)


def prepared(spark, folder, with_active=False):
    return filling.prepare(i.fcd(spark, folder, with_active), DAY, 1)


@query(
    "meters_driven_w1",
    PREPARED + "SELECT seq, vehicle_id, round(meters, 3) AS meters_driven, nth = 1 AS is_first FROM stepped",
)
def meters_driven(spark, folder):
    return filling.with_meters_driven(i.fcd(spark, folder, False)).select(
        "seq", "vehicle_id", F.round("meters_driven", 3).alias("meters_driven"), "is_first"
    )


@query(
    "one_row_per_frame_p8_w3",
    PREPARED
    + "SELECT vehicle_id, frame, seq, node_from, node_to, round(meters_driven, 3) AS meters_driven FROM prepared",
)
def one_row_per_frame(spark, folder):
    return prepared(spark, folder).select(
        "vehicle_id", "frame", "seq", "node_from", "node_to", F.round("meters_driven", 3).alias("meters_driven")
    )


FILLED_SQL = """
paired AS (
  SELECT p.*, lead(frame) OVER w AS f2, lead(timestamp) OVER w AS ts2, lead(node_from) OVER w AS from2,
         lead(node_to) OVER w AS to2, lead(segment_length) OVER w AS len2,
         lead(start_offset_m)::DOUBLE OVER w AS off2, lead(speed_mps) OVER w AS v2
  FROM prepared p WINDOW w AS (PARTITION BY vehicle_id ORDER BY frame)),
spread AS (
  SELECT p.*, i, f2 IS NOT NULL AND (from2 <> node_from OR to2 <> node_to) AS crosses,
         CASE WHEN f2 IS NULL THEN 0.0::DOUBLE ELSE i::DOUBLE / (f2 - frame) END AS w
  FROM paired p, LATERAL (SELECT unnest(range(0, coalesce(f2 - frame, 1))) AS i)),
placed AS (
  SELECT *, CASE WHEN f2 IS NULL THEN start_offset_m::DOUBLE ELSE start_offset_m::DOUBLE
              + (off2 + CASE WHEN crosses THEN segment_length ELSE 0 END - start_offset_m::DOUBLE) * w END AS o,
         CASE WHEN f2 IS NULL THEN speed_mps ELSE speed_mps + (v2 - speed_mps) * w END AS v
  FROM spread),
filled AS (
  SELECT vehicle_id, frame + i AS frame,
         CASE WHEN crosses AND o > segment_length THEN from2 ELSE node_from END AS node_from,
         CASE WHEN crosses AND o > segment_length THEN to2 ELSE node_to END AS node_to,
         CASE WHEN crosses AND o > segment_length THEN len2 ELSE segment_length END AS segment_length,
         CASE WHEN crosses AND o > segment_length THEN o - segment_length ELSE o END AS start_offset_m,
         v AS speed_mps
  FROM placed)
""".replace("lead(start_offset_m)::DOUBLE OVER w", "CAST(lead(start_offset_m) OVER w AS DOUBLE)")
FILLED = i.sql_with(i.FCD_SQL, PREPARED_SQL, FILLED_SQL)


@query(
    "filled_frames_f10_j14",
    FILLED
    + """SELECT vehicle_id, frame, node_from, node_to, segment_length, round(start_offset_m, 9) AS start_offset_m,
      round(speed_mps, 9) AS speed_mps FROM filled""",
)
def filled_frames(spark, folder):
    out = filling.fill_gaps(filling.with_next(prepared(spark, folder), 4))
    return out.withColumns({"start_offset_m": F.round("start_offset_m", 9), "speed_mps": F.round("speed_mps", 9)})


@query(
    "segment_parts_a12",
    FILLED
    + """
    , parted AS (SELECT *, least(CAST(floor(start_offset_m / (segment_length / 3.0::DOUBLE)) AS INTEGER), 2) AS part FROM filled),
    at_nodes AS (
      SELECT frame, CASE part WHEN 0 THEN node_from ELSE node_to END AS node, count(*) AS c
      FROM parted WHERE part <> 1 GROUP BY ALL),
    per_segment AS (
      SELECT frame, node_from, node_to, count(*) FILTER (part = 1) AS n1, avg(start_offset_m) AS mean_offset,
             avg(speed_mps) FILTER (part = 0) AS v0, avg(speed_mps) FILTER (part = 1) AS v1,
             avg(speed_mps) FILTER (part = 2) AS v2
      FROM parted GROUP BY ALL)
    SELECT s.frame, node_from, node_to, coalesce(a.c, 0) AS count_from, n1 AS count_inner, coalesce(b.c, 0) AS count_to,
           round(coalesce(v0, -1), 9) AS speed_0, round(coalesce(v1, -1), 9) AS speed_1, round(coalesce(v2, -1), 9) AS speed_2,
           CASE WHEN coalesce(a.c, 0) + n1 + coalesce(b.c, 0) > 5 THEN round(mean_offset, 9) END AS mean_offset
    FROM per_segment s LEFT JOIN at_nodes a ON a.frame = s.frame AND a.node = node_from
    LEFT JOIN at_nodes b ON b.frame = s.frame AND b.node = node_to""",
)
def segment_parts(spark, folder):
    out = filling.segment_parts(filling.fill_gaps(filling.with_next(prepared(spark, folder), 4)), 3)
    return out.select(
        "frame", "node_from", "node_to",
        *[F.get("counts", F.lit(k)).alias(n) for k, n in enumerate(["count_from", "count_inner", "count_to"])],
        *[F.round(F.get("speeds", F.lit(k)), 9).alias(f"speed_{k}") for k in range(3)],
        F.round("mean_offset", 9).alias("mean_offset"),
    )


@query(
    "active_per_frame_a13",
    PREPARED
    + """
    , dense AS (SELECT unnest(range(min(frame), max(frame) + 1)) AS frame FROM prepared)
    SELECT d.frame, count(vehicle_id) AS vehicles FROM dense d LEFT JOIN prepared p ON p.frame = d.frame GROUP BY d.frame""",
)
def active_per_frame(spark, folder):
    return filling.active_per_frame(prepared(spark, folder))


@query(
    "running_stats_w5",
    FILLED
    + """
    , unfinished AS (SELECT vehicle_id FROM fcd GROUP BY vehicle_id HAVING bool_and(active)),
    parts AS (
      SELECT frame, meters_driven AS m, 0 AS t, 0 AS f FROM prepared
      UNION ALL SELECT f2, 0, ts2 - timestamp, 0 FROM paired WHERE f2 IS NOT NULL
      UNION ALL SELECT frame, 0, 0, 1 FROM paired WHERE f2 IS NULL AND vehicle_id NOT IN (SELECT vehicle_id FROM unfinished)
      UNION ALL SELECT unnest(range(min(frame), max(frame) + 1)), 0, 0, 0 FROM prepared),
    sums AS (SELECT frame, sum(m) AS m, sum(t) AS t, sum(f) AS f FROM parts GROUP BY frame)
    SELECT frame, round(sum(m) OVER w, 3) AS meters_driven, CAST(sum(t) OVER w AS BIGINT) AS driving_time_s,
           CAST(sum(f) OVER w AS BIGINT) AS vehicles_finished FROM sums WINDOW w AS (ORDER BY frame)""",
)
def running_stats(spark, folder):
    records = i.fcd(spark, folder)
    unfinished = records.groupBy("vehicle_id").agg(F.bool_and("active").alias("a")).where("a").select("vehicle_id")
    out = filling.running_stats(filling.with_next(filling.prepare(records, DAY, 1), 4), unfinished)
    return out.withColumn("meters_driven", F.round("meters_driven", 3))


@query(
    "computation_by_frame_w9",
    """
    WITH steps AS (SELECT event_id AS step, epoch_us(ts) // 1000000 AS time_s, round(value * 100) / 100 AS d FROM events),
    framed AS (SELECT CASE WHEN step = (SELECT max(step) FROM steps) THEN (SELECT max(CAST(round_even(time_s * 1000 / (1000.0 * 3600), 0) AS BIGINT)) FROM steps)
                 ELSE CAST(round_even(time_s * 1000 / (1000.0 * 3600), 0) AS BIGINT) END AS frame, d FROM steps),
    sums AS (SELECT frame, sum(sum(d)) OVER (ORDER BY frame) AS c FROM framed GROUP BY frame),
    dense AS (SELECT unnest(range(min(frame), max(frame) + 1)) AS frame FROM sums)
    SELECT d.frame, round(last_value(c IGNORE NULLS) OVER (ORDER BY d.frame), 2) AS computation_time_ms
    FROM dense d LEFT JOIN sums s ON s.frame = d.frame""",
)
def computation_by_frame(spark, folder):
    steps = i.table(spark, folder, "events").select(
        F.col("event_id").alias("step"),
        F.expr(f"timestampdiff(SECOND, {i.EPOCH}, ts)").alias("time_s"),
        F.round("value", 2).alias("duration_ms"),
    )
    last = steps.agg(F.max(F.bround(F.col("time_s") / 3600)).cast("bigint").alias("f")).first()["f"]
    out = filling.computation_by_frame(steps, last, 3600, 1)
    return out.withColumn("computation_time_ms", F.round("computation_time_ms", 2))
