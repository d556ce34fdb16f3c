"""Queries of the progress reports and the enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow.catalog import inputs as i
from roadflow.catalog.frames import BASE, DAY, rows
from roadflow.catalog.registry import query
from roadflow.operators import filling, reports
from roadflow.session import cut_lineage

# The log works on one-second frames, where the frame equals the timestamp.
LOG_SQL = f"""
moved AS (
  SELECT *, coalesce(start_offset_m::DOUBLE - lag(start_offset_m) OVER w
           + CASE WHEN lag(node_from) OVER w <> node_from OR lag(node_to) OVER w <> node_to
             THEN lag(segment_length) OVER w ELSE 0 END, 0) AS meters,
         row_number() OVER w AS nth
  FROM fcd WINDOW w AS (PARTITION BY vehicle_id ORDER BY timestamp, seq)),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY vehicle_id, timestamp ORDER BY seq) AS up,
         row_number() OVER (PARTITION BY vehicle_id, timestamp ORDER BY seq DESC) AS down,
         min(nth) OVER (PARTITION BY vehicle_id, timestamp) = 1 AS opens,
         sum(meters) OVER (PARTITION BY vehicle_id, timestamp) AS meters_driven,
         timestamp - min(timestamp) OVER () AS at_s
  FROM moved),
log_rows AS (
  SELECT *, at_s // {DAY} AS interval FROM picked WHERE CASE WHEN opens THEN up = 1 ELSE down = 1 END),
spans AS (SELECT unnest(range(0, max(interval) + 1)) AS k FROM log_rows),
driven AS (
  SELECT *, coalesce(lead(at_s) OVER iv, CASE WHEN active THEN (interval + 1) * {DAY} ELSE at_s END) - at_s
           + CASE WHEN lag(at_s) OVER iv IS NULL AND lag(at_s) OVER al IS NOT NULL THEN at_s - interval * {DAY} ELSE 0 END AS dt
  FROM log_rows WINDOW iv AS (PARTITION BY vehicle_id, interval ORDER BY at_s), al AS (PARTITION BY vehicle_id ORDER BY at_s)),
since AS (
  SELECT k, l.*, coalesce(lead(at_s) OVER w, CASE WHEN active THEN (k + 1) * {DAY} ELSE at_s END) - at_s AS dt
  FROM spans JOIN log_rows l ON l.interval <= k WINDOW w AS (PARTITION BY k, vehicle_id ORDER BY at_s))
"""
LOG = i.sql_with(i.FCD_SQL, LOG_SQL)


def log_input(spark, folder):
    """Prepared rows as a table: the clock, the rows and the behaviours are then read from it, not from the events."""
    return cut_lineage(filling.prepare(i.fcd(spark, folder), 1, 1))


def facts(spark, folder, key):
    return reports.interval_facts(reports.interval_rows(log_input(spark, folder), DAY), key)


def behaviours(rows):
    """Routing behaviour per vehicle, by a rule on the vehicle number."""
    seen = rows.select("vehicle_id").distinct()
    v = F.col("vehicle_id")

    def by(names, n):
        return F.element_at(F.array(*[F.lit(x) for x in names]), (n % 4 + 1).cast("int"))

    return seen.select(
        v, by(reports.ALTERNATIVES, v).alias("alternatives"), by(reports.SELECTIONS, F.floor(v / 2)).alias("route_selection")
    )


_LOG_CTES = """
    , inside AS (
      SELECT interval AS k, count(DISTINCT vehicle_id) AS active_vehicles,
             count(DISTINCT vehicle_id) FILTER (NOT active) AS finished_vehicles,
             CAST(round_even(sum(meters_driven), 0) AS BIGINT) AS meters,
             CAST(round_even(sum(dt) / 60, 0) AS BIGINT) AS driving_minutes,
             count(DISTINCT (node_from, node_to)) AS segments,
             round(sum(speed_mps * greatest(dt, 1)) / sum(greatest(dt, 1)) * 3.6, 6) AS average_speed_kph
      FROM driven GROUP BY interval),
    total AS (
      SELECT k, count(DISTINCT vehicle_id) AS active_vehicles_since_start,
             count(DISTINCT vehicle_id) FILTER (NOT active) AS finished_vehicles_since_start,
             CAST(round_even(sum(meters_driven), 0) AS BIGINT) AS meters_since_start,
             CAST(round_even(sum(dt) / 60, 0) AS BIGINT) AS driving_minutes_since_start,
             count(DISTINCT (node_from, node_to)) AS segments_since_start,
             round(sum(speed_mps * greatest(dt, 1)) / sum(greatest(dt, 1)) * 3.6, 6) AS average_speed_kph_since_start
      FROM since GROUP BY k),
    modes AS (
      SELECT interval AS k,
        count(DISTINCT vehicle_id) FILTER (vehicle_id % 4 = 0) AS alternative_default,
        count(DISTINCT vehicle_id) FILTER (vehicle_id % 4 = 1) AS alternative_dijkstra_fastest,
        count(DISTINCT vehicle_id) FILTER (vehicle_id % 4 = 2) AS alternative_dijkstra_shortest,
        count(DISTINCT vehicle_id) FILTER (vehicle_id % 4 = 3) AS alternative_plateau_fastest,
        count(DISTINCT vehicle_id) FILTER (vehicle_id // 2 % 4 = 0) AS selection_no_alternative,
        count(DISTINCT vehicle_id) FILTER (vehicle_id // 2 % 4 = 1) AS selection_first,
        count(DISTINCT vehicle_id) FILTER (vehicle_id // 2 % 4 = 2) AS selection_random,
        count(DISTINCT vehicle_id) FILTER (vehicle_id // 2 % 4 = 3) AS selection_ptdr
      FROM log_rows GROUP BY interval)
"""


@query(
    "interval_log_a15_w7",
    LOG + _LOG_CTES
    + """
    SELECT k AS interval, (k + 1) * 1440 AS offset_minutes, inside.* EXCLUDE (k), total.* EXCLUDE (k), modes.* EXCLUDE (k)
    FROM inside JOIN total USING (k) JOIN modes USING (k)""",
)
def interval_log(spark, folder):
    prepared = log_input(spark, folder)
    by_vehicle, by_segment = reports.both_facts(reports.interval_rows(prepared, DAY))
    out = reports.interval_log(by_vehicle, by_segment, DAY, behaviours(prepared))
    return out.withColumns(
        {c: F.round(c, 6) for c in ("average_speed_kph", "average_speed_kph_since_start")}
    )


_CLASSES = ", ".join(
    f"count(*) FILTER (v >= {low} / 3.6::DOUBLE AND v < {high}) AS class_{name}"
    for name, low, high in zip(reports.CLASS_NAMES, (0, 20, 40, 60), ("20 / 3.6::DOUBLE", "40 / 3.6::DOUBLE", "60 / 3.6::DOUBLE", "10000"))
)


def _classes_sql(source, span, key):
    return (
        LOG
        + f"""
    , means AS (SELECT {span} AS interval, {key}, sum(speed_mps * greatest(dt, 1)) / sum(greatest(dt, 1)) AS v
                FROM {source} GROUP BY ALL)
    SELECT interval, {_CLASSES} FROM means GROUP BY interval"""
    )


@query("segment_speed_classes_a16", _classes_sql("driven", "interval", "node_from, node_to"))
def segment_speed_classes(spark, folder):
    return reports.interval_speed_classes(facts(spark, folder, reports.SEGMENT))


@query("vehicle_speed_classes_a16", _classes_sql("driven", "interval", "vehicle_id"))
def vehicle_speed_classes(spark, folder):
    return reports.interval_speed_classes(facts(spark, folder, ["vehicle_id"]))


@query("segment_speed_classes_since_start_a16", _classes_sql("since", "k", "node_from, node_to"))
def segment_speed_classes_since_start(spark, folder):
    return reports.total_speed_classes(cut_lineage(facts(spark, folder, reports.SEGMENT)), reports.SEGMENT, DAY)


@query("vehicle_speed_classes_since_start_a16", _classes_sql("since", "k", "vehicle_id"))
def vehicle_speed_classes_since_start(spark, folder):
    return reports.total_speed_classes(cut_lineage(facts(spark, folder, ["vehicle_id"])), ["vehicle_id"], DAY)


def _comparison_sql():
    """The log and the four class tables side by side, as texts under the file's headers."""
    parts = [("s_in", "driven", "interval", "node_from, node_to"), ("s_all", "since", "k", "node_from, node_to"),
             ("v_in", "driven", "interval", "vehicle_id"), ("v_all", "since", "k", "vehicle_id")]
    classes = "".join(
        f""", {name}_means AS (SELECT {span} AS k, {key}, sum(speed_mps * greatest(dt, 1)) / sum(greatest(dt, 1)) AS v FROM {source} GROUP BY ALL),
        {name} AS (SELECT k, {_CLASSES} FROM {name}_means GROUP BY k)"""
        for name, source, span, key in parts)
    log = ["(k + 1) * 1440", "active_vehicles", "active_vehicles_since_start",
           *[f"alternative_{x}" for x in reports.ALTERNATIVES], *[f"selection_{x}" for x in reports.SELECTIONS],
           "finished_vehicles", "finished_vehicles_since_start", "meters", "meters_since_start", "driving_minutes",
           "driving_minutes_since_start", "segments", "segments_since_start"]
    texts = [f"coalesce({c}, 0)::VARCHAR" for c in log]
    texts += [f"replace(coalesce(round_even({c}, 2)::VARCHAR, 'NaN'), '.', ',')" for c in ("average_speed_kph", "average_speed_kph_since_start")]
    texts += [f"coalesce({name}.class_{c}, 0)::VARCHAR" for name, *_ in parts for c in reports.CLASS_NAMES]
    columns = ", ".join(f'{t} AS "{h}"' for t, h in zip(texts, reports.comparison_header(), strict=True))
    joins = " ".join(f"LEFT JOIN {name} USING (k)" for name, *_ in parts)
    return LOG + _LOG_CTES + classes + f" SELECT k AS interval, {columns} FROM inside JOIN total USING (k) JOIN modes USING (k) {joins}"


@query("comparison_table_s28_c6", _comparison_sql())
def comparison_table(spark, folder):
    prepared = log_input(spark, folder)
    return reports.comparison_table(prepared, DAY, behaviours(prepared))


@query(
    "driving_time_w7",
    LOG + "SELECT vehicle_id, at_s, interval, CAST(dt AS BIGINT) AS driving_s FROM driven",
)
def driving_time(spark, folder):
    return reports.interval_rows(log_input(spark, folder), DAY).select("vehicle_id", "at_s", "interval", "driving_s")


MINUTE = 20 * 1440

@query(
    "status_at_minute_a17_a19",
    i.sql_with(i.FCD_SQL)
    + f"""
    , run AS (SELECT min(timestamp) + {MINUTE} * 60 AS lim, arg_max(timestamp, seq) - arg_min(timestamp, seq) AS real FROM fcd),
    pv AS (SELECT vehicle_id, count(DISTINCT (node_from, node_to)) FILTER (timestamp <= lim) AS c,
                  max(timestamp) <= any_value(lim) AND NOT arg_max(active, (timestamp, seq)) AS done
           FROM fcd, run GROUP BY vehicle_id)
    SELECT CAST({MINUTE} AS BIGINT) AS minute, round_even({MINUTE} / (any_value(real) / 60.0::DOUBLE) * 100, 2) AS minute_pct,
           count(*) AS vehicles, count(*) FILTER (c > 0) AS started, round_even(count(*) FILTER (c > 0) / count(*) * 100, 2) AS started_pct,
           count(*) FILTER (c > 1) AS left_first_segment, round_even(count(*) FILTER (c > 1) / count(*) * 100, 2) AS left_first_segment_pct,
           count(*) FILTER (done) AS finished, round_even(count(*) FILTER (done) / count(*) * 100, 2) AS finished_pct,
           round_even(avg(c), 2) AS mean_segments, round_even(avg(c) FILTER (NOT done), 2) AS mean_segments_unfinished
    FROM pv, run""",
)
def status_at_minute(spark, folder):
    return reports.status_at_minute(i.fcd(spark, folder), MINUTE)


@query(
    "status_at_completion_a18_w6",
    i.sql_with(i.FCD_SQL)
    + """
    , n AS (SELECT count(DISTINCT vehicle_id) AS n, min(timestamp) AS t0, arg_max(timestamp, seq) - arg_min(timestamp, seq) AS real FROM fcd),
    replay AS (SELECT *, count(*) FILTER (NOT active) OVER (ORDER BY timestamp, vehicle_id, seq) AS done,
                      CAST(active AS INTEGER) AS a FROM fcd),
    kept AS (SELECT * FROM replay, n WHERE done - (1 - a) < ceil(0.5 * n)),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, node_from, node_to ORDER BY timestamp, seq) = 1 AS fresh FROM kept),
    counted AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY vehicle_id ORDER BY timestamp, seq) AS sofar FROM firsts),
    pv AS (SELECT vehicle_id, count(*) FILTER (fresh) AS c FROM counted GROUP BY vehicle_id),
    s AS (SELECT count(*) FILTER (NOT active) AS finished, sum(sofar) FILTER (NOT active) AS at_end,
                 CAST(round_even((max(timestamp) - any_value(t0)) / 60.0, 0) AS BIGINT) AS minute FROM counted)
    SELECT finished, n - finished AS remaining, minute, round_even(minute / (real / 60.0::DOUBLE) * 100, 2) AS minute_pct,
           (SELECT count(*) FROM pv) AS started, round_even((SELECT count(*) FROM pv) / n * 100, 2) AS started_pct,
           (SELECT count(*) FROM pv WHERE c > 1) AS left_first_segment,
           round_even((SELECT count(*) FROM pv WHERE c > 1) / n * 100, 2) AS left_first_segment_pct,
           round_even((SELECT sum(c) FROM pv) / n, 2) AS mean_segments,
           round_even(((SELECT sum(c) FROM pv) - at_end) / (n - finished), 2) AS mean_segments_unfinished
    FROM s, n""",
)
def status_at_completion(spark, folder):
    return reports.status_at_completion(i.fcd(spark, folder), 0.5)


def _edges(spark, folder):
    """Edge rows from two overlapping maps: the segments in use, and a second copy with other limits."""
    used = i.fcd_segments(i.fcd(spark, folder, False))
    k = F.col("node_from") * 10 + F.col("node_to")
    first = used.select(
        "node_from", "node_to", F.col("max_speed_kph").cast("double").alias("max_speed"),
        F.concat(F.lit("class"), (k % 5).cast("string")).alias("highway"),
        F.concat(F.lit("LINESTRING ("), F.col("node_from").cast("string"), F.lit(" 0, "), F.col("node_to").cast("string"), F.lit(" 1)")).alias("geometry"),
        F.lit(0).alias("position"),
    )
    second = first.withColumn("max_speed", F.when(k % 3 == 0, F.col("max_speed") + 10).otherwise(F.col("max_speed")))
    return first.unionByName(second.withColumn("position", F.lit(1)))


_EDGES_SQL = """
copies AS (
  SELECT node_from, node_to, CAST(max_speed_kph AS DOUBLE) AS max_speed, 'class' || ((node_from * 10 + node_to) % 5) AS highway,
         'LINESTRING (' || node_from || ' 0, ' || node_to || ' 1)' AS geometry, (node_from * 10 + node_to) % 3 = 0 AS differs
  FROM fcd_segments)
"""


@query(
    "edge_metadata_j5_a23_u3",
    i.sql_with(i.FCD_SQL, i.FCD_SEGMENTS_SQL, _EDGES_SQL)
    + "SELECT node_from, node_to, max_speed, highway, geometry, CASE WHEN differs THEN 1 ELSE 0 END::BIGINT AS conflicts FROM copies",
)
def edge_metadata(spark, folder):
    best, conflicts = reports.edge_metadata(_edges(spark, folder), i.fcd(spark, folder, False))
    return best.join(conflicts, reports.SEGMENT)


@query(
    "enriched_frames_a22_j4",
    BASE.rstrip()
    + ", "
    + i.FCD_SEGMENTS_SQL.strip()
    + f"""
    , e AS (SELECT *, (speed_sum_first + speed_sum_second) * 3.6 / (speed_count_first + speed_count_second) AS avg_kph FROM frame_rows)
    SELECT frame_id * {DAY} + 3600 AS timestamp, node_from, node_to, round(avg_kph, 6) AS average_speed,
           count_unique_first + count_unique_second AS volume, CAST(max_speed_kph AS DOUBLE) AS max_speed,
           CAST(trunc(round(avg_kph / max_speed_kph * 100, 9)) AS BIGINT) AS los
    FROM e JOIN fcd_segments USING (node_from, node_to)""",
)
def enriched_frames(spark, folder):
    best, _ = reports.edge_metadata(_edges(spark, folder))
    out = reports.enrich(rows(spark, folder), best, DAY, 3600)
    return out.withColumn("average_speed", F.round("average_speed", 6))


def _steps(spark, folder):
    t0 = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    events = i.table(spark, folder, "events")
    return events.select(
        F.col("event_id").alias("step"),
        F.timestamp_diff("MICROSECOND", t0, F.col("ts")).alias("simulation_offset_us"),
        (F.col("user_id") % 50).alias("n_active"),
        F.round("value", 2).alias("duration_ms"),
        F.create_map(F.col("event_type"), F.round(F.col("value") * 100).cast("bigint")).alias("parts"),
    )


@query(
    "step_parts_s31_a20",
    """SELECT event_type AS part, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_ms
       FROM events GROUP BY event_type""",
)
def step_parts(spark, folder):
    return reports.step_parts(_steps(spark, folder))


@query(
    "recent_step_mean_s31",
    """SELECT round(avg(d), 6) AS mean_ms FROM (SELECT round(value, 2) AS d FROM events ORDER BY event_id DESC LIMIT 50)""",
)
def recent_step_mean(spark, folder):
    return reports.recent_step_mean(_steps(spark, folder), 50).withColumn("mean_ms", F.round("mean_ms", 6))
