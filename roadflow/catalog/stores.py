"""Queries over stores written from the records: day ranges from footers, many frames at once, clustered tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roadflow.catalog import inputs as i
from roadflow.catalog.frames import BASE, DAY, FRAMED_SQL, rounded
from roadflow.catalog.registry import query
from roadflow.operators import frames
from roadflow.session import cut_lineage, new_folder
from roadflow.sources import stores, tables

BUCKET = 4
SEGMENT_BUCKETS = 32


@query(
    "record_ranges_s18",
    i.sql_with(i.FCD_SQL)
    + """SELECT CAST(timestamp // 86400 AS INTEGER) AS day, min(timestamp) AS min_timestamp, max(timestamp) AS max_timestamp, count(*) AS records
    FROM fcd GROUP BY ALL""",
)
def record_ranges(spark, folder):
    path = new_folder(spark)
    stores.write_dated_records(i.fcd(spark, folder, False), path)
    return stores.record_ranges(spark, path)


@query(
    "frames_from_table_s23",
    BASE
    + f"""
    , wanted AS (
      SELECT (timestamp + {DAY // 2}) // {DAY} AS frame_id FROM fcd JOIN events ON event_id = seq
      WHERE event_type = 'error' GROUP BY 1 HAVING count(*) % 2 = 0)
    SELECT * FROM frame_rows WHERE frame_id IN (SELECT frame_id FROM wanted)""",
)
def frames_from_table(spark, folder):
    """Frames with an even number of errors, looked up together in the frame store."""
    records = cut_lineage(i.fcd(spark, folder))
    rows, path = frames.frame_rows(records, DAY), new_folder(spark)
    tables.write_frames(rows, frames.frame_index(rows, frames.added_stats(records, DAY)), frames.run_summary(records, rows, DAY), path, BUCKET)
    errors = i.table(spark, folder, "events").where("event_type = 'error'").select(F.col("event_id").alias("seq"))
    wanted = frames.assign_frames(records, DAY).join(errors, "seq").groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0")
    return rounded(stores.read_frames(spark, path, wanted, BUCKET), "speed_sum_first", "speed_sum_second")


@query(
    "frames_with_segments_s21_j4",
    i.sql_with(i.FCD_SQL, i.FCD_SEGMENTS_SQL, FRAMED_SQL)
    + """SELECT frame_id, node_from, node_to, count_unique_first + count_unique_second AS volume, length_m, lanes, max_speed_kph
    FROM frame_rows JOIN fcd_segments USING (node_from, node_to)""",
)
def frames_with_segments(spark, folder):
    """Frame rows and segments as clustered tables, joined where they lie."""
    records, keys, name = cut_lineage(i.fcd(spark, folder)), ["node_from", "node_to"], uuid.uuid4().hex
    rows = stores.save_clustered(frames.frame_rows(records, DAY), f"rows_{name}", keys, SEGMENT_BUCKETS, new_folder(spark))
    edges = stores.save_clustered(i.fcd_segments(records), f"segments_{name}", keys, SEGMENT_BUCKETS, new_folder(spark))
    volume = rows.select("frame_id", *keys, (F.col("count_unique_first") + F.col("count_unique_second")).alias("volume"))
    return stores.frames_with_segments(volume, edges)
