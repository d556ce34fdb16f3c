"""Stores: results equal the plain tables, and the plans read what they should."""

import pytest
from pyspark.sql import functions as F

from roadflow.operators import frames
from roadflow.sources import stores, tables

RECORD = "seq long, timestamp long, node_from long, node_to long, segment_length int, vehicle_id long, start_offset_m float, speed_mps double, active boolean"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_come_from_footers(spark, tmp_path):
    times = [5, 86399, 86400, 3 * 86400 + 1, -1, None]
    records = spark.createDataFrame([(n, t) for n, t in enumerate(times)], "seq long, timestamp long")
    stores.write_dated_records(records, f"{tmp_path}/dated")
    out = stores.record_ranges(spark, f"{tmp_path}/dated")
    assert {tuple(r) for r in out.collect()} == {
        (0, 5, 86399, 2), (1, 86400, 86400, 1), (3, 259201, 259201, 1), (-1, -1, -1, 1), (None, None, None, 1)}
    plan = plan_of(out)
    assert "PushedAggregation: [MIN(timestamp), MAX(timestamp), COUNT(*)]" in plan and "PushedGroupBy: [day]" in plan
    # The caller's own session is left as it was.
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        stores.write_dated_records(records, f"{tmp_path}/dated")


def frame_store(spark, path):
    rows = [(n, n * 5, n % 3, 1, 50, 7 + n % 4, float(n % 50), 10.0, True) for n in range(300)]
    records = spark.createDataFrame(rows, RECORD)
    framed = frames.frame_rows(records, 20)
    index = frames.frame_index(framed, frames.added_stats(records, 20))
    tables.write_frames(framed, index, frames.run_summary(records, framed, 20), path, bucket=8)
    return framed


def test_many_frames_are_looked_up_at_once(spark, tmp_path):
    framed = frame_store(spark, f"{tmp_path}/f")
    wanted = spark.createDataFrame([(3,), (3,), (4,), (40,), (None,), (-5,), (10**9,)], "frame_id long")
    found = stores.read_frames(spark, f"{tmp_path}/f", wanted, 8)
    assert found.columns == framed.columns
    expected = framed.where(F.col("frame_id").isin(3, 4, 40))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect())) != []
    assert stores.read_frames(spark, f"{tmp_path}/f", wanted.limit(0), 8).count() == 0


def test_frames_prune_folders(spark, tmp_path):
    frame_store(spark, f"{tmp_path}/f")
    spark.createDataFrame([(3,), (4,)], "frame_id long").write.parquet(f"{tmp_path}/wanted")
    found = stores.read_frames(spark, f"{tmp_path}/f", spark.read.parquet(f"{tmp_path}/wanted"), 8)
    assert "dynamicpruning" in plan_of(found)
    expected = found.count()
    # Files of other buckets are never opened: they may hold anything.
    for part in (tmp_path / "f" / "grouped_data").glob("bucket=[1-9]*/*.parquet"):
        part.write_bytes(b"x" * part.stat().st_size)
    assert stores.read_frames(spark, f"{tmp_path}/f", spark.read.parquet(f"{tmp_path}/wanted"), 8).count() == expected > 0


def test_clustered_tables_join_without_exchange(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 7).alias("node_from"), (F.col("id") % 5).alias("node_to"), F.col("id").alias("frame_id"))
    edges = rows.select("node_from", "node_to").distinct().select(
        "*", F.lit(10).alias("length_m"), (1 + F.col("node_from") % 3).cast("int").alias("lanes"), F.lit(50).alias("max_speed_kph"))
    name = f"t{abs(hash(str(tmp_path)))}"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = ["node_from", "node_to"]
        left = stores.save_clustered(rows, f"{name}_rows", keys, 4, f"{tmp_path}/rows")
        right = stores.save_clustered(edges, f"{name}_edges", keys, 4, f"{tmp_path}/edges")
        joined = stores.frames_with_segments(left, right)
        plan = plan_of(joined)
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert joined.count() == 1000 and joined.where("lanes <> 1 + node_from % 3").count() == 0
        lost = stores.frames_with_segments(left, right.where("node_from <> 6"))
        with pytest.raises(Exception, match="no segment 6"):
            lost.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE IF EXISTS {name}_rows")
        spark.sql(f"DROP TABLE IF EXISTS {name}_edges")
