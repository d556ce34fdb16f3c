"""The entry points as jobs: demand, map, aggregation, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.functions.scalars import travel_time
from roadflow.operators import demand, filling, frames, network, positions, reports, routing
from roadflow.sources import tables


def flows_to_od(spark: SparkSession, source: str, out: str, frequency_s: int = 20, sampling_s: int = 5, seed: int = 0) -> None:
    tables.write_od(demand.od_from_flows(tables.read_flows(spark, source), frequency_s, sampling_s, seed), out)


def combine_od(spark: SparkSession, rules_path: str, out: str, sep: str = ";") -> None:
    rules = tables.read_rules(spark, rules_path, sep)
    paths = [r.path for r in rules.select("path").distinct().collect()]
    combined = demand.combine(rules, tables.read_matrices(spark, paths, sep))
    combined.write.mode("overwrite").option("sep", sep).csv(out, header=True)


def od_to_vehicles(
    spark: SparkSession, od: DataFrame, nodes: DataFrame, segments: DataFrame, frequency_s: int = 20, sampling_s: int = 5,
    no_routing: bool = False, download_date: str | None = None, grow_lat: float = 0.0, grow_lon: float = 0.0, **limits: float,
) -> DataFrame:
    """Vehicles with the fastest route between the nearest nodes, or just the two nodes.

    Box and day of the map come along; ``limits`` are the caller's own ``south``,
    ``north``, ``west`` and ``east``.
    """
    ends = demand.od_nodes(od, nodes)
    if no_routing:
        routed = ends.withColumn("osm_route", F.array("origin_node", "dest_node"))
    else:
        edges = routing.weighted(segments, travel_time(F.col("length_m"), F.col("max_speed_kph")))
        pairs = ends.select("origin_node", "dest_node").distinct().withColumn("request_id", F.struct("origin_node", "dest_node"))
        asked = pairs.where("origin_node <> dest_node").select(
            "request_id", F.col("origin_node").alias("origin"), F.col("dest_node").alias("dest")
        )
        paths = routing.best_paths(edges, asked).select("request_id.origin_node", "request_id.dest_node", F.col("path").alias("osm_route"))
        routed = ends.join(paths, ["origin_node", "dest_node"], "left")
    box = demand.bounding_box(od, grow_lat, grow_lon, **limits)
    return demand.vehicles_from_routes(od, routed, frequency_s, sampling_s, box, download_date)


def build_map(spark: SparkSession, graphml: str, out: str) -> None:
    nodes, edges = tables.read_graphml(spark, graphml)
    tables.save_table(network.build_segments(edges), f"{out}/segments")
    tables.save_table(nodes, f"{out}/nodes")


def aggregate(
    spark: SparkSession, records: DataFrame, out: str, frames_wanted: int | None, round_freq_s: int, interval_s: int | None = None,
    source: dict | None = None,
) -> int:
    """Frame rows, index and summary with the run's own attributes; returns the frame width."""
    span = frames.time_range(records).first()
    width = frames.frame_interval(span.max_timestamp - span.min_timestamp, frames_wanted, round_freq_s, interval_s)
    rows = frames.frame_rows(records, width)
    tables.write_frames(
        rows, frames.frame_index(rows, frames.added_stats(records, width)), frames.run_summary(records, rows, width), out, source=source
    )
    return width


def comparison(spark: SparkSession, records: DataFrame, fleet: DataFrame, minutes: int, out: str) -> None:
    behaviour = fleet.select(F.col("id").alias("vehicle_id"), "alternatives", "route_selection")
    tables.write_text_table(reports.comparison_table(filling.prepare(records, 1, 1), minutes * 60, behaviour), out, "interval")


def info(records: DataFrame, minute: int | None, completion: float | None) -> list[DataFrame]:
    out = []
    if minute is not None:
        out.append(reports.status_at_minute(records, minute))
    if completion is not None:
        out.append(reports.status_at_completion(records, completion))
    return out


def enrich(spark: SparkSession, frames_path: str, edges: DataFrame, out: str, offset_s: int = 0) -> None:
    width = spark.read.parquet(f"{frames_path}/run_metadata").first()["interval_s"]
    rows = spark.read.parquet(f"{frames_path}/grouped_data").drop("bucket")
    tables.save_table(reports.enrich(rows, edges, width, offset_s), out)


def gps(records: DataFrame, nodes: DataFrame, out: str, lines: DataFrame | None = None) -> None:
    positions.gps_points(records, nodes, lines).drop("seq").write.mode("overwrite").csv(out, header=True)
