"""Geographic positions: points along segments and nearest nodes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.functions.scalars import drawn_at, mps_to_kph, polyline_point
from roadflow.session import cut_lineage

SEGMENT = ["node_from", "node_to"]


def segment_lines(segments: DataFrame, nodes: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Line of each segment as an array of points: the drawn one, else straight between its nodes."""

    def end(column: str, name: str) -> DataFrame:
        return nodes.select(F.col("node_id").alias(column), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias(name))

    straight = segments.select(*SEGMENT).distinct().join(end("node_from", "__a"), "node_from", "left").join(
        end("node_to", "__b"), "node_to", "left"
    )
    fallback = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.array("__a", "__b"))
    if lines is None:
        return straight.select(*SEGMENT, fallback.alias("line"))
    return straight.join(lines, SEGMENT, "left").select(*SEGMENT, F.coalesce("line", fallback).alias("line"))


def shortest_line(edges: DataFrame, level: str | None = None) -> DataFrame:
    """Line and class of the shortest of parallel edges, of the classes drawn at a zoom level.

    The shortest edge decides: if its class isn't drawn, the segment isn't.  An
    edge without a class is drawn at every level.
    """
    shortest = edges.groupBy(*SEGMENT).agg(
        F.min_by(F.struct("highway", "line"), F.struct("length_m", "edge_key")).alias("e")
    ).select(*SEGMENT, "e.*")
    if level is None:
        return shortest
    return shortest.where(F.col("highway").isNull() | drawn_at(F.col("highway"), level))


def gps_points(records: DataFrame, nodes: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Points of the records on the date of the first appended record.

    Speed in km/h with two decimals; records on segments without a line drop out.
    """
    day = records.agg(F.floor(F.min_by("timestamp", "seq") / 86400).alias("d")).first()["d"]
    today = records.where(F.col("timestamp").between(day * 86400, day * 86400 + 86399))
    placed = today.join(segment_lines(today, nodes, lines), SEGMENT).where("line IS NOT NULL")
    share = F.col("start_offset_m").cast("double") / F.col("segment_length")
    return placed.withColumn("p", polyline_point(F.col("line"), share)).select(
        "seq",
        (F.col("timestamp") % 86400).cast("double").alias("seconds"),
        F.col("p.y").alias("st_y"), F.col("p.x").alias("st_x"),
        F.lit(0).alias("direction"),
        F.bround(mps_to_kph(F.col("speed_mps")), 2).alias("speed"),
        "vehicle_id",
    )


def _cell(lon: Column, lat: Column, size: float) -> list[Column]:
    return [F.floor(lon / size).cast("bigint").alias("cx"), F.floor(lat / size).cast("bigint").alias("cy")]


def _distance_key(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine term: grows with the great-circle distance."""
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lon2 - lon1) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def nearest_nodes(points: DataFrame, nodes: DataFrame, fan: int = 4, compare: int = 8) -> DataFrame:
    """Nearest node of each point by great-circle distance, ties to the smaller id.

    ``points(point_id, lon, lat)``, ``nodes(node_id, lon, lat)``; boxes do not
    wrap the date line.  Equal places are searched once.

    The search descends a grid tree of the nodes.  Per place it keeps the
    non-empty cells that may hold the nearest node: a cell goes when the nearest
    edge of its bounding box lies beyond the farthest corner of another kept
    cell.  A cell of more than ``compare`` nodes splits instead of being compared
    node by node.  Cells below 1e-13 degrees, where coordinates run out of
    digits, are compared node by node; so nodes may lie as close as they like.
    """
    unique = nodes.groupBy("lon", "lat").agg(F.min("node_id").alias("node_id"))

    def boxes(level: int) -> DataFrame:
        return unique.groupBy(*_cell(F.col("lon"), F.col("lat"), 360.0 / fan**level)).agg(
            F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"),
            F.count("*").alias("n"), F.min("node_id").alias("node_id"),
        )

    x, y = F.col("x"), F.col("y")

    def half_sine_squared(degrees: Column) -> Column:
        h = F.sin(F.radians(degrees) / 2)
        return h * h

    cos0, cos1 = F.cos(F.radians(F.col("y0"))), F.cos(F.radians(F.col("y1")))
    crosses_equator = (F.col("y0") <= 0) & (F.col("y1") >= 0)
    near = half_sine_squared(F.greatest(F.col("y0") - y, y - F.col("y1"), F.lit(0.0))) + F.cos(F.radians(y)) * F.least(
        cos0, cos1
    ) * half_sine_squared(F.greatest(F.col("x0") - x, x - F.col("x1"), F.lit(0.0)))
    far = half_sine_squared(F.greatest(F.abs(y - F.col("y0")), F.abs(y - F.col("y1")))) + F.cos(F.radians(y)) * F.when(
        crosses_equator, F.lit(1.0)
    ).otherwise(F.greatest(cos0, cos1)) * half_sine_squared(F.greatest(F.abs(x - F.col("x0")), F.abs(x - F.col("x1"))))

    def prune(pairs: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
        """Drop cells that cannot hold the nearest node; the slack absorbs rounding."""
        bound = pairs.groupBy("x", "y").agg(F.min(far).alias("bound"))
        kept = pairs.join(bound, ["x", "y"]).where(near <= F.col("bound") * (1 + 1e-9) + 1e-18)
        return cut_lineage(kept.drop("bound"), replaces)

    extent = unique.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    if extent[0] is None:
        return points.select("point_id", F.lit(None).cast("bigint").alias("node_id")).where(F.lit(False))
    widest = max(extent[1] - extent[0], extent[3] - extent[2], 1e-9)
    start = max(0, math.floor(math.log(360.0 / widest, fan)))
    size = 360.0 / fan**start

    def cells_between(low: float, high: float) -> Column:
        return F.sequence(F.lit(math.floor(low / size)).cast("bigint"), F.lit(math.floor(high / size)).cast("bigint"))

    # The tree starts where the extent fits into at most two cells each way.
    places = points.select(F.col("lon").alias("x"), F.col("lat").alias("y")).distinct()
    roots = places.withColumn("cx", F.explode(cells_between(extent[0], extent[1]))).withColumn(
        "cy", F.explode(cells_between(extent[2], extent[3]))
    )
    finest = max(start, math.ceil(math.log(360.0 / 1e-13, fan)))
    level = start

    def opened(cells: DataFrame) -> DataFrame:
        """The nodes of cells of the current level, each as a cell of its own."""
        inside = unique.select(*_cell(F.col("lon"), F.col("lat"), 360.0 / fan**level), "lon", "lat", "node_id")
        return cells.select("x", "y", "cx", "cy").join(inside, ["cx", "cy"]).select(
            "x", "y", "cx", "cy", F.col("lon").alias("x0"), F.col("lon").alias("x1"), F.col("lat").alias("y0"), F.col("lat").alias("y1"),
            F.lit(1).cast("bigint").alias("n"), "node_id",
        )

    columns = ["x", "y", "cx", "cy", "x0", "x1", "y0", "y1", "n", "node_id"]
    state = prune(roots.join(boxes(start), ["cx", "cy"]).select(*columns))
    while True:
        crowded = state.where(F.col("n") > compare)
        if level == finest or crowded.isEmpty():
            state = state.where("n = 1").unionByName(opened(state.where("n > 1")))
            break
        settled = state.where("n = 1").unionByName(opened(state.where((F.col("n") > 1) & (F.col("n") <= compare))))
        level += 1
        child = boxes(level).withColumns({"px": F.floor(F.col("cx") / fan), "py": F.floor(F.col("cy") / fan)})
        split = crowded.select("x", "y", F.col("cx").alias("px"), F.col("cy").alias("py")).join(child, ["px", "py"])
        state = prune(split.select(*columns).unionByName(settled), state)
    scored = state.select("x", "y", "node_id", _distance_key(x, y, F.col("x0"), F.col("y0")).alias("d"))
    best = scored.groupBy("x", "y").agg(F.min(F.struct("d", "node_id")).alias("b")).select(
        x.alias("lon"), y.alias("lat"), F.col("b.node_id").alias("node_id")
    )
    return points.join(best, ["lon", "lat"]).select("point_id", "node_id")
