"""Cells of rows that may match each other, searched in groups of bounded weight."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.components import connected_components
from roadflow.session import cut_lineage

#: Middles of blocks that meet in one group.
_MEETING = 256


def spanning_links(placed: DataFrame, key: str, weight: str, limit: int, columns: list[str], search: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """Links ``(a, b)`` that connect all matching rows of each cell (column ``component`` of ``placed``).

    ``search`` takes a group with ``columns``, ``block`` and ``asks`` and returns
    links that span the matches in it: among all rows where ``asks`` is null,
    else between the asking rows and those of other blocks that don't ask.

    Cells are packed into bins of about ``limit`` in weight.  A cell above it is
    cut into blocks by a hash of ``key``:

    1. Each block is searched by itself.
    2. The rows with most links, one of each block, meet.  In a group of near
       copies this connects nearly everything.
    3. Rows outside a cell's largest component so far ask all its other blocks.

    Two rows of the largest component need no further look, and any other pair
    has met in 1 or has one side asking in 3, so no link between components is
    missed.  Work grows with the cell times the rows left over after 2.
    """
    loads = placed.groupBy("component").agg(F.sum(weight).alias("load"))
    loads = cut_lineage(loads)
    bins = F.greatest(F.lit(1), F.ceil(loads.select(F.sum("load")).scalar() / limit))
    sized = loads.select(
        "component", F.greatest(F.lit(1), F.ceil(F.col("load") / limit)).cast("int").alias("blocks"),
        F.pmod(F.xxhash64("component"), bins).alias("bin"))
    base = placed.join(sized, "component").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    everyone = F.lit(None).cast("boolean").alias("asks")
    alone = F.col("blocks") == 1
    own = base.select(
        *columns, "block", everyone, F.when(alone, F.col("bin")).otherwise(F.col("component")).alias("place"),
        F.when(alone, F.lit(-1)).otherwise(F.col("block")).alias("part"))
    inside = cut_lineage(own.groupBy("place", "part").applyInArrow(search, schema))
    if loads.where(F.col("load") > limit).isEmpty():
        return inside
    large = cut_lineage(base.where("blocks > 1"))
    members = large.select(F.col(key).alias("a"), "component", "block")
    linked = inside.join(members, "a")
    degree = linked.groupBy("component", "block", "a").agg(F.count(F.lit(1)).alias("n"))
    middles = degree.groupBy("component", "block").agg(F.max_by("a", "n").alias(key)).select(
        "component", "block", key, (F.col("block") == F.min("block").over(_per_cell())).alias("first"))
    # The middle of the first block meets all others, so that the groups connect.
    last = F.floor((F.col("blocks") - 1) / _MEETING).cast("int")
    meeting = F.when(F.col("first"), F.sequence(F.lit(0), last)).otherwise(F.array(F.floor(F.col("block") / _MEETING).cast("int")))
    met = large.join(middles.select(key, "component", "first"), [key, "component"]).withColumn("part", F.explode(meeting))
    between = cut_lineage(met.select(*columns, "block", everyone, F.col("component").alias("place"), "part").groupBy("place", "part").applyInArrow(search, schema))
    labels = connected_components(linked.select("a", "b").unionByName(between)).select(F.col("node").alias(key), F.col("component").alias("label"))
    labelled = cut_lineage(large.select(key, "component", weight).join(labels, key, "left").withColumn("label", F.coalesce("label", key)))
    sizes = labelled.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("component").agg(F.max_by("label", "n").alias("main"))
    rest = cut_lineage(labelled.join(main, "component").where("label <> main").select(key, "component", weight))
    chunks = rest.groupBy("component").agg(F.ceil(F.sum(weight) / limit).cast("int").alias("chunks"))
    index = large.join(chunks, "component").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("to", F.col("block"))
    asking = (
        large.join(rest.select(key, "component"), [key, "component"]).join(chunks, "component")
        .withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.col("chunks")).cast("int"))
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    wanted = [*columns, "block", "component", "to", "chunk"]
    both = index.select(*wanted, F.lit(False).alias("asks")).unionByName(asking.select(*wanted, F.lit(True).alias("asks")))
    across = both.groupBy("component", "to", "chunk").applyInArrow(search, schema)
    return inside.unionByName(between).unionByName(across)


def _per_cell():
    from pyspark.sql import Window

    return Window.partitionBy("component")
