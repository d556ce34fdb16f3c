"""Approximate nearest neighbours by shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from roadflow.llm.hilbert import hilbert_keys
from roadflow.session import cut_lineage


def usable_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``(vec_id, vector)`` of rows with an id and a finite vector that isn't null, empty or zero."""
    own = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    return own.where(
        "vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 AND exists(vector, x -> x <> 0) "
        "AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")


def _distinct(rows: DataFrame, is_query, kept: int) -> DataFrame:
    """``(rep, ids, asked, vector)`` per different vector: its smallest ``kept`` ids and whether a query has it.

    Each batch keeps only so many ids of a vector before the shuffle, so copies
    of one vector never gather.
    """
    marked = rows.select("vector", "vec_id", is_query.alias("asked"))
    names = marked.columns

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(1).to_pylist(), np.int64)
            asked = np.array(batch.column(2).to_pylist(), bool)
            held: dict[tuple, list[int]] = {}
            vectors = [tuple(v) for v in batch.column(0).to_pylist()]
            for k in np.argsort(ids, kind="stable").tolist():
                held.setdefault(vectors[k], []).append(k)
            take, flag = [], []
            for members in held.values():
                take += members[:kept]
                flag += [bool(asked[members].any())] * len(members[:kept])
            chosen = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1), pa.array(flag, pa.bool_())], names)

    return (
        marked.mapInArrow(thin, marked.schema)
        .groupBy("vector")
        .agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, kept).alias("ids"), F.max("asked").alias("asked"))
        .select(F.col("ids")[0].alias("rep"), "ids", "asked", "vector")
    )


def _projections(sample: np.ndarray, curves: int, axes: int, bits: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per curve an orthonormal projection with offset and scale: the sample spreads over the grid, shifted by a random part of it."""
    rng = np.random.default_rng(seed)
    dimension = sample.shape[1]
    axes = min(axes, dimension)
    out = []
    for _ in range(curves):
        basis = np.linalg.qr(rng.normal(size=(dimension, axes)))[0]
        seen = sample @ basis
        spread = np.maximum(seen.std(0), 1e-12) * 6
        shift = rng.uniform(-0.125, 0.125, axes)
        out.append((basis, seen.mean(0) - spread * (0.5 + shift), spread / (1 << bits)))
    return out


_RANKED = T.StructType([
    T.StructField("curve", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("rep", T.LongType()),
    T.StructField("asked", T.BooleanType()), T.StructField("vector", T.BinaryType())])
_FOUND = T.StructType([
    T.StructField("query", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("score", T.DoubleType())])


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    key: str = "vec_id",
    column: str = "embedding",
    curves: int = 8,
    axes: int = 8,
    bits: int = 4,
    share: float = 0.08,
    piece_rows: int = 1024,
    sample_rows: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest cosines found for each query among all other rows.

    ``is_query`` is a column expression over ``vec_id``.  Every vector gets a
    place on each of ``curves`` Hilbert curves through differently projected and
    shifted grids of ``axes`` axes.  Spark sorts the curves by range and cuts
    them into pieces of ``piece_rows`` places; a query is compared, in double
    precision on the original vectors, with its own piece and with the
    neighbouring ones that cover ``share`` of all vectors to each side.  What the
    curves find is merged by the best scores.

    ``share`` is what recall on data without structure depends on; it is a share
    and not a number of rows so that recall stays as the table grows.  The grid
    is fitted on at most ``sample_rows`` vectors, drawn by a hash of their id;
    every vector is indexed.  Equal vectors take one place on the curves and are
    all found with it; ties go to the smaller id.  Rows with a null id or with
    vectors that are null, empty, zero or not finite take no part.  Vectors compare
    with those of their own length; each length is an index of its own.  Fewer
    than ``k`` candidates give fewer rows.
    """
    rows = usable_vectors(vectors, key, column)
    lengths = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())
    parts = [
        _nearest_of_length(rows if len(lengths) == 1 else rows.where(F.size("vector") == n), n, is_query, k, curves, axes, bits, share, piece_rows, sample_rows, seed)
        for n in lengths or [1]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _nearest_of_length(
    rows: DataFrame, dimension: int, is_query, k: int, curves: int, axes: int, bits: int, share: float, piece_rows: int, sample_rows: int, seed: int,
) -> DataFrame:
    kind = np.float32 if dict(rows.dtypes)["vector"] == "array<float>" else np.float64
    classes = cut_lineage(_distinct(rows, is_query, k + 1))
    sample = classes.select("vector").orderBy(F.xxhash64("rep")).limit(sample_rows).collect()
    fitted = np.array([r[0] for r in sample], np.float64).reshape(-1, dimension)
    fitted /= np.maximum(np.linalg.norm(fitted, axis=1, keepdims=True), 1e-300)
    grids = _projections(fitted, curves, axes, bits, seed) if len(fitted) else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(batch.column(2).to_pylist(), kind).reshape(-1, dimension)
            wide = values.astype(np.float64)
            # Scaled by the largest component first, so that squares stay finite.
            wide /= np.abs(wide).max(1, keepdims=True)
            unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
            raw = pa.array([v.tobytes() for v in values], pa.binary())
            for curve, (basis, offset, cell) in enumerate(grids):
                cells = np.clip(np.floor((unit @ basis - offset) / cell), 0, (1 << bits) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([curve] * len(values), pa.int32()), pa.array(hilbert_keys(cells, bits)), batch.column(0), batch.column(1), raw],
                    _RANKED.names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            at = []
            for curve in batch.column(0).to_pylist():
                at.append(seen.get(curve, 0))
                seen[curve] = at[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], [*_RANKED.names, "part", "at"])

    numbered = T.StructType([*_RANKED.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])
    along = (
        classes.select("rep", "asked", "vector").mapInArrow(place, _RANKED)
        .repartitionByRange("curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    )
    along = cut_lineage(along.mapInArrow(number, numbered))
    counts = along.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(counts.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    total = classes.count()
    reach = int(np.ceil(share * total / piece_rows))
    last = max(0, (total - 1) // piece_rows)
    pieces = along.join(starts, ["curve", "part"]).select(
        "curve", F.floor((F.col("first") + F.col("at")) / piece_rows).cast("int").alias("piece"), "rep", "asked", "vector")
    # A group is one piece and the queries of 16 neighbouring pieces, so its size is bounded whatever the reach.
    tile = 16
    reached = F.sequence(F.greatest(F.lit(0), F.col("piece") - reach), F.least(F.lit(last), F.col("piece") + reach))
    queries = pieces.where("asked").select(
        "curve", F.explode(reached).alias("to"), F.floor(F.col("piece") / tile).cast("int").alias("tile"), "rep", "vector", F.lit(True).alias("is_query"))
    tiles = F.sequence(
        F.floor(F.greatest(F.lit(0), F.col("piece") - reach) / tile).cast("int"),
        F.floor(F.least(F.lit(last), F.col("piece") + reach) / tile).cast("int"))
    index = pieces.select("curve", F.col("piece").alias("to"), F.explode(tiles).alias("tile"), "rep", "vector", F.lit(False).alias("is_query"))

    def compare(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("rep").to_pylist(), np.int64)
        asks = np.array(group.column("is_query").to_pylist(), bool)
        values = np.frombuffer(b"".join(group.column("vector").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64)
        values = values / np.abs(values).max(1, keepdims=True)
        norm = np.linalg.norm(values, axis=1)
        order = np.flatnonzero(~asks)[np.argsort(ids[~asks], kind="stable")]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        asking = np.flatnonzero(asks)
        for at in range(0, len(asking) if len(order) else 0, 512):
            some = asking[at : at + 512]
            score = values[some] @ values[order].T / (norm[some][:, None] * norm[order])
            # The query's own class is one of those found, so that its copies score by the same arithmetic.
            best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
            value = np.take_along_axis(score, best, 1)
            keep = np.isfinite(value)
            out.append((np.repeat(ids[some], best.shape[1]).reshape(best.shape)[keep], ids[order][best][keep], value[keep]))
        parts = [np.concatenate(p) for p in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.Table.from_arrays([pa.array(p) for p in parts], _FOUND.names)

    found = queries.unionByName(index).groupBy("curve", "to", "tile").applyInArrow(compare, _FOUND)
    merged = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    merged = merged.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    offered = merged.join(classes.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").join(
        classes.where("asked").select("vector", F.col("rep").alias("query")), "vector").select("query_id", "query")
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(offered, "query").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
