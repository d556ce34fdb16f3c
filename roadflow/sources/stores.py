"""Stores laid out for the questions asked of them: records by day, frames by bucket, tables clustered by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_S = 86400


def write_dated_records(records: DataFrame, path: str) -> None:
    """Records in a folder per day since 1970, in time order; a day with very many records fills several files.

    Records without a time share one folder of a null day.
    """
    dated = records.withColumn("day", F.floor(F.col("timestamp") / DAY_S).cast("int"))
    ordered = dated.repartitionByRange("day", "timestamp").sortWithinPartitions("day", "timestamp")
    ordered.write.mode("errorifexists").partitionBy("day").parquet(path)


def _footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application in which aggregates over Parquet are answered from file statistics."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def record_ranges(spark: SparkSession, path: str) -> DataFrame:
    """First and last time and number of records of every day of a dated store, from file footers; no row is read.

    ``(day, min_timestamp, max_timestamp, records)``.  Counts include records
    without a time; a day that has only such has null bounds.
    """
    table = _footer_session(spark).read.parquet(path)
    count = F.count(F.lit(1)).alias("records")
    dated = table.where("day IS NOT NULL").groupBy("day").agg(F.min("timestamp").alias("min_timestamp"), F.max("timestamp").alias("max_timestamp"), count)
    # Files without any time have no bounds in their footers; only their rows are counted.
    return dated.unionByName(table.where("day IS NULL").groupBy("day").agg(count), allowMissingColumns=True)


def read_frames(spark: SparkSession, path: str, wanted: DataFrame, bucket: int = 1024) -> DataFrame:
    """Rows of all frames named in ``wanted(frame_id)``, from a store of ``write_frames``.

    Only the bucket folders of those frames are scanned (dynamic partition
    pruning, as long as Spark broadcasts the wanted ids; beyond that the join
    shuffles).  Ids that repeat, are null or are not in the store add nothing.
    """
    rows = spark.read.parquet(f"{path}/grouped_data")
    span = spark.read.parquet(f"{path}/index").agg(F.min("frame_id").alias("a"), F.max("frame_id").alias("b")).first()
    if span.a is None:
        return rows.limit(0).drop("bucket")
    kind = rows.schema["bucket"].dataType
    inside = wanted.where(F.col("frame_id").between(span.a, span.b)).select(
        F.floor(F.col("frame_id") / bucket).cast(kind).alias("bucket"), F.col("frame_id").cast(rows.schema["frame_id"].dataType).alias("frame_id"))
    return rows.join(inside, ["bucket", "frame_id"], "left_semi").drop("bucket")


def save_clustered(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """``df`` as a table bucketed and sorted by ``keys``, one file a bucket; tables of equal keys and buckets join without a shuffle.

    With ``path`` the files lie there and the catalog only names them.
    """
    writer = df.repartition(buckets, *keys).write.mode("errorifexists").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def frames_with_segments(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Every frame row with length, lanes and speed limit of its segment; a row without one is an error.

    Columns of ``rows`` come first; ``segments(node_from, node_to, length_m, lanes, max_speed_kph)``.
    """
    attributes = ["length_m", "lanes", "max_speed_kph"]
    side = segments.select("node_from", "node_to", *attributes, F.lit(True).alias("__known"))
    joined = rows.join(side, ["node_from", "node_to"], "left")
    missing = F.raise_error(F.concat(F.lit("no segment "), F.coalesce(F.col("node_from").cast("string"), F.lit("null")), F.lit(" - "), F.coalesce(F.col("node_to").cast("string"), F.lit("null"))))
    return joined.select(*rows.columns, *[F.when(F.col("__known"), F.col(c)).otherwise(missing.cast(t)).alias(c) for c, t in zip(attributes, ["int", "int", "int"])])
