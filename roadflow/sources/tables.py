"""Readers and writers of the run tables.

Parquet takes the place of the HDF5 and pickle files; run attributes become a
one-row table next to the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadflow import schemas
from roadflow.operators.frames import require_fields
from roadflow.operators.vehicles import LOAD_FREQUENCY_US

DURATIONS = {"time_offset": "time_offset_us", "frequency": "frequency_us", "fcd_sampling_period": "fcd_sampling_period_us"}


def _in_us(df: DataFrame) -> DataFrame:
    """Durations as microseconds, whether they come as intervals or as numbers of microseconds."""
    types = dict(df.dtypes)
    for old, new in DURATIONS.items():
        if old not in types:
            continue
        if types[old].startswith("interval"):
            value = F.round(F.col(old).cast("interval day to second").cast("decimal(20,6)") * 1000000).cast("bigint")
        elif types[old] == "bigint":
            value = F.col(old)
        else:
            raise ValueError(f"column {old} has type {types[old]}; an interval or microseconds are expected")
        df = df.withColumn(new, value).drop(old)
    return df


def load_vehicles(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Active vehicles with a route of at least two nodes, and box and date of the first row."""
    raw = spark.read.parquet(path)
    first = raw.limit(1).collect()
    if not first:
        raise ValueError("no vehicles in the input")
    row = first[0].asDict()
    box = ["bbox_lat_max", "bbox_lon_min", "bbox_lat_min", "bbox_lon_max"]
    meta = {c: row[c] for c in [*box, "download_date"] if c in row}
    kept = _in_us(raw).where(F.col("active") & (F.coalesce(F.size("osm_route"), F.lit(0)) >= 2))
    return kept.withColumn("frequency_us", F.lit(LOAD_FREQUENCY_US).cast("bigint")).drop(*box, "download_date"), meta


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


class RecordStore:
    """Append-only record history with run metadata; refuses to start over an existing one."""

    def __init__(self, spark: SparkSession, path: str, max_records_per_file: int = 1_000_000_000, resume: bool = False):
        self.spark, self.path, self.limit = spark, path.rstrip("/"), max_records_per_file
        if not resume and self._exists():
            raise FileExistsError(f"records exist at {self.path}")

    def _exists(self, part: str = "fcd") -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def append(self, records: DataFrame) -> None:
        names = [c.split()[0] for c in schemas.FCD.split(", ")]
        types = [c.split()[1] for c in schemas.FCD.split(", ")]
        require_fields(records)
        typed = records.select(*[F.col(n).cast(t).alias(n) for n, t in zip(names, types)])
        typed.write.mode("append").option("maxRecordsPerFile", self.limit).parquet(f"{self.path}/fcd")

    def write_metadata(self, **attributes) -> None:
        """Written once per run; a second call leaves the first values."""
        row = self.spark.createDataFrame([{k: v for k, v in attributes.items() if v is not None}])
        row.write.mode("ignore").parquet(f"{self.path}/run_metadata")

    def records(self) -> DataFrame:
        return self.spark.read.schema(schemas.FCD).parquet(f"{self.path}/fcd")

    def metadata(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/run_metadata")

    def attributes(self) -> dict:
        """The run's attributes; none where the run wrote none."""
        if not self._exists("run_metadata"):
            return {}
        row = self.metadata().first()
        return row.asDict() if row else {}


def load_records(spark: SparkSession, path: str, pattern: str = "*.parquet", per_file: int | None = None) -> DataFrame:
    """Records of a file or folder; ``per_file`` keeps the first rows of each file."""
    reader = spark.read.schema(schemas.FCD)
    if not path.endswith(".parquet"):
        reader = reader.option("pathGlobFilter", pattern)
    records = require_fields(reader.parquet(path))
    if per_file is None:
        return records
    files = records.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start")})

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        ranked = rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy("__block", "seq")))
        return ranked.where(F.col("__n") <= per_file).drop("__n")

    # Per block of a file first, so that no task sees a whole file.
    return first(first(files, "__file", "__block"), "__file").drop("__file", "__block")


def with_datetime(records: DataFrame) -> DataFrame:
    """Zone-less time of the whole seconds since 1970."""
    zero = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return records.withColumn("datetime", F.timestamp_add("SECOND", F.col("timestamp"), zero))


def merge_records(spark: SparkSession, runs: list[str], out: str) -> None:
    """One record store from several: all records in time order, ties in append order.

    The attributes of the runs come along; where they differ, the first run counts.
    """
    stores = [RecordStore(spark, path, resume=True) for path in runs]
    merged = RecordStore(spark, out)
    records = stores[0].records()
    for store in stores[1:]:
        records = records.unionByName(store.records())
    merged.append(records.orderBy("timestamp", "seq"))
    attributes: dict = {}
    for store in stores:
        for name, value in store.attributes().items():
            attributes.setdefault(name, value)
    if attributes:
        merged.write_metadata(**attributes)


def write_frames(rows: DataFrame, index: DataFrame, metadata: DataFrame, path: str, bucket: int = 1024, source: dict | None = None) -> None:
    """Frame rows in frame buckets, sorted inside, with index and metadata.

    ``source`` are the attributes of the run that was aggregated; the metadata
    repeats them, its own columns first.
    """
    metadata = metadata.withColumns({k: F.lit(v) for k, v in (source or {}).items() if k not in metadata.columns})
    bucketed = rows.withColumn("bucket", F.floor(F.col("frame_id") / bucket))
    ordered = bucketed.repartitionByRange("bucket", "frame_id", "node_from", "node_to").sortWithinPartitions(
        "bucket", "frame_id", "node_from", "node_to", "count_unique_first"
    )
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grouped_data")
    index.write.mode("overwrite").parquet(f"{path}/index")
    metadata.write.mode("overwrite").parquet(f"{path}/run_metadata")


def read_frame(spark: SparkSession, path: str, frame_id: int, bucket: int = 1024) -> DataFrame:
    """Rows of one frame: one partition folder, one row-group range."""
    rows = spark.read.parquet(f"{path}/grouped_data")
    return rows.where((F.col("bucket") == frame_id // bucket) & (F.col("frame_id") == frame_id)).drop("bucket")


# --- text files ----------------------------------------------------------------------------------

def read_flows(spark: SparkSession, path: str) -> DataFrame:
    flows = spark.read.schema(schemas.FLOWS).csv(path, header=True, quote='"', escape='"', enforceSchema=False)
    return flows.withColumn("count_devices", F.col("count_devices").cast("bigint"))


def write_od(od: DataFrame, path: str) -> None:
    od.select("id", "lat_from", "lon_from", "lat_to", "lon_to", "start_offset_s", "route_step_s", "log_step_s").write.mode(
        "overwrite"
    ).option("sep", ";").csv(path, header=True)


def read_od(spark: SparkSession, path: str, sep: str = ";", limit: int | None = None) -> DataFrame:
    """OD rows by header name; ``limit`` keeps the first rows of the file, in its order."""
    names = [c.split()[0] for c in schemas.OD_MATRIX.split(", ")]
    types = dict(c.split() for c in schemas.OD_MATRIX.split(", "))
    raw = spark.read.csv(path, header=True, sep=sep)
    if limit is not None:
        raw = _first_lines(raw, limit)
    # Whole numbers may be written as decimals; a decimal type keeps all their digits.
    via = {"bigint": "decimal(38,6)"}
    return raw.select(*[F.col(n).cast(via.get(types[n], "double")).cast(types[n]).alias(n) for n in names if n in raw.columns])


def _first_lines(raw: DataFrame, limit: int) -> DataFrame:
    """The first rows in file order: by file, block of the file, and place in the block."""
    placed = raw.withColumns({
        "__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()})
    return placed.orderBy("__file", "__block", "__at").limit(limit).drop("__file", "__block", "__at")


def read_routing_pairs(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """First ``limit`` rows of a comma file of vehicle, origin and destination, in its order."""
    rows = spark.read.schema("request_id bigint, origin bigint, dest bigint").csv(path, header=True)
    return _first_lines(rows, limit)


def read_rules(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Combination rules numbered in file order."""
    rules = spark.read.schema(schemas.RULES).csv(path, header=True, sep=sep, enforceSchema=False)
    return rules.withColumn("rule", F.monotonically_increasing_id())


def read_matrices(spark: SparkSession, paths: list[str], sep: str = ";") -> DataFrame:
    """OD matrices tagged with the path they came from, rows by id."""
    out = None
    for path in sorted(set(paths)):
        one = read_od(spark, path, sep).withColumns({"path": F.lit(path), "row": F.col("id")})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_restrictions(spark: SparkSession, path: str) -> DataFrame:
    """Temporary speeds; rows with fewer than five fields are skipped, unreadable values are errors."""
    columns = [c.split() for c in schemas.RESTRICTIONS.split(", ")]
    text = ", ".join(f"{name} string" for name, _ in columns)
    rows = spark.read.schema(text).csv(path, header=True, sep=";", enforceSchema=True).where("timestamp_to IS NOT NULL")

    def read(name: str, kind: str):
        value = F.trim(name)
        return F.to_timestamp_ntz(value, F.lit("yyyy-MM-dd HH:mm:ss")) if kind == "timestamp_ntz" else value.cast(kind)

    return rows.select(*[read(name, kind).alias(name) for name, kind in columns])


def write_text_table(df: DataFrame, path: str, order: str, sep: str = ";") -> None:
    """One ordered text file with a header; meant for report tables of one row per interval."""
    df.coalesce(1).sortWithinPartitions(order).drop(order).write.mode("overwrite").csv(path, header=True, sep=sep)


# --- road map ------------------------------------------------------------------------------------

def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and raw edges of a GraphML map in the form ``build_segments`` takes."""
    keys = {
        (r["_for"], r["_attr.name"]): r["_id"]
        for r in spark.read.format("xml").option("rowTag", "key").load(path).select("_for", "`_attr.name`", "_id").collect()
    }
    data = "data array<struct<_VALUE:string,_key:string>>"

    def value(kind: str, name: str):
        key = keys.get((kind, name))
        if key is None:
            return F.lit(None).cast("string")
        return F.get(F.filter("data", lambda d: d["_key"] == key), F.lit(0))["_VALUE"]

    def tags(name: str):
        """A tag as a list; several values are written as ``['a', 'b']``."""
        text = value("edge", name)
        listed = F.regexp_extract_all(text, F.lit(r"'([^']*)'"), 1)
        return F.when(text.startswith("["), listed).when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))

    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id bigint, {data}").load(path).select(
        F.col("_id").alias("node_id"), value("node", "x").cast("double").alias("lon"), value("node", "y").cast("double").alias("lat")
    )
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source bigint, _target bigint, _id int, {data}").load(path)
    edges = edges.select(
        F.col("_source").alias("node_from"), F.col("_target").alias("node_to"), F.coalesce("_id", F.lit(0)).alias("edge_key"),
        value("edge", "length").cast("double").alias("length"),
        F.nullif(F.regexp_extract(value("edge", "maxspeed"), r"(\d+)", 1), F.lit("")).cast("double").alias("maxspeed"),
        F.coalesce(F.get(tags("highway"), F.lit(0)), F.lit("unknown")).alias("highway"),
        value("edge", "junction").alias("junction"), tags("lanes").alias("lane_tags"),
        (F.lower(F.coalesce(value("edge", "oneway"), F.lit("false"))) == "true").alias("oneway"),
    )
    return nodes, edges


def write_graphml(nodes: DataFrame, segments: DataFrame, path: str) -> None:
    """A map as GraphML: text parts that make up one document in the order of their names.

    ``nodes(node_id, lon, lat)``, ``segments(node_from, node_to, length_m,
    max_speed_kph, lanes, highway)``; ``read_graphml`` reads the folder back.
    """
    keys = [("node", "y", "double"), ("node", "x", "double"), ("edge", "length", "double"), ("edge", "maxspeed", "string"),
            ("edge", "lanes", "string"), ("edge", "highway", "string"), ("edge", "oneway", "string")]
    numbers = {(kind, name): f"d{n}" for n, (kind, name, _) in enumerate(keys)}
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{numbers[kind, name]}" for="{kind}" attr.name="{name}" attr.type="{value}"/>' for kind, name, value in keys]
    head.append('<graph edgedefault="directed">')

    def data(kind: str, name: str, value: F.Column):
        text = value.cast("string")
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(sign), F.lit(entity))
        return F.when(value.isNotNull(), F.concat(F.lit(f'<data key="{numbers[kind, name]}">'), text, F.lit("</data>"))).otherwise(F.lit(""))

    spark = nodes.sparkSession
    edge = [data("edge", "length", F.col("length_m").cast("double")), data("edge", "maxspeed", F.col("max_speed_kph")),
            data("edge", "lanes", F.col("lanes")), data("edge", "highway", F.col("highway")), data("edge", "oneway", F.lit("True"))]
    frame = spark.createDataFrame([(0, n, 0, line) for n, line in enumerate(head)] + [(3, 0, 0, "</graph></graphml>")], "part int, a long, b long, value string")
    node_lines = nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(
        F.lit('<node id="'), F.col("node_id").cast("string"), F.lit('">'), data("node", "y", F.col("lat")), data("node", "x", F.col("lon")), F.lit("</node>")).alias("value"))
    edge_lines = segments.select(F.lit(2).alias("part"), F.col("node_from").alias("a"), F.col("node_to").alias("b"), F.concat(
        F.lit('<edge source="'), F.col("node_from").cast("string"), F.lit('" target="'), F.col("node_to").cast("string"), F.lit('" id="0">'), *edge, F.lit("</edge>")).alias("value"))
    frame.union(node_lines).union(edge_lines).orderBy("part", "a", "b").select("value").write.mode("errorifexists").text(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Weekly speed profiles of segments, checked for completeness."""
    return check_profiles(spark.read.schema(schemas.PROFILES).parquet(path))


def check_profiles(profiles: DataFrame) -> DataFrame:
    """Weekly speed profiles must have one entry per quarter hour."""
    ok = F.size("profiles") == schemas.PROFILE_SLOTS
    return profiles.withColumn("profiles", F.when(ok, F.col("profiles")).otherwise(
        F.raise_error(F.lit(f"a profile needs {schemas.PROFILE_SLOTS} entries"))
    ))
