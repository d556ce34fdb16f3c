"""Session settings and lineage control."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "roadflow", master: str | None = None, cores: int | None = None) -> SparkSession:
    """Create a session with the settings the package relies on.

    On a cluster the submit command sets the master and the partition count;
    the local values here only serve tests and the bench.
    """
    builder = SparkSession.builder.appName(app)
    if master or cores:
        builder = builder.master(master or f"local[{cores}]")
    if cores:
        builder = builder.config("spark.sql.shuffle.partitions", str(cores))
        builder = builder.config("spark.driver.memory", os.environ.get("ROADFLOW_DRIVER_MEMORY", "8g"))
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables.

    Where driver and executors are one process, and only there, a scratch folder
    stands in for one that isn't set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="roadflow-")
        context.setCheckpointDir(named)
    return named


_FOLDERS: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; removed when the driver ends in order."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_folder(spark).rstrip('/')}/roadflow-{app}"
        atexit.register(_remove_quietly, spark, _FOLDERS[app])
    return _FOLDERS[app]


def new_folder(spark: SparkSession) -> str:
    """A path not yet in use, in this application's part of the shared folder."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    except Exception:  # the session has gone already; whoever owns the folder clears it
        pass


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, not when the driver's garbage is collected; an iteration would pile them up."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later steps restart from the table, also after executors are lost.  A
    written table beats a checkpoint here: it is columnar, later steps read only
    the columns they use, and it carries no constraints of the plan behind it,
    which would grow with every round of an iteration.  ``replaces`` names an
    earlier result of this function that is no longer needed and is removed.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.roadflow_path = path
    if replaces is not None:
        discard(replaces)
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables written by ``cut_lineage``."""
    for table in tables:
        path = getattr(table, "roadflow_path", None)
        if path is not None:
            _remove(table.sparkSession, path)


def together(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema written by ``cut_lineage`` as one table, read in one scan."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*[t.roadflow_path for t in tables])
