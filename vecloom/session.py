"""Shared folder for iterative jobs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session with a local master may leave it unset; a temporary folder is then made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share (master is {master})")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of any Hadoop file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/vecloom-{name}-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _tables:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes tables from save() that no plan needs any more; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "scratch", None) if df is not None else None
        if path:
            delete_path(df.sparkSession, path)
