"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, in a folder of this application.

    A session without one gets an error, since a folder of the driver's
    machine is of no use to executors; only a local session, whose executors
    are the driver, may go without and uses a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillgrid-")
        spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/quillgrid/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path of ``new_path`` and nothing lazy reads any more."""
    _delete(spark, path)


def _tidy(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        _delete(spark, path)


def new_path(spark: SparkSession) -> str:
    """A new table's path. The application's folder goes when the driver's Python ends; until then results may be read lazily."""
    where = shared_dir(spark)
    if where not in _HELD:
        _HELD.add(where)
        atexit.register(_tidy, spark, where)
    return f"{where}/{uuid.uuid4().hex}"


_HELD: set[str] = set()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage.

    A lost executor costs nothing that is already written: the table lives in
    the shared folder, not on executors.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._quillgrid_path = path
    return held


def release(df: DataFrame | None) -> None:
    """Delete a table that ``materialise`` wrote and that nothing lazy reads any more."""
    if path := getattr(df, "_quillgrid_path", None):
        _delete(df.sparkSession, path)
