"""Tables staged in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_to_delete: list[tuple[SparkSession, str, int]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and Spark runs on one machine (``local``) a temporary folder is made, once per application.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="folioflow-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/folioflow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _to_delete.append((spark, path, threading.get_ident()))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path with Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path, _ in _to_delete:
        try:
            if spark.sparkContext._jsc is None:
                return
            delete(spark, path)
        except Exception:  # the session may have ended before the process
            return


def made() -> list[str]:
    """Paths handed out so far to this thread, in order."""
    return [path for _, path, thread in _to_delete if thread == threading.get_ident()]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage and survives lost executors: nothing of it lives on an executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Drop a table made by :func:`stage` that nothing reads any more."""
    if path := getattr(df, "_staged_at", None):
        delete(df.sparkSession, path)
