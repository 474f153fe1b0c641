"""Intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session that names none, as in tests, gets a new temporary one, on a cluster that is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def session_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is removed when the driver's process ends."""
    path = f"{shared_folder(spark)}/lodestone-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders[path] = file_system(spark, path)
    return path


@atexit.register
def _remove() -> None:
    for system, path in _folders.values():
        with contextlib.suppress(Exception):  # the JVM may be gone already
            system.delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends, and the planner sees its true size.

    (A checkpoint keeps the estimate of the plan that made it, which grows with each join of an iteration.)
    """
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_in_place(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: rows stay in their partitions and their order."""
    df.sparkSession.sparkContext.setCheckpointDir(session_folder(df.sparkSession))
    return df.checkpoint()
