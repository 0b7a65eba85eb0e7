"""Tables that cut lineage: written in the folder that driver and executors share, read back, deleted when nothing needs them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new folder of our own where it is unset and everything runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as Hadoop's."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        try:
            system, hadoop = file_system(spark, path)
            system.delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session is gone already; only disk space is at stake
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/textmill/{name}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def written(df: DataFrame, name: str, into: list[str] | None = None) -> DataFrame:
    """df written as Parquet and read back; its path is added to `into`, for whoever drops it earlier."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    if into is not None:
        into.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
