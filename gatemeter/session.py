"""Session and table helpers shared by all parts of the package."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a plain scan, dealt to all cores where it has fewer splits than there are cores.

    A file is read by as many tasks as it has row groups; work on long texts then stays on one
    core. Scans of many splits are left as they are, so large inputs aren't shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system, if the session still stands."""
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh_folder(spark: SparkSession) -> str:
    """A new name in the shared folder for files that results read; it goes when the program ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    atexit.register(delete_folder, spark, path)
    return path
