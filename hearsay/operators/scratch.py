"""Where intermediate tables and checkpoints go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a single-machine session may leave it unset; the JVM's temporary folder serves then. On a
    cluster each executor would write to its own disk, so an unset folder is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured or current:
        return configured or current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = spark.sparkContext._jvm.java.lang.System.getProperty("java.io.tmpdir")
    folder = f"file://{base.rstrip('/')}/hearsay-{uuid.uuid4().hex}"
    delete_on_exit(spark, folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the file system drop ``path`` when the session's JVM ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; zstd keeps it small.

    Later plans read the files, so they all see the same rows and survive lost executors; the files
    go when the session ends.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that later readers all see the same partitions."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
