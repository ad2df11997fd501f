"""Where intermediate tables and streaming checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where all tasks run in this JVM."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="skimmer-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession) -> str:
    """A new path there; the folder goes when the JVM ends."""
    path = f"{scratch_root(spark)}/skimmer-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def scratch(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and what follows computes it once."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
