"""Tables and folders that driver and executors share, below the session's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str = "table") -> str:
    """A new path below the checkpoint folder: the one that is set for the context, else spark.checkpoint.dir.

    Where neither is set a local folder is made, but only in local mode: on a cluster executors would write to their own
    disks, so there it is an error.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    base = held.get() if held.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="factloom")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a shared folder: read back without its lineage, with the same rows after any executor's loss."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of whatever store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
