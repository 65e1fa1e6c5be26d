"""Drive a stream over what is there and return its output as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.sources import shared


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's shared checkpoint folder; a local one only in local mode, where none is set."""
    return shared.folder(spark, "stream")


def available_now(stream: DataFrame, mode: str) -> DataFrame:
    """All that the stream gives for the input present now; batches are appended to Parquet in the shared folder.

    Each batch has a folder named by its epoch, so a replayed batch overwrites itself.
    """
    spark = stream.sparkSession
    path = shared_folder(spark)
    stateful = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    query = stateful.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
