"""Samples that arrive as files: each micro-batch of region counts is called with the same plan as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def follow(spark: SparkSession, folder: str, schema: str, call: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True):
    """Call every new file of a folder and append the rows to a Parquet table; with `once`, stop when what is there is done.

    A batch that is run again after a failure replaces its own files: each is written to a folder of its number.
    """
    source = spark.readStream.schema(schema).parquet(folder)
    write = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, k: call(batch).write.mode("overwrite").parquet(f"{out}/batch={k}"))
    return (write.trigger(availableNow=True) if once else write).start()
