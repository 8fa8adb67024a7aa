"""Cutting lineage: rows written to the shared checkpoint folder are computed once and survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed and checkpointed. The folder is spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine, as in tests."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            made = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            folder = "file://" + os.path.abspath(made)
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
