"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: The white space that separates words: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set and all runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if folder:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir("file://" + os.path.abspath(made))
    return jsc.getCheckpointDir().get()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system, if the session still runs."""
    context = spark.sparkContext
    if context._jsc is not None and context._gateway is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder in the shared one; it goes when the program ends, since results are read from it until then."""
    folder = f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(remove_folder, spark, folder)
    return folder


_KEPT: dict = {}


def kept(key, make):
    """What a worker has made for a key; it keeps one such thing at a time, so that no stage holds the memory of another."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Give back what a worker has kept for an earlier stage."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def trim() -> None:
    """Give memory that a worker has freed back to the machine at the end of a task, where the C library can; workers outlive their stages."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def small(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has so few rows; df must be cheap to count."""
    return F.broadcast(df) if df.count() <= most else df


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there: computed once, safe against lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, names: list[str]) -> DataFrame:
    """df's columns under the names c0, c1, ..., so that none can clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])


def renamed(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """Numbered columns under their own names again, and more columns."""
    return df.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], *more)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
