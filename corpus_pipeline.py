"""A corpus pipeline: each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paraloom.llm import language_id, line_dedup, mixing, packing, simhash
from paraloom.llm.common import read_table, remove_folder, scratch_folder

STAGES = [
    ("language ID", language_id.stage),
    ("line dedup", line_dedup.stage),
    ("SimHash near-dedup", simhash.stage),
    ("mixing sources to target weights", mixing.stage),
    ("best-fit packing", packing.stage),
]

#: Language ID and tokenising cannot be written in SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet to the shared folder and read again; what is read no more is deleted."""
    docs, folder = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            last, folder = folder, scratch_folder(spark, "pipeline-" + name.replace(" ", "-"))
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
            if last:
                remove_folder(spark, last)
    return docs
