"""Clean a corpus and deal it out by target weights, one written stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reachspark.llm import decontaminate, mixing, simhash, substring, toxicity
from reachspark.llm.common import Scratch

#: (name, function of (spark, docs, sf_dir)); each reads what the one before it wrote.
STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash_near_dedup", simhash.stage),
    ("substring_dedup", substring.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("mixing_to_target_weights", mixing.stage),
]

#: The first stage's classifier can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
