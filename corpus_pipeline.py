"""A corpus pipeline: five stages over documents, each written and read again.

Defined results, whatever the stage: a null or empty text is not toxic, links with no
other, holds no benchmark item, and is left out by the mix (no words are drawn of it);
rows with a null doc_id, rows that repeat an id and rows that repeat wholly are rows of
their own, told apart by their texts (of wholly repeated ones the n-gram join keeps one);
ties go to the least doc_id; texts of any length are taken whole; without labelled rows of
both classes nothing is rejected as toxic; an empty table goes through as an empty table;
columns beside those of documents are kept, but columns called size, shard or slot give
way to those of the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import decontamination, mixing, ngram_join, sharding, toxicity
from textquarry.llm.common import remove, scratch_path, swept

STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard", ngram_join.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: Trained scores and pseudorandom draws are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in order."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
