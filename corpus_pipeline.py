"""A corpus pipeline of five stages; each result is written as Parquet and read again as the next stage's documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weekloom.llm.decontaminate import decontaminate_stage
from weekloom.llm.linedup import line_dedup_stage
from weekloom.llm.neardup import near_dup_stage
from weekloom.llm.packing import packing_stage
from weekloom.llm.quality import quality_stage
from weekloom.llm.scratch import staged

STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near-duplicates", near_dup_stage),
    ("decontamination", decontaminate_stage),
    ("packing", packing_stage),
]

#: Near-duplicate candidates and best-fit packing can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
