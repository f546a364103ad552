"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.bpe import stage_bpe
from inkwell.llm.mixing import stage_mix
from inkwell.llm.secrets import stage_secrets
from inkwell.llm.shared import table, written
from inkwell.llm.simhash import stage_simhash
from inkwell.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_simhash),
    ("secrets", stage_secrets),
    ("mixing", stage_mix),
    ("byte_bpe", stage_bpe),
]

#: A fitted classifier, fingerprints and merges are not SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
