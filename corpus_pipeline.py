"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import drop_scratch, materialize, table
from sparkloom.llm.jaccard import jaccard_stage
from sparkloom.llm.mixing import mixing_stage
from sparkloom.llm.packing import packing_stage
from sparkloom.llm.pii import pii_stage
from sparkloom.llm.quality import quality_stage

STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", jaccard_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Keyed permutations, digests of token ids and packing can't be told in SQL; tests/llm holds the stages to brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = materialize(stage(spark, docs, sf_dir))
        if last:
            drop_scratch(spark, last)
        last = path
    return docs
