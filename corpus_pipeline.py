"""Corpus pipeline: language, toxicity, near-duplicates, benchmark decontamination, then the mix of sources.

Each stage gets what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, decontam, langid, mixing, nearcopies, toxicity

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", langid.stage),
    ("toxicity", toxicity.stage),
    ("near_duplicates", nearcopies.stage),
    ("decontamination", decontam.stage),
    ("mixing", mixing.stage),
]

#: Learned models, components and draws are not expressible in SQL; see tests/llm for brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents that the stages keep. A stage's output is deleted once the next one is written.

    Each stage's docstring says what it makes of nulls, ties, repeated rows, long texts, extra columns and empty tables.
    """
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/corpus-{name}-{uuid.uuid4().hex}"
        common.store(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    return docs
