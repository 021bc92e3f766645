"""The corpus pipeline: from raw documents to packed context windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``.  All stages but the last return the columns of ``documents``.

1. quality_classifier: documents that a model of the ``labels`` table rejects go.
2. exact_dedup: of equal texts the smallest id stays.
3. near_dedup: of each group of near duplicates the smallest id stays.
4. decontaminate: documents that share a passage with ``benchmark`` go.
5. best_fit_packing: what is left, as pieces of context windows.

An empty table passes through every stage as an empty table; the cases of nulls, empty texts, ties and repeated
rows are those of the operators (see their docstrings).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from loomtext.llm.runtime import Scratch

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("best_fit_packing", packing.stage),
]

#: Two stages (a trained classifier, MinHash) can't be stated in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage and those before it wrote is deleted once its own result is there."""
    docs, older = spark.read.parquet(f"{sf_dir}/documents.parquet"), list(Scratch.live)
    for name, stage in STAGES:
        made = Scratch(spark, f"pipeline-{name}")
        docs = made.table(stage(spark, docs, sf_dir), name)
        for scratch in [s for s in Scratch.live if s is not made and s not in older]:
            scratch.drop()
    return docs
