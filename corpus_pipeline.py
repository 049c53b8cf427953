"""The corpus pipeline: language identification, line dedup, near duplicates, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from resonant.llm import stages
from resonant.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", stages.identify_language),
    ("line_dedup", stages.drop_boilerplate_lines),
    ("ngram_jaccard_join", stages.one_of_each_group),
    ("decontamination", stages.remove_benchmark),
    ("best_fit_packing", stages.pack_sequences),
]

#: Language identification and packing can't be expressed in SQL; the stages are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
