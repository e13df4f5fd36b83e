"""The corpus pipeline: five stages over ``documents``, each written as Parquet and
read again as the next one's input.

1. ``quality``: documents that the base rules or the perplexity bands reject go.
2. ``near_dedup``: of each class of near duplicates the document of the smallest
   id stays.
3. ``decontamination``: benchmark passages are cut out of the texts; a document
   that is mostly benchmark goes.
4. ``secrets``: found secrets are masked.
5. ``sentencepiece``: every document's sampled segmentations.

Every stage but the last returns the columns it got, in their order, and passes
columns it doesn't know unchanged, whatever their names. Null and empty texts are
rejected by stage 1 (they have fewer words than its rule asks for); repeated rows
of a document share their fate in stage 2 and are treated row by row elsewhere; an
empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefspark.llm import decontam, neardup, quality, secrets, subword
from prefspark.llm.common import prepare, saved, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_docs(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return subword.encode(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Models, sketches and sampling: no stage but the third could be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
