"""Raw documents to token files, in five stages, each one an operator of ``lorespark.llm``.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
between stages the documents are written as Parquet and read again. All stages but
the last return the columns of ``documents``. A quality model learns from the labels
in ``sf_dir``; every text is scored by it, and documents it rejects go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import decontam, mixing, neardup_text, quality, tokenbin
from lorespark.llm.common import remainder, store
from lorespark.llm.queries import table, tokenizer_path

#: Documents that score less are rejected.
LEAST_QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score is at least ``LEAST_QUALITY``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    return quality.score(docs, model, name="_quality").filter(F.col("_quality") >= LEAST_QUALITY).drop("_quality")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, that with the smallest id."""
    return neardup_text.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no item of ``benchmark`` and no edited copy of one."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents as token files and returns what the files hold of each."""
    return tokenbin.token_report(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Trained scores, signatures and tokens have no SQL; ``tests/llm`` holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
