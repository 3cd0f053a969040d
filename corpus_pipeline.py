"""The training-data pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. ``run`` writes each stage's rows as Parquet in the shared
folder and reads them back as the next stage's input.

Edge cases are those of the operators; in particular a null text is rejected or kept as
an empty one is, repeated rows survive line dedup and decontamination as often as they
come, ties between near duplicates go to the smallest id, extra columns are carried up to the
last stage whatever their names, and an empty table passes through every stage as an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, lines, ngram_join, packing, quality
from tessera.llm.common import delete, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines; documents of which nothing is left go."""
    return lines.dedup_lines(docs, drop_emptied=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return ngram_join.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items; the others as they are."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer can't be written in SQL; a test compares with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            # Its successor is written; only the last stage's rows stay.
            delete(spark, before)
        before = path
    return docs
