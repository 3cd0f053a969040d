"""Helpers that the training-data operators share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialise, partitions, scratch, table  # noqa: F401


def utf8(column: str = "text"):
    """A string column as its UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def crc_fold(column: str = "doc_id"):
    """crc32 of an id written as text, modulo 3."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker does."""
    return sys.modules.setdefault("_tessera_worker_cache", types.ModuleType("_tessera_worker_cache")).__dict__


def masked(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed c0, c1, ..., so that no helper column can clash, and the real names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df`` written in buckets of ``key`` in the shared folder; joins and groups by that key don't move it again."""
    spark = df.sparkSession
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", f"{scratch(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def drop_bucketed(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE {name}")
    delete(spark, f"{scratch(spark)}/{name}")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate files, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
