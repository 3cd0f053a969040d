"""Manifests as tables: layout and group rules, chain depths, counts, and a bridge between two schemas.

A manifest is rows (file, seq, tensor, off, nbytes, group) of its buffer, rows (file, group,
mode, block, base, diff_block, chain_depth) of its groups and one row (file, total_bytes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAYOUT, BROKEN = "TensorNotInBufferLayout", "MalformedObject"


def findings(files: DataFrame, buffer: DataFrame, groups: DataFrame) -> DataFrame:
    """(file, kind, rule, object) of every rule that a manifest breaks.

    The window runs within one file's buffer, whose size is that of a header.
    """
    order = Window.partitionBy("file").orderBy("seq")
    rows = buffer.withColumn("_due", F.lag(F.col("off") + F.col("nbytes")).over(order)).withColumn("_last", F.lead("seq").over(order).isNull())
    named = groups.select("file", "group", F.lit(True).alias("_known"))
    rows = rows.join(named, ["file", "group"], "left")
    ends = rows.where("_last").select("file", (F.col("off") + F.col("nbytes")).alias("_end"))
    covered = files.join(ends, "file", "left")
    tensor, group = F.col("tensor").cast("string"), F.col("group").cast("string")
    out = [
        rows.where("off <> _due").select("file", F.lit(LAYOUT), F.lit("gap or overlap"), tensor),
        rows.where("nbytes = 0").select("file", F.lit(LAYOUT), F.lit("no bytes"), tensor),
        rows.where("_known is null").select("file", F.lit(BROKEN), F.lit("unknown group"), tensor),
        covered.where("_end is null").select("file", F.lit(BROKEN), F.lit("empty buffer"), F.lit("")),
        covered.where("_end <> total_bytes").select("file", F.lit(LAYOUT), F.lit("not covered"), F.lit("")),
        groups.where("mode = 'full' and block is null").select("file", F.lit(BROKEN), F.lit("full without block"), group),
        groups.where("mode = 'full' and chain_depth <> 0").select("file", F.lit(BROKEN), F.lit("full with depth"), group),
        groups.where("mode <> 'full' and (base is null or diff_block is null)").select("file", F.lit(BROKEN), F.lit("delta without base"), group),
    ]
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.toDF("file", "kind", "rule", "object")


def statistics(groups: DataFrame) -> DataFrame:
    """Per file: groups, how many are deltas, and the longest chain."""
    return groups.groupBy("file").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("mode") != "full").alias("deltas"), F.max("chain_depth").cast("long").alias("max_depth"))


def group_depths(members: DataFrame, base: DataFrame) -> DataFrame:
    """(group, depth): one more than the deepest base of a group's member tensors, 0 where none has a base."""
    return members.join(base, "tensor", "left").groupBy("group").agg(F.coalesce(F.max("depth") + 1, F.lit(0)).cast("long").alias("depth"))


def bridge(mine: DataFrame, other: DataFrame) -> DataFrame:
    """(group, other): groups of two schemas that bind an axis (tensor, dim) in common."""
    return mine.select("tensor", "dim", "group").join(other.select("tensor", "dim", F.col("group").alias("other")), ["tensor", "dim"]).select("group", "other").distinct()


def candidate_union(candidates: DataFrame, rows_per_chunk: int) -> DataFrame:
    """(chunk, j): the distinct candidate base units of every chunk of target units (i, j)."""
    return candidates.select(F.floor(F.col("i") / rows_per_chunk).alias("chunk"), "j").distinct()
