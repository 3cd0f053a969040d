"""Orders over whole tables without a window over whole tables: running totals, islands, layouts and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of one bucket of a dense integer key.
BUCKET = 1 << 14


def running_total(df: DataFrame, key: str, value: str, out: str = "before", bucket: int = BUCKET) -> DataFrame:
    """Adds the sum of ``value`` over all rows of smaller ``key`` (a unique integer).

    Rows are summed within buckets of the key; only bucket totals, one row per bucket,
    meet in a single window, so no task sees more than a bucket or the totals.
    """
    rows = df.withColumn("_b", F.floor(F.col(key) / bucket).cast("long"))
    totals = rows.groupBy("_b").agg(F.sum(value).alias("_t"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_b", F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_s"))
    inside = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(totals, "_b").withColumn(out, (F.col("_s") + F.col("_i")).cast("long")).drop("_b", "_i", "_s")


def neighbours(df: DataFrame, key: str, columns: dict[str, Column], bucket: int = BUCKET) -> DataFrame:
    """Adds columns of the row before in the order of a unique integer key, without a global window.

    The row before is in the same bucket, or it is the last of an earlier bucket; those
    lasts are one row per bucket.
    """
    rows = df.withColumn("_b", F.floor(F.col(key) / bucket).cast("long")).withColumn("_v", F.struct(*[c.alias(n) for n, c in columns.items()]))
    lasts = rows.groupBy("_b").agg(F.max_by("_v", key).alias("_l"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b")
    lasts = lasts.select("_b", F.lag("_l").over(before).alias("_l"))
    inside = F.lag("_v").over(Window.partitionBy("_b").orderBy(key))
    rows = rows.withColumn("_p", inside).join(lasts, "_b").withColumn("_p", F.coalesce("_p", "_l"))
    return rows.select(*df.columns, *[F.col(f"_p.{n}").alias(n) for n in columns])


def islands(df: DataFrame, key: str, bucket: int = BUCKET) -> DataFrame:
    """Runs (first, count) of consecutive distinct integers."""
    rows = df.select(key).distinct()
    starts = neighbours(rows, key, {"_prev": F.col(key)}, bucket).select(key, F.when(F.col("_prev") == F.col(key) - 1, 0).otherwise(1).cast("long").alias("_new"))
    counted = running_total(starts, key, "_new", "_before", bucket).withColumn("_run", F.col("_before") + F.col("_new"))
    return counted.groupBy("_run").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("count")).drop("_run")


def range_lookup(probes: DataFrame, intervals: DataFrame, point: str, begin: str, end: str, width: int) -> DataFrame:
    """Probes joined to the interval [begin, end) that holds their point.

    An interval is listed in every bucket it touches, so the join is an equi-join on
    buckets with the bounds as a residual condition.
    """
    listed = intervals.where(F.col(end) > F.col(begin)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width))))
    asked = probes.withColumn("_b", F.floor(F.col(point) / width))
    return asked.join(listed, "_b").where((F.col(point) >= F.col(begin)) & (F.col(point) < F.col(end))).drop("_b")


def layout_findings(entries: DataFrame, ord_: str, off: str, nbytes: str, total: Column | None = None) -> DataFrame:
    """Entries that are empty or don't start where the one before ends."""
    seen = neighbours(entries, ord_, {"_end": F.col(off) + F.col(nbytes)})
    kind = F.when(F.col(nbytes) <= 0, "empty").when(F.col("_end").isNotNull() & (F.col(off) > F.col("_end")), "gap").when(F.col("_end").isNotNull() & (F.col(off) < F.col("_end")), "overlap")
    return seen.withColumn("finding", kind).where("finding is not null").withColumnRenamed("_end", "expected")
