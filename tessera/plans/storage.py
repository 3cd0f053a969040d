"""Queries that report on storage and service: ratios, rollups, percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.session import table


@query("""
WITH g AS (SELECT l_returnflag, sum(round(l_extendedprice * 100)::BIGINT) AS full_bytes, sum(round(l_extendedprice * l_discount * 100)::BIGINT) AS delta_bytes FROM lineitem GROUP BY 1)
SELECT l_returnflag, full_bytes::BIGINT AS full_bytes, delta_bytes::BIGINT AS delta_bytes, round(CASE WHEN full_bytes = 0 THEN 0 ELSE delta_bytes::DOUBLE / full_bytes END, 6) AS ratio FROM g
""")
def encode_ratio(spark, sf_dir):
    cents = lambda c: F.sum(F.round(c * 100).cast("long"))
    price = F.col("l_extendedprice")
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(cents(price).alias("full_bytes"), cents(price * F.col("l_discount")).alias("delta_bytes"))
    return g.withColumn("ratio", F.round(F.coalesce(F.try_divide("delta_bytes", "full_bytes"), F.lit(0.0)), 6))


@query("""
SELECT coalesce(o_orderstatus, '') AS kind, coalesce(o_orderpriority, '') AS mode, grouping(o_orderstatus)::INT AS all_kinds, grouping(o_orderpriority)::INT AS all_modes, count(*)::BIGINT AS objects,
       sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS nbytes FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
""")
def storage_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(
        F.grouping("o_orderstatus").cast("int").alias("all_kinds"), F.grouping("o_orderpriority").cast("int").alias("all_modes"),
        F.count(F.lit(1)).alias("objects"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("nbytes"),
    )
    return rows.select(F.coalesce("o_orderstatus", F.lit("")).alias("kind"), F.coalesce("o_orderpriority", F.lit("")).alias("mode"), "all_kinds", "all_modes", "objects", "nbytes")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.99), 4) AS p99, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.99)))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p.alias("p"), F.count(F.lit(1)).alias("n")).select("event_type", F.round(F.col("p")[0], 4).alias("p50"), F.round(F.col("p")[1], 4).alias("p99"), "n")


@query("SELECT l_linestatus, count(*) FILTER (l_discount > 0.05)::BIGINT AS deltas, count(*)::BIGINT AS entries, max(l_linenumber) AS depth FROM lineitem GROUP BY l_linestatus")
def delta_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count_if(F.col("l_discount") > 0.05).alias("deltas"), F.count(F.lit(1)).alias("entries"), F.max("l_linenumber").alias("depth"))


@query("SELECT to_json({'click': count(*) FILTER (event_type = 'click'), 'error': count(*) FILTER (event_type = 'error'), 'view': count(*) FILTER (event_type = 'view')})::VARCHAR AS counters FROM events")
def daemon_counters(spark, sf_dir):
    """Service counters as one JSON document."""
    n = lambda e: F.count_if(F.col("event_type") == e).alias(e)
    return table(spark, sf_dir, "events").agg(n("click"), n("error"), n("view")).select(F.to_json(F.struct("click", "error", "view")).alias("counters"))
