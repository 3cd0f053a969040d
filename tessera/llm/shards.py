"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are put in a seeded random order within each source; the r-th of n rows has
the fractional rank (2r - 1) / 2n. All rows are then ordered by fractional rank and
that order is cut into equal runs, so every shard holds the sources in the mixture
of the whole table and the row counts of any two shards differ by one at most.

Both orders are found without a window over a whole source or table. Each is split
into ranges that are even by construction (ranges of a uniform hash within a source;
ranges of the fractional rank), a row's number within its range comes from a window
over that range, and running totals over the range counts give what stands before
it. A source with a third of all rows is dealt over as many ranges as the rest.

Edge cases: null sources are one stratum of their own; null ids and texts are
ordinary rows (a null text has no bytes); ties of the hash and repeated rows are
ordered by the remaining key columns, and rows equal in all of them are
interchangeable; very long texts are rows like any other; an empty table gives no rows; other columns are carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import masked, materialise, partitions, table

SEED = "tessera-shards"
SHARDS = 8
#: Rows that one range should hold at most, on average.
RANGE_ROWS = 100_000
SPAN = 1 << 60


def shuffled_key(*columns):
    """A uniform number below 2^60 that depends on the seed and the columns; null is its own value."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _numbered(df: DataFrame, within: list[str], ranges: str, order: list) -> DataFrame:
    """Adds ``_n``: the row's place, from 0, among the rows of ``within`` ordered by ranges, then order."""
    local = df.withColumn("_i", F.row_number().over(Window.partitionBy(*within, ranges).orderBy(*order)) - 1)
    sizes = df.groupBy(*within, ranges).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*within).orderBy(ranges).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0).cast("long"))).drop("_c")
    return local.join(starts, [*within, ranges]).withColumn("_n", F.col("_before") + F.col("_i")).drop("_i", "_before")


def interleave(docs: DataFrame, keys: list[str], source: str = "source", shards: int = SHARDS) -> DataFrame:
    """The columns of docs with shard (int, from 0) and slot (long, gapless from 0 in its shard).

    ``keys`` are the columns that the seeded order depends on.
    """
    hidden, names = masked(docs)
    at = {n: f"c{i}" for i, n in enumerate(names)}
    keys, source = [at[k] for k in keys], at[source]
    total = docs.count()
    ranges = max(4 * partitions(docs.sparkSession), -(-total // RANGE_ROWS))
    width = SPAN // ranges + 1
    rows = hidden.withColumns({
        "_stratum": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")),
        "_h": shuffled_key(*keys),
    }).withColumn("_range", F.expr(f"_h div {width}"))
    ranked = _numbered(rows, ["_stratum"], "_range", ["_h", *keys]).drop("_range")
    sizes = rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_size"))
    # The order of fractional ranks is an order of doubles; equal doubles are told apart by stratum.
    ranked = ranked.join(sizes, "_stratum").withColumn("_f", (2 * F.col("_n") + 1) / (2 * F.col("_size")))
    ranked = ranked.drop("_n").withColumn("_cut", F.floor(F.col("_f") * ranges)).withColumn("_all", F.lit(0))
    # This window runs over the ranges' counts, not over rows.
    placed = _numbered(ranked, ["_all"], "_cut", ["_f", "_stratum", "_h", *keys])
    placed = placed.withColumn("_shard", F.expr(f"cast(_n * {shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(_shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    kept = placed.select(*hidden.columns, F.col("_shard"), (F.col("_n") - first).alias("_slot"))
    return kept.toDF(*names, "shard", "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    # Several passes follow; the texts are read in the first only.
    return interleave(materialise(docs), ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The crc32 comes from its table of 256 values, which the first query derives from the polynomial.
ORACLE = """
WITH RECURSIVE crc_table(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_table WHERE k < 8
), t AS (SELECT list(c ORDER BY i) AS l FROM crc_table WHERE k = 8),
b AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
         list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents
), d AS (
  SELECT doc_id, size, coalesce('=' || source, 'null') AS stratum,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, l[(xor(a & 255, x) + 1)::INT])), 4294967295) AS crc
  FROM b, t
), h AS (
  SELECT *, ('0x' || substr(md5('tessera-shards|' || coalesce(doc_id::VARCHAR, '\\N') || '|' || crc || '|' || size), 1, 15))::BIGINT AS h FROM d
), r AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, crc, size) - 1) + 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS f FROM h
), p AS (
  SELECT *, row_number() OVER (ORDER BY f, stratum, h, doc_id, crc, size) - 1 AS n, count(*) OVER () AS total FROM r
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (n * 8 // total)::INT AS shard,
       (n - ((n * 8 // total) * total + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard
FROM p
"""
