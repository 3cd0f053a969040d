"""Line deduplication by distinct-site spread, in DataFrame operations only.

A line that stands on many different sites is boilerplate. Lines are hashed; those
that occur often enough to matter get a HyperLogLog sketch of their sites, built by
partial aggregation and merged by hash. Where the estimate is clearly on one side of
the limit it decides; near the limit the distinct sites are counted exactly. Each
boilerplate line stays at its first place in the corpus (the smallest doc_id, then
the first position) and is removed everywhere else.

The limit is lower for long lines: chance doesn't repeat a passage of 50 words or more on three
sites. Repetition within one site is no spread, however often the line stands there.

A line is compared without the blanks, tabs and carriage returns around it, by a
128-bit hash; lines shorter than ``min_chars`` characters are never boilerplate.

Edge cases: a null text has no lines and is returned as it is; a null source is one
site of its own; rows equal in id and text are one document and keep the same
lines; null ids come last in the order of places; an empty table gives no rows;
other columns are carried unchanged; very long texts and lines are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import masked, materialise, table

MIN_SITES = 6
#: The limit for lines of so many words or more.
LONG_SITES, LONG_WORDS = 3, 50
MIN_CHARS = 20
#: log2 of the sketch's buckets; its standard error is about 0.8 / sqrt(2^12).
LOG_BUCKETS = 12
#: Estimates within this share of the limit are counted exactly: over five standard errors.
NEAR = 0.08


def stripped(line):
    return F.trim(line, F.lit(" \t\r"))


def _limit(line, min_sites: int):
    """Distinct sites that make a line boilerplate; words are only counted where there may be enough."""
    words = F.when(F.char_length(line) >= 2 * LONG_WORDS - 1, F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")))
    return F.when(words >= LONG_WORDS, F.lit(min(min_sites, LONG_SITES))).otherwise(F.lit(min_sites))


def _lines(rows: DataFrame, text: str, id_: str, site: str, min_sites: int, min_chars: int) -> DataFrame:
    """One narrow row per eligible line: document key, id, site hash, position, line hash and its limit."""
    described = lambda x: F.struct(F.unhex(F.md5(x.cast("binary"))).alias("h"), _limit(x, min_sites).alias("m"))
    lines = F.posexplode(F.transform(F.split(F.col(text), "\n", -1), lambda x: F.when(F.char_length(stripped(x)) >= min_chars, described(stripped(x)))))
    found = rows.where(F.col(text).isNotNull()).select("_key", F.col(id_).alias("_id"), F.col(site).alias("_site"), lines.alias("_pos", "_x")).where(F.col("_x").isNotNull())
    return found.select("_key", "_id", "_site", "_pos", F.col("_x.h").alias("_line"), F.col("_x.m").alias("_min"))


def boilerplate(lines: DataFrame) -> DataFrame:
    """The line hashes with at least ``_min`` distinct sites."""
    often = lines.groupBy("_line").agg(F.count(F.lit(1)).alias("_n"), F.min("_min").alias("_min"), F.min("_site").alias("_lo"), F.max("_site").alias("_hi"))
    # Written tables on both sides of a join by line, and nothing by line above it: only so can a hot line be split.
    often = materialise(often.where((F.col("_n") >= F.col("_min")) & ((F.col("_min") <= 1) | (F.col("_lo") != F.col("_hi")))).select("_line"))
    candidates = materialise(lines.join(often, "_line", "left_semi").select("_line", "_site", "_min"))
    sketched = materialise(candidates.groupBy("_line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", LOG_BUCKETS)).alias("_e"), F.min("_min").alias("_min")))
    near = F.abs(F.col("_e") - F.col("_min")) <= F.greatest(F.lit(1.0), F.lit(NEAR) * F.col("_min"))
    sure = sketched.where(~near & (F.col("_e") >= F.col("_min"))).select("_line")
    unsure = sketched.where(near).select("_line")
    exact = materialise(candidates.join(unsure, "_line", "left_semi")).distinct().groupBy("_line").agg(F.count(F.lit(1)).alias("_n"), F.min("_min").alias("_min"))
    return sure.unionByName(exact.where(F.col("_n") >= F.col("_min")).select("_line"))


def removals(rows: DataFrame, text: str, id_: str, site: str, min_sites: int, min_chars: int) -> DataFrame:
    """``_key`` of every document that loses lines, with the array ``_gone`` of their positions from 0."""
    lines = materialise(_lines(rows, text, id_, site, min_sites, min_chars))
    spread = materialise(boilerplate(lines))
    places = materialise(lines.join(spread, "_line"))
    # First place: null ids last, then by id, key and position.
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_key").alias("k"), F.col("_pos").alias("p"))
    first = places.groupBy("_line").agg(F.min(order).alias("_first")).select("_line", F.col("_first.k").alias("_k1"), F.col("_first.p").alias("_p1"))
    gone = places.join(materialise(first), "_line").where((F.col("_key") != F.col("_k1")) | (F.col("_pos") != F.col("_p1")))
    return gone.groupBy("_key").agg(F.collect_set("_pos").alias("_gone"))


def dedup_lines(docs: DataFrame, *, text: str = "text", id_: str = "doc_id", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, count: bool = False, drop_emptied: bool = False) -> DataFrame:
    """The documents with boilerplate lines removed; with ``count``, also n_lines and n_removed.

    ``drop_emptied`` drops the documents that lost lines and have only blanks left.
    """
    hidden, names = masked(docs)
    at = {n: f"c{i}" for i, n in enumerate(names)}
    named = F.concat(F.coalesce(F.concat(F.lit("="), F.col(at[id_]).cast("string")), F.lit("null")), F.lit("\n"), F.coalesce(F.col(at[text]), F.lit("")))
    rows = hidden.withColumn("_key", F.unhex(F.md5(named.cast("binary"))))
    sited = rows.withColumn("_s", F.xxhash64(F.col(at[site]).isNull(), F.col(at[site])))
    gone = removals(sited, at[text], at[id_], "_s", min_sites, min_chars)
    out = rows.join(gone, "_key", "left")
    kept = F.expr(f"array_join(filter(split({at[text]}, '\\n', -1), (x, i) -> not array_contains(_gone, i)), '\\n')")
    out = out.withColumn("_text", F.when(F.col("_gone").isNull(), F.col(at[text])).otherwise(kept))
    if drop_emptied:
        out = out.where(F.col("_gone").isNull() | F.col("_text").rlike("\\S"))
    columns = [F.col("_text").alias(c) if c == at[text] else F.col(c) for c in hidden.columns]
    if not count:
        return out.select(*columns).toDF(*names)
    n_lines = F.coalesce(F.size(F.split(F.col(at[text]), "\n", -1)), F.lit(0)).cast("long")
    n_lines = F.when(F.col(at[text]).isNull(), F.lit(0).cast("long")).otherwise(n_lines)
    n_gone = F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long")
    return out.select(*columns, n_lines.alias("_a"), n_gone.alias("_b")).toDF(*names, "n_lines", "n_removed")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = dedup_lines(docs, count=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL
), e AS (SELECT doc_id, coalesce(source, '') AS site, source IS NULL AS nosite, pos, trim(line, ' ' || chr(9) || chr(13)) AS s FROM l),
spread AS (
  SELECT s, min(doc_id) AS d1 FROM e WHERE length(s) >= 20 GROUP BY s HAVING count(DISTINCT (site, nosite)) >= CASE WHEN len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) >= 50 THEN 3 ELSE 6 END
), first_place AS (SELECT e.s, d1, min(pos) AS p1 FROM e JOIN spread ON e.s = spread.s AND e.doc_id = d1 GROUP BY e.s, d1),
marked AS (
  SELECT l.doc_id, l.pos, l.line, f.s IS NOT NULL AND NOT (l.doc_id = f.d1 AND l.pos = f.p1) AS gone
  FROM l LEFT JOIN first_place f ON trim(l.line, ' ' || chr(9) || chr(13)) = f.s
), g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""
