"""Queries on content identity, the object store, chunk digests and text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import identity as H
from tessera.operators import store as T
from tessera.plans.registry import query
from tessera.session import table

PAYLOAD = "WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS p, strlen(coalesce(text, '')) AS n FROM documents), o AS (SELECT doc_id, n, p, 's2:' || sha256(encode('tessera.raw ' || n) || '\\x00'::BLOB || p) AS oid FROM d) "


def payloads(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("payload"))


@query(PAYLOAD + "SELECT doc_id, oid, substr(oid, 4, 12) AS short, substr(oid, 4, 2) || '/' || substr(oid, 6, 62) AS path FROM o")
def framed_oid(spark, sf_dir):
    oid = H.object_id("raw", F.col("payload"))
    return payloads(spark, sf_dir).select("doc_id", oid.alias("oid")).select("doc_id", "oid", H.abbreviate(F.col("oid")).alias("short"), H.fanout_path(F.col("oid")).alias("path"))


@query("""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, n, h, unnest(range((n + 1023) // 1024)) AS chunk FROM d WHERE n > 0)
SELECT doc_id, chunk, least(1024, n - chunk * 1024)::BIGINT AS length, sha256(unhex(substr(h, (chunk * 2048)::INT + 1, 2048))) AS digest FROM c
""")
def chunk_digests(spark, sf_dir):
    return T.chunk_digests(payloads(spark, sf_dir), "doc_id", 1024)


@query(PAYLOAD + "SELECT oid, count(*)::BIGINT AS copies, min(doc_id) AS first_doc, any_value(n)::BIGINT AS nbytes FROM o GROUP BY oid")
def content_dedup(spark, sf_dir):
    named = payloads(spark, sf_dir).select("doc_id", F.octet_length("payload").cast("long").alias("nbytes"), H.object_id("raw", F.col("payload")).alias("oid"))
    return named.groupBy("oid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.first("nbytes").alias("nbytes"))


@query(PAYLOAD + "SELECT DISTINCT oid FROM o WHERE doc_id % 2 = 1 AND oid NOT IN (SELECT oid FROM o WHERE doc_id % 2 = 0)")
def put_if_absent(spark, sf_dir):
    """Objects of one batch that a store of another doesn't hold yet."""
    named = payloads(spark, sf_dir).select("doc_id", H.object_id("raw", F.col("payload")).alias("oid"))
    return T.absent(named.where("doc_id % 2 = 1").select("oid"), named.where("doc_id % 2 = 0").select("oid"))


@query(PAYLOAD + "SELECT doc_id, oid = CASE WHEN doc_id % 50 = 3 THEN 's2:' || repeat('0', 64) ELSE oid END AS intact FROM o")
def rehash_check(spark, sf_dir):
    """Stored ids against recomputed ones; every fiftieth id is planted wrong."""
    oid = H.object_id("raw", F.col("payload"))
    stored = F.when(F.col("doc_id") % 50 == 3, "s2:" + "0" * 64).otherwise(oid)
    return payloads(spark, sf_dir).select("doc_id", (oid == stored).alias("intact"))


@query("""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
r AS (SELECT doc_id, h, n, doc_id * 31 % 3000 AS off, 700 AS len FROM d)
SELECT doc_id, off, greatest(0, least(len, n - off))::BIGINT AS length, sha256(unhex(substr(h, off::INT * 2 + 1, 1400))) AS digest FROM r
""")
def range_read(spark, sf_dir):
    """Byte ranges of stored payloads, short at the end."""
    rows = payloads(spark, sf_dir).withColumn("off", F.col("doc_id") * 31 % 3000)
    part = F.substring(F.col("payload"), (F.col("off") + 1).cast("int"), F.lit(700))
    return rows.select("doc_id", "off", F.octet_length(part).cast("long").alias("length"), F.sha2(part, 256).alias("digest"))


@query("""
SELECT c_custkey, '{"author":"' || c_name || '","balance":' || round(c_acctbal * 100)::BIGINT || ',"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}' AS document,
       sha256('{"author":"' || c_name || '","balance":' || round(c_acctbal * 100)::BIGINT || ',"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}') AS digest
FROM customer
""")
def canonical_json(spark, sf_dir):
    """Fields in alphabetical order, no blanks."""
    fields = F.struct(F.col("c_name").alias("author"), F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(fields).alias("document")).withColumn("digest", F.sha2(F.col("document").cast("binary"), 256))


@query("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS ts FROM orders)
SELECT o_orderkey, ts, regexp_full_match(ts, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z') AS valid FROM t
""")
def timestamp_valid(spark, sf_dir):
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 10 == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("ts")).withColumn("valid", H.is_timestamp(F.col("ts")))


@query("""
WITH h AS (SELECT p_partkey, sha256(p_name || p_partkey) AS d FROM part),
t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 's2:' || upper(d) WHEN 1 THEN 's2:' || d WHEN 2 THEN 'x:' || d ELSE 's2:' || substr(d, 1, 60) END AS given,
             CASE WHEN p_partkey % 3 = 0 THEN 'objects/' || substr(d, 1, 2) || '/' || substr(d, 3) ELSE 'refs/' || d END AS path, d FROM h)
SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN 's2:' || d END AS parsed, CASE WHEN p_partkey % 3 = 0 THEN 's2:' || d END AS from_path FROM t
""")
def oid_parse(spark, sf_dir):
    d = F.sha2(F.concat("p_name", F.col("p_partkey").cast("string")).cast("binary"), 256)
    k = F.col("p_partkey")
    given = F.when(k % 4 == 0, F.concat(F.lit("s2:"), F.upper(d))).when(k % 4 == 1, F.concat(F.lit("s2:"), d)).when(k % 4 == 2, F.concat(F.lit("x:"), d)).otherwise(F.concat(F.lit("s2:"), F.substring(d, 1, 60)))
    path = F.when(k % 3 == 0, F.concat(F.lit("objects/"), F.substring(d, 1, 2), F.lit("/"), F.substring(d, 3, 62))).otherwise(F.concat(F.lit("refs/"), d))
    return table(spark, sf_dir, "part").select("p_partkey", H.parse_id(given).alias("parsed"), H.id_from_path(path).alias("from_path"))


KINDS = ["HashMismatch", "MergeConflict", "JournalTorn", "ConnectionLost", "ChunkDigestMismatch", "ChainTooDeep", "NotARepository", "FrameDigestMismatch", "PeerError", "AncestorInvariantViolated", "RepositoryLocked", "Cancelled", "MalformedFrame", "NotImplemented", "ProtocolVersion", "ObjectNotFound"]


@query(f"""
WITH m AS (SELECT event_id, CASE WHEN event_id % 17 < 16 THEN ({KINDS})[event_id % 17 + 1] END AS kind FROM events),
i AS (SELECT *, coalesce(kind IN ('HashMismatch', 'ChunkDigestMismatch', 'FrameDigestMismatch', 'AncestorInvariantViolated', 'JournalTorn'), false) AS integrity FROM m)
SELECT event_id, kind, CASE WHEN kind IS NULL THEN 0 WHEN integrity THEN 4 WHEN kind = 'NotARepository' THEN 3 WHEN kind = 'MergeConflict' THEN 5 WHEN kind = 'RepositoryLocked' THEN 6
  WHEN kind = 'NotImplemented' THEN 7 WHEN kind IN ('ProtocolVersion', 'MalformedFrame', 'ConnectionLost', 'PeerError') THEN 8 ELSE 1 END AS code, integrity FROM i
""")
def exit_code_map(spark, sf_dir):
    """Process exit codes of all kinds of error; no error is 0, and kinds without a code of their own are 1."""
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 17).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"))
    return rows.select("event_id", "kind", H.exit_code(F.col("kind")).alias("code"), F.coalesce(H.is_integrity(F.col("kind")), F.lit(False)).alias("integrity"))


@query("""
WITH h AS (SELECT p_partkey, sha256(p_partkey::VARCHAR) AS d FROM part), q AS (SELECT DISTINCT substr(d, 1, 2) AS prefix FROM h)
SELECT prefix, count(*)::BIGINT AS matches, CASE WHEN count(*) = 1 THEN min(d) END AS resolved FROM q JOIN h ON substr(d, 1, 2) = prefix GROUP BY prefix
""")
def revision_prefix(spark, sf_dir):
    """Abbreviated revisions: resolved if a single id has the prefix, else ambiguous."""
    ids = table(spark, sf_dir, "part").select(F.sha2(F.col("p_partkey").cast("string").cast("binary"), 256).alias("d"))
    return T.resolve_prefixes(ids, "d", 2)


@query("""
WITH n AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'a/b' WHEN 2 THEN '..' ELSE c_name END AS name FROM customer),
s AS (SELECT *, lag(name) OVER (ORDER BY c_custkey) AS before FROM n)
SELECT c_custkey, name, name <> '' AND name NOT LIKE '%/%' AND name NOT IN ('.', '..') AS valid, coalesce(before < name, true) AS ascending FROM s
""")
def tree_validate(spark, sf_dir):
    """Entry names and their strict order."""
    from tessera.operators.sequences import neighbours

    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, "").when(k % 6 == 1, "a/b").when(k % 6 == 2, "..").otherwise(F.col("c_name"))
    rows = neighbours(table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")), "c_custkey", {"_before": F.col("name")})
    return rows.select("c_custkey", "name", H.is_entry_name(F.col("name")).alias("valid"), F.coalesce(F.col("_before") < F.col("name"), F.lit(True)).alias("ascending"))


@query("""
WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'x' || event_id ELSE event_id::VARCHAR END AS s FROM events) SELECT event_id, coalesce(try_cast(s AS BIGINT), -1) AS parsed FROM t
""")
def checked_parse(spark, sf_dir):
    s = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(s.try_cast("long"), F.lit(-1).cast("long")).alias("parsed"))
