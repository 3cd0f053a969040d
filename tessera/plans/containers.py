"""Queries on containers, permutation bytes, trees and manifests."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import container as C
from tessera.operators import manifests as M
from tessera.plans.alignment import _topk, _topk_sql
from tessera.plans.registry import query
from tessera.session import table

CHUNK = 256

#: Little-endian hexadecimal digits of a number of so many bytes.
LE = "array_to_string(list_reverse(regexp_extract_all(format('{{:0{w}x}}', {x}), '..')), '')"


def le(x: str, width: int) -> str:
    return LE.format(w=2 * width, x=x)


PAYLOADS = "WITH p AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, lower(hex(coalesce(text, ''))) AS h FROM documents), q AS (SELECT *, (n + 255) // 256 AS chunks FROM p) "


def _payloads(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("payload"))


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


@query(PAYLOADS + f"SELECT doc_id, n AS payload_len, chunks, n + 40 + 32 * chunks AS nbytes, lower(hex('TESSOBJ1')) || '0100' || {le('8', 4)} || {le('n', 8)} || {le('n', 8)} || {le('chunks', 4)} || '000000000000' AS header FROM q")
def container_layout(spark, sf_dir):
    """Every text as an object container, written in pieces: sizes and the header's bytes."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, payload in zip(batch.column("doc_id").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                writer = C.Writer("raw", CHUNK)
                for a in range(0, len(payload), 1000):
                    writer.write(payload[a : a + 1000])
                raw = writer.finish()[1]
                head = C.decode_header(raw)
                rows.append((doc, head["payload_len"], head["chunks"], len(raw), raw[: C.HEADER_BYTES].hex()))
            yield _batch(rows, ["doc_id", "payload_len", "chunks", "nbytes", "header"], [pa.int64()] * 4 + [pa.string()])

    return _payloads(spark, sf_dir).mapInArrow(run, "doc_id long, payload_len long, chunks long, nbytes long, header string")


@query(PAYLOADS + """,
r AS (SELECT *, CASE WHEN n > 0 AND doc_id % 3 = 0 THEN doc_id % chunks ELSE -1 END AS damaged, doc_id * 37 % (n + 1) AS off, least(n - doc_id * 37 % (n + 1), 700) AS len FROM q),
s AS (SELECT *, len > 0 AND damaged BETWEEN off // 256 AND (off + len - 1) // 256 AS bad FROM r)
SELECT doc_id, CASE WHEN bad THEN 'ChunkDigestMismatch' ELSE 'ok' END AS status, CASE WHEN bad THEN damaged ELSE -1 END AS chunk, CASE WHEN bad THEN 0 ELSE len END AS nbytes,
       CASE WHEN bad THEN '' ELSE sha256(unhex(substr(h, 2 * off + 1, 2 * len))) END AS digest FROM s
""")
def chunk_verified_read(spark, sf_dir):
    """Ranges read from containers of which every third has a damaged chunk: only a touched one is an error, and it is named."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, payload in zip(batch.column("doc_id").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                raw, n = bytearray(C.encode_object("raw", payload, CHUNK)), len(payload)
                if n and doc % 3 == 0:
                    raw[len(raw) - n + doc % -(-n // CHUNK) * CHUNK] ^= 1
                try:
                    got = C.read_range(bytes(raw), doc * 37 % (n + 1), 700)
                    rows.append((doc, "ok", -1, len(got), hashlib.sha256(got).hexdigest()))
                except C.ContentError as e:
                    rows.append((doc, e.kind, int(e.detail), 0, ""))
            yield _batch(rows, ["doc_id", "status", "chunk", "nbytes", "digest"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()])

    return _payloads(spark, sf_dir).mapInArrow(run, "doc_id long, status string, chunk long, nbytes long, digest string")


@query(f"""
WITH m AS (SELECT p_partkey // 50 AS grp, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_partkey // 50) AS n FROM part),
v AS (SELECT *, CASE WHEN grp % 5 = 3 THEN i WHEN grp % 5 = 1 AND i = n - 1 THEN 3 % n WHEN grp % 5 = 4 AND i = 0 THEN n ELSE (i * 7 + 3) % n END AS p FROM m),
g AS (SELECT grp, n, bool_and(p = i) AS same, count(DISTINCT p) = n AND max(p) < n AS bijection, string_agg({le('p', 2)}, '' ORDER BY i) AS h, sum(i * p)::BIGINT AS total FROM v GROUP BY grp, n),
w AS (SELECT *, CASE WHEN same THEN '' WHEN grp % 5 = 2 THEN substr(h, 1, 4 * n - 2) ELSE h END AS bytes FROM g)
SELECT grp, strlen(bytes)::BIGINT // 2 AS nbytes, bytes, CASE WHEN same THEN 'ok' WHEN grp % 5 = 2 THEN 'MalformedObject' WHEN NOT bijection THEN 'InvalidPermutation' ELSE 'ok' END AS status,
       CASE WHEN same OR grp % 5 <> 2 AND bijection THEN total ELSE -1 END AS total FROM w
""")
def permutation_bytes(spark, sf_dir):
    """Permutations written and read back; repeated, too large and missing values are refused before they index anything."""
    part = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("grp"), "p_partkey")

    def run(key, t):
        grp, n = key[0].as_py(), t.num_rows
        p = np.arange(n) if grp % 5 == 3 else (np.arange(n) * 7 + 3) % n
        if grp % 5 == 1:
            p[-1] = 3 % n
        if grp % 5 == 4:
            p[0] = n
        raw = C.write_permutation(p)
        if grp % 5 == 2 and raw:
            raw = raw[:-1]
        try:
            status, total = "ok", int((np.arange(n) * C.read_permutation(raw, n)).sum())
        except C.ContentError as e:
            status, total = e.kind, -1
        return pa.Table.from_batches([_batch([(grp, len(raw), raw.hex(), status, total)], ["grp", "nbytes", "bytes", "status", "total"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])])

    return part.groupBy("grp").applyInArrow(run, "grp long, nbytes long, bytes string, status string, total long")


@query("""
WITH c AS (SELECT c_nationkey::BIGINT AS nation, c_name AS name, sha256(c_name) AS id FROM customer),
n AS (SELECT nation, count(*)::BIGINT AS entries, min(name) AS first, max(name) AS last FROM c GROUP BY nation)
SELECT c.nation, name, id AS found, entries, first, last FROM c JOIN n ON n.nation = c.nation
UNION ALL SELECT nation, first || '~', NULL, entries, first, last FROM n
""")
def tree_lookup(spark, sf_dir):
    """A tree per nation: sorted entries, every name found by halving, and one that isn't there."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_name").alias("name"), F.sha2("c_name", 256).alias("id"))

    def run(key, t):
        names = t.column("name").to_pylist()
        tree = C.make_tree(zip(names, t.column("id").to_pylist(), strict=True))
        first, last = tree["entries"][0]["name"], tree["entries"][-1]["name"]
        found = [(key[0].as_py(), n, C.find_entry(tree, n), len(names), first, last) for n in [*names, first + "~"]]
        return pa.Table.from_batches([_batch(found, ["nation", "name", "found", "entries", "first", "last"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()])])

    return rows.groupBy("nation").applyInArrow(run, "nation long, name string, found string, entries long, first string, last string")


#: Orders are files, their lines the buffer; every 13th order has no lines that are read.
MANIFESTS = """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem WHERE l_orderkey % 13 <> 4),
l AS (SELECT l_orderkey AS file, seq, l_orderkey || '.' || seq AS tensor, CASE WHEN l_partkey % 97 = 5 THEN 0 ELSE l_quantity::BIGINT * 4 END AS nbytes, l_partkey, l_suppkey % 3 AS g FROM k),
b AS (SELECT *, coalesce(sum(nbytes) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 100 + CASE WHEN l_partkey % 89 = 7 THEN 8 ELSE 0 END AS off FROM l),
f AS (SELECT o_orderkey AS file, coalesce((SELECT sum(nbytes) FROM l WHERE l.file = o_orderkey), 0)::BIGINT + 100 + CASE WHEN o_orderkey % 19 = 3 THEN 1 ELSE 0 END AS total_bytes FROM orders),
g AS (SELECT o_orderkey AS file, k AS grp, CASE WHEN (o_orderkey + k) % 4 = 0 THEN 'full' ELSE 'delta' END AS mode, (o_orderkey + k) % 20 <> 0 AS block, (o_orderkey + k) % 23 <> 1 AS base, o_orderkey % 29 <> 2 AS diff,
  CASE WHEN (o_orderkey + k) % 4 = 0 THEN CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END ELSE 1 + o_orderkey % 5 END AS chain_depth FROM orders, (VALUES (0), (1), (2)) v(k) WHERE NOT (o_orderkey % 37 = 6 AND k = 1))
"""


def _manifests(spark, sf_dir):
    k = F.col("l_orderkey")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    lines = table(spark, sf_dir, "lineitem").where(k % 13 != 4).withColumn("seq", number)
    nbytes = F.when(F.col("l_partkey") % 97 == 5, 0).otherwise(F.col("l_quantity").cast("long") * 4)
    lines = lines.select(k.alias("file"), "seq", F.concat(k.cast("string"), F.lit("."), F.col("seq").cast("string")).alias("tensor"), nbytes.alias("nbytes"), "l_partkey", (F.col("l_suppkey") % 3).cast("int").alias("group"))
    before = F.sum("nbytes").over(Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    buffer = lines.withColumn("off", F.coalesce(before, F.lit(0)) + 100 + F.when(F.col("l_partkey") % 89 == 7, 8).otherwise(0)).drop("l_partkey")
    o = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    sums = lines.groupBy("file").agg(F.sum("nbytes").alias("_n"))
    files = orders.select(o.alias("file")).join(sums, "file", "left").select("file", (F.coalesce("_n", F.lit(0)) + 100 + F.when(F.col("file") % 19 == 3, 1).otherwise(0)).alias("total_bytes"))
    groups = orders.select(o.alias("file"), F.explode(F.array(*map(F.lit, range(3)))).alias("group")).where(~((F.col("file") % 37 == 6) & (F.col("group") == 1)))
    x, f = F.col("file") + F.col("group"), F.col("file")
    yes = lambda c: F.when(c, F.lit("x"))
    depth = F.when(x % 4 == 0, F.when(f % 31 == 0, 1).otherwise(0)).otherwise(1 + f % 5)
    groups = groups.select("file", "group", F.when(x % 4 == 0, "full").otherwise("delta").alias("mode"), yes(x % 20 != 0).alias("block"), yes(x % 23 != 1).alias("base"), yes(f % 29 != 2).alias("diff_block"), depth.alias("chain_depth"))
    return files, buffer, groups


@query(MANIFESTS + """, d AS (SELECT *, lag(off + nbytes) OVER (PARTITION BY file ORDER BY seq) AS due FROM b), e AS (SELECT file, arg_max(off + nbytes, seq) AS fin FROM b GROUP BY file)
SELECT file, 'TensorNotInBufferLayout' AS kind, 'gap or overlap' AS rule, tensor AS object FROM d WHERE off <> due
UNION ALL SELECT file, 'TensorNotInBufferLayout', 'no bytes', tensor FROM b WHERE nbytes = 0
UNION ALL SELECT file, 'MalformedObject', 'unknown group', tensor FROM b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.file = b.file AND g.grp = b.g)
UNION ALL SELECT file, 'MalformedObject', 'empty buffer', '' FROM f WHERE file NOT IN (SELECT file FROM e)
UNION ALL SELECT f.file, 'TensorNotInBufferLayout', 'not covered', '' FROM f JOIN e ON e.file = f.file WHERE fin <> total_bytes
UNION ALL SELECT file, 'MalformedObject', 'full without block', grp::VARCHAR FROM g WHERE mode = 'full' AND NOT block
UNION ALL SELECT file, 'MalformedObject', 'full with depth', grp::VARCHAR FROM g WHERE mode = 'full' AND chain_depth <> 0
UNION ALL SELECT file, 'MalformedObject', 'delta without base', grp::VARCHAR FROM g WHERE mode = 'delta' AND NOT (base AND diff)
""")
def manifest_findings(spark, sf_dir):
    """Planted faults of manifests: layout, unknown groups, and full and delta groups without what they need."""
    return M.findings(*_manifests(spark, sf_dir))


@query(MANIFESTS + "SELECT file, count(*)::BIGINT AS \"groups\", count(*) FILTER (mode = 'delta')::BIGINT AS deltas, max(chain_depth)::BIGINT AS max_depth FROM g GROUP BY file")
def manifest_statistics(spark, sf_dir):
    return M.statistics(_manifests(spark, sf_dir)[2])


@query("""
WITH m AS (SELECT l_suppkey AS grp, l_orderkey || '.' || l_linenumber AS tensor, l_linenumber FROM lineitem), b AS (SELECT l_orderkey || '.' || l_linenumber AS tensor, l_partkey % 5 AS depth FROM lineitem WHERE l_partkey % 3 = 0)
SELECT grp AS "group", coalesce(max(depth) + 1, 0)::BIGINT AS depth FROM m LEFT JOIN b USING (tensor) GROUP BY grp
""")
def group_base_depth(spark, sf_dir):
    """A group is as deep as its deepest member's base, and one more."""
    lines = table(spark, sf_dir, "lineitem")
    name = F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("tensor")
    return M.group_depths(lines.select(F.col("l_suppkey").alias("group"), name), lines.where("l_partkey % 3 = 0").select(name, (F.col("l_partkey") % 5).alias("depth")))


@query("""
WITH a AS (SELECT l_orderkey AS tensor, l_linenumber AS dim, l_suppkey AS g FROM lineitem), b AS (SELECT l_orderkey AS tensor, l_linenumber AS dim, l_partkey % 40 AS g FROM lineitem WHERE l_linenumber < 4)
SELECT DISTINCT a.g AS "group", b.g AS other FROM a JOIN b USING (tensor, dim)
""")
def bridge_groups(spark, sf_dir):
    """Groups of a found and of a given topology that bind the same axis."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tensor"), F.col("l_linenumber").alias("dim"), "l_suppkey", "l_partkey")
    return M.bridge(lines.withColumnRenamed("l_suppkey", "group"), lines.where("dim < 4").withColumn("group", F.col("l_partkey") % 40))


@query(_topk_sql("-list_dot_product(tv, bv)").replace("SELECT i, j, cost, rank FROM r", "SELECT DISTINCT i // 64 AS chunk, j FROM r"))
def unique_candidates(spark, sf_dir):
    """Candidate base units of each chunk of 64 target units, once each."""
    return M.candidate_union(_topk(spark, sf_dir, "neg_inner"), 64)
