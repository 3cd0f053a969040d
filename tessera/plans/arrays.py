"""Queries on permutations, runs, layouts, chunks, residuals and integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import integers as I
from tessera.operators import sequences as Q
from tessera.plans.registry import query
from tessera.session import table

PERM = "WITH n AS (SELECT count(*) AS n FROM part), p AS (SELECT p_partkey AS i, (p_partkey * 7 + 3) % n AS j FROM part, n) "


def permutation(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey")
    n = part.count()
    return part.select(F.col("p_partkey").alias("i"), ((F.col("p_partkey") * 7 + 3) % n).alias("j")), n


@query(PERM + "SELECT i * 4 + b AS i, j * 4 + b AS j FROM (SELECT i, j, unnest(range(4)) AS b FROM p)")
def expand_permutation(spark, sf_dir):
    p, _ = permutation(spark, sf_dir)
    both = F.arrays_zip(I.expand_permutation(F.array("i"), 4).alias("i"), I.expand_permutation(F.array("j"), 4).alias("j"))
    return p.select(F.inline(both))


@query(PERM + "SELECT j AS i, i AS j FROM p")
def invert_permutation(spark, sf_dir):
    p, _ = permutation(spark, sf_dir)
    return p.select(F.col("j").alias("i"), F.col("i").alias("j"))


@query(PERM + "SELECT count(*)::BIGINT AS n, count(DISTINCT j) = count(*) AND min(j) = 0 AND max(j) = count(*) - 1 AS valid FROM p")
def valid_permutation(spark, sf_dir):
    p, _ = permutation(spark, sf_dir)
    each = p.groupBy("j").agg(F.count(F.lit(1)).alias("k"))
    return each.agg(F.sum("k").alias("n"), ((F.max("k") == 1) & (F.min("j") == 0) & (F.max("j") == F.sum("k") - 1)).alias("valid"))


@query("""
WITH u AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM u)
SELECT min(k) AS first, count(*)::BIGINT AS count FROM r GROUP BY g
""")
def unit_runs(spark, sf_dir):
    return Q.islands(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey")


@query(PERM + """, d AS (SELECT DISTINCT i // 64 AS slice, j AS k FROM p), r AS (SELECT slice, k, k - row_number() OVER (PARTITION BY slice ORDER BY k) AS g FROM d)
SELECT slice, min(k) AS first, count(*)::BIGINT AS count FROM r GROUP BY slice, g""")
def dependency_runs(spark, sf_dir):
    """Runs of base units that each slice of 64 units of the target reads."""
    p, n = permutation(spark, sf_dir)
    # Base units lie below n, so keys of different slices are never consecutive.
    runs = Q.islands(p.select((F.floor(F.col("i") / 64) * (n + 1) + F.col("j")).alias("k")), "k")
    return runs.select(F.floor(F.col("first") / (n + 1)).alias("slice"), (F.col("first") % (n + 1)).alias("first"), "count")


@query("""
WITH n AS (SELECT count(*) AS n FROM orders)
SELECT t.o_orderkey AS i, b.o_orderkey AS j, b.o_totalprice AS price FROM orders t JOIN n ON true JOIN orders b ON b.o_orderkey = (t.o_orderkey * 7 + 3) % n
""")
def permute_gather(spark, sf_dir):
    """target[i] = base[perm[i]]: one equi-join on the permuted unit."""
    orders = table(spark, sf_dir, "orders")
    n = orders.count()
    perm = orders.select(F.col("o_orderkey").alias("i"), ((F.col("o_orderkey") * 7 + 3) % n).alias("j"))
    return perm.join(orders.select(F.col("o_orderkey").alias("j"), F.col("o_totalprice").alias("price")), "j").select("i", "j", "price")


LINES = "WITH v AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT % 65536 AS t, round((l_extendedprice * (1 - l_discount)) * 100)::BIGINT % 65536 AS b FROM lineitem) "


def _versions(spark, sf_dir):
    cents = lambda c: F.pmod(F.round(c * 100).cast("long"), F.lit(65536))
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cents(price).alias("t"), cents(price * (1 - F.col("l_discount"))).alias("b"))


@query(LINES + "SELECT l_orderkey, l_linenumber, xor(t, b) AS residual FROM v")
def xor_residual(spark, sf_dir):
    return _versions(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("t").bitwiseXOR(F.col("b")).alias("residual"))


@query(LINES + "SELECT l_orderkey, l_linenumber, CASE WHEN d >= 32768 THEN 2 * (65536 - d) - 1 ELSE 2 * d END AS residual FROM (SELECT *, (t - b + 65536) % 65536 AS d FROM v)")
def zigzag_residual(spark, sf_dir):
    return _versions(spark, sf_dir).select("l_orderkey", "l_linenumber", I.zigzag_encode(F.col("t"), F.col("b")).alias("residual"))


@query(LINES + "SELECT l_orderkey, l_linenumber, t AS restored, true AS same FROM v")
def zigzag_roundtrip(spark, sf_dir):
    v = _versions(spark, sf_dir).withColumn("restored", I.zigzag_decode(F.col("b"), I.zigzag_encode(F.col("t"), F.col("b"))))
    return v.select("l_orderkey", "l_linenumber", "restored", (F.col("restored") == F.col("t")).alias("same"))


RANGES = "WITH r AS (SELECT doc_id, doc_id * 7919 % 1000000 AS off, n_chars AS len FROM documents) "


def _ranges(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 7919 % 1000000).alias("off"), F.col("n_chars").alias("len"))


@query(RANGES + "SELECT doc_id, unnest(range(off // 4096, (off + len - 1) // 4096 + 1)) AS chunk FROM r WHERE len > 0")
def chunk_cover(spark, sf_dir):
    r = _ranges(spark, sf_dir).where("len > 0")
    return r.select("doc_id", F.explode(F.sequence(I.first_chunk(F.col("off"), 4096), I.last_chunk(F.col("off"), F.col("len"), 4096))).alias("chunk"))


@query("SELECT doc_id, c AS chunk, c * 1024 AS begin, greatest(0, least(1024, n_chars - c * 1024))::BIGINT AS length FROM (SELECT doc_id, n_chars, unnest(range((n_chars + 1023) // 1024)) AS c FROM documents)")
def chunk_extent(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), I.ceil_div(F.col("n_chars"), 1024) - 1)).alias("chunk"))
    return docs.select("doc_id", "chunk", (F.col("chunk") * 1024).alias("begin"), I.chunk_length(F.col("chunk"), F.col("n_chars"), 1024).alias("length"))


LAYOUT = "WITH l AS (SELECT doc_id, n_chars, (coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS off FROM documents) "


def file_layout(spark, sf_dir):
    return Q.running_total(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", "off")


@query(LAYOUT + ", t AS (SELECT sum(n_chars)::BIGINT AS total FROM documents), p AS (SELECT event_id, event_id * 104729 % total AS point FROM events, t) "
       "SELECT event_id, point, doc_id, point - off AS inner_off FROM p ASOF JOIN (SELECT * FROM l WHERE n_chars > 0) l ON p.point >= l.off WHERE point < off + n_chars")
def interval_lookup(spark, sf_dir):
    """Which document of a concatenated file a byte offset falls in."""
    layout = file_layout(spark, sf_dir).withColumn("end", F.col("off") + F.col("n_chars"))
    total = table(spark, sf_dir, "documents").agg(F.sum("n_chars").alias("total"))
    probes = table(spark, sf_dir, "events").join(F.broadcast(total)).select("event_id", (F.col("event_id") * 104729 % F.col("total")).alias("point"))
    return Q.range_lookup(probes, layout, "point", "off", "end", 4096).select("event_id", "point", "doc_id", (F.col("point") - F.col("off")).alias("inner_off"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem)
SELECT l_orderkey, l_linenumber, cents, (coalesce(sum(cents) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, cents ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS cursor FROM v
""")
def group_cursor(spark, sf_dir):
    """Offset of each entry within its group: the sizes of those before it."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "cents").rowsBetween(Window.unboundedPreceding, -1)
    v = table(spark, sf_dir, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return v.select("l_orderkey", "l_linenumber", "cents", F.coalesce(F.sum("cents").over(w), F.lit(0).cast("long")).alias("cursor"))


@query(LAYOUT + """, s AS (SELECT doc_id, n_chars, off + CASE WHEN doc_id % 97 = 5 THEN 3 WHEN doc_id % 89 = 7 THEN -2 ELSE 0 END AS off FROM l),
f AS (SELECT *, lag(off + n_chars) OVER (ORDER BY doc_id) AS expected FROM s)
SELECT doc_id, n_chars, off, expected, CASE WHEN n_chars <= 0 THEN 'empty' WHEN off > expected THEN 'gap' ELSE 'overlap' END AS finding FROM f WHERE n_chars <= 0 OR off <> expected
""")
def layout_contiguity(spark, sf_dir):
    """A file layout with planted shifts: where it isn't gap-free."""
    layout = file_layout(spark, sf_dir)
    shift = F.when(F.col("doc_id") % 97 == 5, 3).when(F.col("doc_id") % 89 == 7, -2).otherwise(0)
    seeded = layout.select("doc_id", "n_chars", (F.col("off") + shift).alias("off"))
    return Q.layout_findings(seeded, "doc_id", "off", "n_chars").select("doc_id", "n_chars", "off", "expected", "finding")


FRAMES = """
WITH f AS (SELECT p_brand AS tensor, p_partkey, sum(p_size) OVER w AS unit_end, sum(p_size) OVER w - p_size + CASE WHEN p_partkey % 101 = 9 THEN 1 ELSE 0 END AS unit_begin
           FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


def _frames(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("p_size").over(w)
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("tensor"), "p_partkey", (end - F.col("p_size") + F.when(F.col("p_partkey") % 101 == 9, 1).otherwise(0)).cast("long").alias("unit_begin"), end.cast("long").alias("unit_end"))


@query(FRAMES + """SELECT tensor, p_partkey, unit_begin::BIGINT AS unit_begin, unit_end::BIGINT AS unit_end, before::BIGINT AS expected
FROM (SELECT *, coalesce(lag(unit_end) OVER (PARTITION BY tensor ORDER BY p_partkey), 0) AS before FROM f) WHERE unit_begin <> before""")
def frame_tiling(spark, sf_dir):
    """Frames that don't start where the tensor's frame before ends."""
    before = F.coalesce(F.lag("unit_end").over(Window.partitionBy("tensor").orderBy("p_partkey")), F.lit(0).cast("long"))
    return _frames(spark, sf_dir).withColumn("expected", before).where("unit_begin <> expected").select("tensor", "p_partkey", "unit_begin", "unit_end", "expected")


@query(FRAMES + "SELECT tensor, p_partkey, unit_begin::BIGINT AS unit_begin, unit_end::BIGINT AS unit_end FROM f WHERE unit_end > 100 AND unit_begin < 400")
def frame_overlap(spark, sf_dir):
    """Frames that a unit range touches."""
    return _frames(spark, sf_dir).where("unit_end > 100 and unit_begin < 400")


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_id % 4 AS off FROM events),
c AS (SELECT *, CASE WHEN lag(off) OVER w + 1 = off THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c),
s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS streak FROM r)
SELECT user_id, event_id, streak::BIGINT AS streak, CASE WHEN streak >= 3 THEN 4 ELSE 0 END AS prefetch FROM s
""")
def sequential_streak(spark, sf_dir):
    """Reads per handle: how many in a row continued the one before, and how many frames to fetch ahead."""
    from tessera.streaming.streak import streaks

    reads = table(spark, sf_dir, "events").select(F.col("user_id").alias("handle"), "ts", "event_id", (F.col("event_id") % 4).alias("off"), F.lit(1).alias("len"))
    return streaks(reads).select(F.col("handle").alias("user_id"), "event_id", "streak", "prefetch")


@query("""
SELECT p_partkey, ((p_size + 2 - 3) // 2 + 1)::BIGINT AS conv, ((p_size - 2) // 2 + 1)::BIGINT AS pool, bit_count(p_partkey) = 1 AND p_partkey > 0 AS power_of_two,
       p_partkey - p_partkey % 64 AS aligned, ((p_size + 15) // 16)::BIGINT AS groups, (p_size * 3 * 3)::BIGINT AS trailing, (p_partkey * p_size * 9)::BIGINT AS elements
FROM part WHERE p_size >= 2
""")
def shape_arithmetic(spark, sf_dir):
    """Window outputs, alignment and products of extents."""
    size = F.col("p_size").cast("long")
    shape = F.array(F.col("p_partkey"), size, F.lit(3).cast("long"), F.lit(3).cast("long"))
    one, two, three = F.lit(1), F.lit(2), F.lit(3)
    return table(spark, sf_dir, "part").where("p_size >= 2").select(
        "p_partkey",
        I.window_output(size, three, two, one).alias("conv"),
        I.window_output(size, two, two, F.lit(0)).alias("pool"),
        I.is_power_of_two(F.col("p_partkey")).alias("power_of_two"),
        I.align_down(F.col("p_partkey"), 64).alias("aligned"),
        I.ceil_div(size, 16).alias("groups"),
        I.trailing_elements(shape, 0).alias("trailing"),
        I.element_count(shape).alias("elements"),
    )


@query("""
WITH r AS (SELECT l_orderkey, l_partkey, round(l_extendedprice * 100)::BIGINT AS c, l_linenumber FROM lineitem)
SELECT l_orderkey, l_partkey, c AS bid, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, l_partkey, l_linenumber)::INT AS rank
FROM r QUALIFY rank <= 2
""")
def top_two_per_group(spark, sf_dir):
    best = Window.partitionBy("l_orderkey").orderBy(F.desc("bid"), "l_partkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("bid"), "l_linenumber")
    return rows.withColumn("rank", F.row_number().over(best)).where("rank <= 2").drop("l_linenumber")
