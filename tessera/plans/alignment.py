"""Queries over ``embeddings``: the units of a base and of the same base in planted order.

Target unit i is base unit perm[i]; a base unit j stands at i = (7 j + 3) mod n.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.integers import quantile_positions
from tessera.operators import assignment
from tessera.operators import similarity as S
from tessera.plans.registry import query
from tessera.session import table

PLANTED = """
WITH b AS (SELECT vec_id AS j, embedding::DOUBLE[] AS bv FROM embeddings),
t AS (SELECT (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS i, embedding::DOUBLE[] AS tv FROM embeddings),
"""


def base_units(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("j"), F.col("embedding").cast("array<double>").alias("bv"))


def target_units(spark, sf_dir) -> DataFrame:
    units = table(spark, sf_dir, "embeddings")
    n = units.count()
    return units.select(((F.col("vec_id") * 7 + 3) % n).alias("i"), F.col("embedding").cast("array<double>").alias("tv"))


def _topk(spark, sf_dir, kind: str, k: int = 3) -> DataFrame:
    targets, base = S.blocks(target_units(spark, sf_dir), "i", "tv"), S.blocks(base_units(spark, sf_dir), "j", "bv")
    return S.nearest(targets, base, k, kind)


def _topk_sql(cost: str, k: int = 3) -> str:
    return PLANTED + f"""
c AS (SELECT i, j, round({cost}, 6) + 0.0 AS cost FROM t, b),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cost, j)::INT AS rank FROM c)
SELECT i, j, cost, rank FROM r WHERE rank <= {k}
"""


@query(_topk_sql("-list_dot_product(tv, bv)"))
def cost_negdot_topk(spark, sf_dir):
    return _topk(spark, sf_dir, "neg_inner")


@query(_topk_sql("greatest(list_dot_product(tv, tv) + list_dot_product(bv, bv) - 2 * list_dot_product(tv, bv), 0)"))
def cost_l2_topk(spark, sf_dir):
    return _topk(spark, sf_dir, "l2")


@query(_topk_sql("1 - list_dot_product(tv, bv) / (sqrt(list_dot_product(tv, tv)) * sqrt(list_dot_product(bv, bv)) + 1e-12)"))
def cost_cosine_topk(spark, sf_dir):
    return _topk(spark, sf_dir, "cosine")


@query(_topk_sql("-list_dot_product(tv, bv)", 1).replace("SELECT i, j, cost, rank", "SELECT i AS target, j AS base, cost"))
def planted_recovery(spark, sf_dir):
    """Row minima of the planted pair: the optimum is unique, so they are the assignment."""
    return _topk(spark, sf_dir, "neg_inner", 1).select(F.col("i").alias("target"), F.col("j").alias("base"), "cost")


@query("""
WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT *, sqrt(list_dot_product(v, v)) + 1e-8 AS n FROM u)
SELECT vec_id, round(n, 6) AS norm, round(list_sum(list_transform(range(1, len(v) + 1), lambda k: v[k] / n * k)), 6) AS checksum FROM m
""")
def unit_l2_normalize(spark, sf_dir):
    units = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("n", S.norm("v"))
    scaled = F.transform("v", lambda x, k: x / F.col("n") * (k + 1))
    return units.select("vec_id", F.round("n", 6).alias("norm"), F.round(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"))


@query(PLANTED + "x AS (SELECT 1) SELECT round(sum(-list_dot_product(tv, bv)), 6) AS identity_cost FROM t JOIN b ON i = j")
def identity_cost(spark, sf_dir):
    return S.paired_cost(target_units(spark, sf_dir), base_units(spark, sf_dir)).agg(F.round(F.sum("cost"), 6).alias("identity_cost"))


@query(PLANTED + "x AS (SELECT 1) SELECT round(sum(-list_dot_product(tv, bv)) / (SELECT count(*) FROM b), 6) AS random_cost FROM t, b")
def random_cost(spark, sf_dir):
    return S.random_cost(target_units(spark, sf_dir), base_units(spark, sf_dir)).select(F.round("random_cost", 6).alias("random_cost"))


@query(PLANTED + "x AS (SELECT 1) SELECT round(sum(-list_dot_product(tv, bv)), 6) AS assignment_cost FROM t JOIN b ON i = (j * 7 + 3) % (SELECT count(*) FROM b)")
def assignment_cost(spark, sf_dir):
    base = base_units(spark, sf_dir)
    n = base.count()
    permuted = base.select(((F.col("j") * 7 + 3) % n).alias("j"), "bv")
    return S.paired_cost(target_units(spark, sf_dir), permuted).agg(F.round(F.sum("cost"), 6).alias("assignment_cost"))


@query(PLANTED + """
c AS (SELECT i, round(-list_dot_product(tv, bv), 6) AS cost FROM t, b), m AS (SELECT *, min(cost) OVER (PARTITION BY i) AS least FROM c),
k AS (SELECT i, count(*) AS ties FROM m WHERE cost = least GROUP BY i)
SELECT count(*) FILTER (ties = 1)::BIGINT AS distinct_rows, count(*)::BIGINT AS n FROM k
""")
def distinct_best_match(spark, sf_dir):
    """Rows whose least cost is unique: their two best differ."""
    two = _topk(spark, sf_dir, "neg_inner", 2).groupBy("i").agg(F.min("cost").alias("lo"), F.max("cost").alias("hi"), F.count(F.lit(1)).alias("k"))
    return two.agg(F.count_if((F.col("k") == 1) | (F.col("lo") < F.col("hi"))).alias("distinct_rows"), F.count(F.lit(1)).alias("n"))


@query("""
WITH u AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT a.label, a.n, a.n - 1 - a.k AS i, b.k AS j, round(-list_dot_product(a.v, b.v), 9) AS cost FROM u a JOIN u b ON a.label = b.label),
m AS (SELECT *, min(cost) OVER (PARTITION BY label, i) AS least FROM c),
d AS (SELECT label, count(*) AS distinct_rows FROM (SELECT label, i FROM m WHERE cost = least GROUP BY label, i HAVING count(*) = 1) GROUP BY label),
s AS (SELECT label, any_value(n) AS n, sum(cost) FILTER (j = n - 1 - i) AS achieved, sum(cost) FILTER (i = j) AS identity, sum(cost) / any_value(n) AS random FROM c GROUP BY label),
f AS (SELECT s.*, coalesce(distinct_rows, 0) AS distinct_rows FROM s LEFT JOIN d USING (label)),
z AS (SELECT *, CASE WHEN identity > 0 THEN achieved / identity WHEN identity < 0 AND achieved <> 0 THEN identity / achieved ELSE 0 END AS na,
             CASE WHEN identity > 0 THEN random / identity WHEN identity < 0 AND random <> 0 THEN identity / random ELSE 0 END AS nr FROM f)
SELECT label, n::BIGINT AS n, distinct_rows::BIGINT AS distinct_rows, round(achieved, 4) AS achieved,
       CASE WHEN na > 0.9 * nr THEN 'NotAlignable' WHEN distinct_rows / n < 0.5 THEN 'Degenerate' ELSE 'Aligned' END AS verdict
FROM z
""")
def confidence_verdict(spark, sf_dir):
    """Per label, units against themselves in reverse order: solved, then judged; one group of units is one matrix."""
    by_label = Window.partitionBy("label").orderBy("vec_id")
    units = table(spark, sf_dir, "embeddings").select("label", (F.row_number().over(by_label) - 1).cast("long").alias("k"), F.col("embedding").cast("array<double>").alias("v"))

    def solve(key, t):
        t = t.sort_by("k")
        n = t.num_rows
        b = t.column("v").combine_chunks().flatten().to_numpy().reshape(n, -1)
        c = np.round(-(b[::-1] @ b.T), 9)
        found = assignment.solve_exact(c)
        distinct = int(((c == c.min(axis=1, keepdims=True)).sum(axis=1) == 1).sum())
        row = [key[0].as_py(), n, distinct, float(c[np.arange(n), found].sum()), float(np.trace(c)), float(c.sum() / n)]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["label", "n", "distinct_rows", "achieved", "identity", "random"])

    schema = "label int, n long, distinct_rows long, achieved double, identity double, random double"
    judged = units.groupBy("label").applyInArrow(solve, schema)
    state = S.verdict(F.col("achieved"), F.col("identity"), F.col("random"), F.col("distinct_rows"), F.col("n"))
    return judged.select("label", "n", "distinct_rows", F.round("achieved", 4).alias("achieved"), state.alias("verdict"))


@query("""
WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), e AS (SELECT vec_id, unnest(range(len(v))) AS dim, unnest(v) AS x FROM u),
s AS (SELECT dim, avg(x) AS mean, stddev_pop(x) + 1e-8 AS std FROM e GROUP BY dim)
SELECT vec_id, round(sum((x - mean) / std * (dim + 1)), 4) AS checksum FROM e JOIN s USING (dim) GROUP BY vec_id
""")
def whiten_jointly(spark, sf_dir):
    """Both halves of the units are whitened by the statistics of their union."""
    units = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    joint = units.where("vec_id % 2 = 0").unionByName(units.where("vec_id % 2 = 1"))
    white = S.whiten(joint, "v", S.whitening(joint, "v"))
    total = F.aggregate(F.transform("v", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return white.select("vec_id", F.round(total, 4).alias("checksum"))


@query("""
WITH u AS (SELECT vec_id, list_sort(embedding::DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, k::INT AS position, v[(k * (len(v) - 1)) // 15 + 1] AS value FROM (SELECT *, unnest(range(16)) AS k FROM u)
""")
def quantile_fingerprint(spark, sf_dir):
    units = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    at = quantile_positions(64, 16)
    return units.select("vec_id", F.posexplode(S.fingerprint("v", at)).alias("position", "value"))


def _solved(spark, sf_dir, solver) -> DataFrame:
    """The planted pair as one permutation group: its units are gathered by one task, which computes their costs tile by tile."""
    rows = target_units(spark, sf_dir).select(F.lit(True).alias("target"), F.col("i").alias("unit"), F.col("tv").alias("v"))
    rows = rows.union(base_units(spark, sf_dir).select(F.lit(False), "j", "bv")).withColumn("group", F.lit("g"))

    def solve(t):
        import pyarrow.compute as pc

        def side(flag):
            part = t.filter(pc.equal(t.column("target"), flag)).sort_by("unit")
            return part.column("unit").to_numpy(), part.column("v").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)

        # Numbers of target units repeat where 7 divides how many there are.
        (targets, a), (units, b) = side(True), side(False)
        return pa.table([pa.array(targets), pa.array(units[np.asarray(solver(a, b), np.int64)])], ["target", "base"])

    return rows.groupBy("group").applyInArrow(solve, "target long, base long")


PLANTED_PAIRS = "SELECT (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS target, vec_id AS base FROM embeddings"


@query(PLANTED_PAIRS)
def jv_assignment(spark, sf_dir):
    return _solved(spark, sf_dir, lambda a, b: assignment.solve_exact(assignment.Products(a, b)))


@query(PLANTED_PAIRS)
def greedy_assignment(spark, sf_dir):
    return _solved(spark, sf_dir, lambda a, b: assignment.solve_greedy(assignment.Products(a, b)))


@query(PLANTED_PAIRS)
def auction_assignment(spark, sf_dir):
    """Candidates by quantile fingerprints, true costs on them only, auction, exact repair."""
    from tessera.operators.matching import sparse_match

    return _solved(spark, sf_dir, lambda a, b: sparse_match([a], [b]).held)


@query(PLANTED + """
c AS (SELECT i, j, round(-list_dot_product(tv, bv), 6) AS cost FROM t, b), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cost, j) AS k FROM c)
SELECT i AS bidder, max(j) FILTER (k = 1) AS object, round(max(cost) FILTER (k = 2) - max(cost) FILTER (k = 1), 6) AS margin FROM r WHERE k <= 2 GROUP BY i
""")
def best_two_bids(spark, sf_dir):
    """Each bidder's best object and by how much it beats the second best: an auction's first bids."""
    two = _topk(spark, sf_dir, "neg_inner", 2)
    first, second = F.max(F.when(F.col("rank") == 1, F.col("cost"))), F.max(F.when(F.col("rank") == 2, F.col("cost")))
    return two.groupBy(F.col("i").alias("bidder")).agg(F.max(F.when(F.col("rank") == 1, F.col("j"))).alias("object"), F.round(second - first, 6).alias("margin"))


@query(PLANTED + """
c AS (SELECT i, j, round(-list_dot_product(tv, bv), 6) AS cost FROM t, b), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cost, j) AS k FROM c),
w AS (SELECT i, j, cost, row_number() OVER (PARTITION BY j ORDER BY cost, i) AS w FROM r WHERE k <= 3)
SELECT j AS object, i AS bidder, cost FROM w WHERE w = 1
""")
def winner_per_object(spark, sf_dir):
    """Of all bidders with an object among their three best, the one of least cost, ties to the lowest."""
    won = _topk(spark, sf_dir, "neg_inner").groupBy(F.col("j").alias("object")).agg(F.min(F.struct("cost", "i")).alias("w"))
    return won.select("object", F.col("w.i").alias("bidder"), F.col("w.cost").alias("cost"))
