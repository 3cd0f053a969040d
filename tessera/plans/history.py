"""Queries on commit graphs, merges, decisions and verification.

Orders are the commits. A customer's orders, by key, alternate between two branches
that fork at the first one; every fifth is a merge whose second parent is the order
just before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import decisions as D
from tessera.operators import graph as G
from tessera.operators import store as T
from tessera.plans.registry import query
from tessera.session import materialise, table

COMMITS = """
WITH RECURSIVE c AS (
  SELECT o_orderkey AS node, o_custkey AS cust, row_number() OVER w - 1 AS pos, lag(o_orderkey, 1) OVER w AS l1, lag(o_orderkey, 2) OVER w AS l2,
         first_value(o_orderkey) OVER w AS root, o_orderdate FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
), e AS (
  SELECT node AS child, CASE WHEN pos = 1 THEN root ELSE l2 END AS parent, 1 AS k FROM c WHERE pos >= 1
  UNION ALL SELECT node, l1, 2 FROM c WHERE pos >= 2 AND pos % 5 = 4
), a AS (
  SELECT node, node AS ancestor, 0 AS distance FROM c
  UNION SELECT a.node, e.parent, a.distance + 1 FROM a JOIN e ON a.ancestor = e.child
), cl AS (SELECT node, ancestor, min(distance)::INT AS distance FROM a GROUP BY node, ancestor)
"""


def commits(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("cust"), "o_orderdate", "o_orderstatus", (F.row_number().over(w) - 1).alias("pos"), F.lag("o_orderkey", 1).over(w).alias("l1"), F.lag("o_orderkey", 2).over(w).alias("l2"))
    first = F.when(F.col("pos") == 1, F.col("l1")).otherwise(F.col("l2"))
    return rows.withColumn("p1", first).withColumn("p2", F.when((F.col("pos") >= 2) & (F.col("pos") % 5 == 4), F.col("l1"))).drop("l1", "l2")


def parents(found: DataFrame) -> DataFrame:
    both = found.select(F.col("node").alias("child"), F.explode(F.array("p1", "p2")).alias("parent"))
    return both.where("parent is not null")


@query(COMMITS + "SELECT * FROM cl")
def ancestors(spark, sf_dir):
    return G.ancestors(parents(commits(spark, sf_dir))).unionByName(
        commits(spark, sf_dir).groupBy("cust").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1").select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    )


@query(COMMITS + """, q AS (SELECT node AS a, lag(node, 3) OVER (PARTITION BY cust ORDER BY node) AS b FROM c)
SELECT a, b, cl.node IS NOT NULL AS is_ancestor FROM q LEFT JOIN cl ON cl.node = a AND cl.ancestor = b WHERE b IS NOT NULL""")
def is_ancestor(spark, sf_dir):
    """Whether the commit three before a commit, by key, is one of its ancestors."""
    found = commits(spark, sf_dir)
    pairs = found.select(F.col("node").alias("a"), G.previous_in(found, "cust", "node", "node", 3).alias("b")).where("b is not null")
    pairs = materialise(pairs)
    closure = G.ancestors(materialise(parents(found)), pairs.select(F.col("a").alias("node"))).select(F.col("node").alias("a"), F.col("ancestor").alias("b"), F.lit(True).alias("_y"))
    return pairs.join(closure, ["a", "b"], "left").select("a", "b", F.coalesce("_y", F.lit(False)).alias("is_ancestor"))


@query(COMMITS + """, l AS (SELECT cust, max(node) AS ours FROM c GROUP BY cust), q AS (SELECT ours, l1 AS theirs FROM l JOIN c ON c.node = ours WHERE l1 IS NOT NULL),
m AS (SELECT ours, theirs, x.ancestor AS base, y.distance, row_number() OVER (PARTITION BY ours, theirs ORDER BY y.distance, x.ancestor DESC) AS k
      FROM q JOIN cl x ON x.node = ours JOIN cl y ON y.node = theirs AND y.ancestor = x.ancestor)
SELECT ours, theirs, base, distance FROM m WHERE k = 1""")
def merge_base(spark, sf_dir):
    """Nearest common ancestor of each customer's last two commits."""
    found = commits(spark, sf_dir)
    before = found.select("cust", F.col("node").alias("ours"), G.previous_in(found, "cust", "node", "node").alias("theirs"), F.lead("node").over(Window.partitionBy("cust").orderBy("node")).alias("_next"))
    pairs = materialise(before.where("theirs is not null and _next is null").select("ours", "theirs"))
    asked = pairs.select(F.col("ours").alias("node")).union(pairs.select(F.col("theirs").alias("node")))
    return G.merge_bases(G.ancestors(materialise(parents(found)), asked), pairs)


@query(COMMITS + """, f AS (SELECT node, node AS ancestor, 0 AS distance FROM c UNION ALL SELECT f.node, e.parent, f.distance + 1 FROM f JOIN e ON f.ancestor = e.child AND e.k = 1)
SELECT node, ancestor, distance FROM f WHERE distance IN (0, 1, 3, 7, 15, 31) AND node IN (SELECT max(node) FROM c GROUP BY cust HAVING count(*) > 1)""")
def first_parent_probe(spark, sf_dir):
    """Each customer's tip and its first-parent ancestors at 1, 3, 7, ... steps."""
    found = commits(spark, sf_dir)
    tips = found.groupBy("cust").agg(F.max("node").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    first = materialise(found.where("p1 is not null").select(F.col("node").alias("child"), F.col("p1").alias("parent")))
    return G.probe_depths(G.ancestors(first, tips))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def log_newest_first(spark, sf_dir):
    return G.newest_first(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 100)


REACHABLE = COMMITS + ", tips AS (SELECT node FROM c JOIN orders ON o_orderkey = node WHERE o_orderstatus = 'O'), r AS (SELECT DISTINCT ancestor AS node FROM cl WHERE node IN (SELECT node FROM tips)), parts AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_orderkey IN (SELECT node FROM r)) "


def _reached(spark, sf_dir) -> DataFrame:
    found = materialise(commits(spark, sf_dir))
    return G.reachable(materialise(parents(found)), found.where("o_orderstatus = 'O'").select("node"))


def _reached_objects(spark, sf_dir, reached: DataFrame) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("object"))
    parts = lines.join(reached, "node", "left_semi").select("object").distinct()
    return reached.select(F.lit("commit").alias("kind"), F.col("node").alias("object")).union(parts.select(F.lit("raw"), "object"))


@query(REACHABLE + "SELECT 'commit' AS kind, node AS object FROM r UNION ALL SELECT 'raw', part FROM parts")
def reachable_objects(spark, sf_dir):
    """Commits reachable from the tips and the parts that their lines refer to."""
    return _reached_objects(spark, sf_dir, _reached(spark, sf_dir))


@query(REACHABLE + """SELECT 'commit' AS kind, o_orderkey AS object, 0 AS size FROM orders WHERE o_orderkey NOT IN (SELECT node FROM r)
UNION ALL SELECT 'raw', p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT part FROM parts)""")
def gc_prune(spark, sf_dir):
    """Commits that no open order reaches, and parts that only their lines refer to."""
    live = materialise(_reached_objects(spark, sf_dir, _reached(spark, sf_dir)))
    commits_ = table(spark, sf_dir, "orders").select(F.lit("commit").alias("kind"), F.col("o_orderkey").alias("object"), F.lit(0).alias("size"))
    stored = commits_.union(table(spark, sf_dir, "part").select(F.lit("raw"), F.col("p_partkey"), F.col("p_size")))
    return T.collectable(stored, live, ["kind", "object"])


SIDES = """
WITH base AS (SELECT c_custkey AS k, round(c_acctbal * 100)::BIGINT AS v FROM customer WHERE c_custkey % 17 <> 0),
ours AS (SELECT c_custkey AS k, round(c_acctbal * 100)::BIGINT + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS v FROM customer WHERE c_custkey % 11 <> 0),
theirs AS (SELECT c_custkey AS k, round(c_acctbal * 100)::BIGINT + CASE WHEN c_custkey % 7 = 0 THEN 2 WHEN c_custkey % 35 = 5 THEN 1 ELSE 0 END AS v FROM customer WHERE c_custkey % 13 <> 0),
m AS (SELECT k, b.v AS base, o.v AS ours, t.v AS theirs FROM ours o FULL JOIN theirs t USING (k) LEFT JOIN base b USING (k)),
z AS (SELECT *, CASE WHEN ours IS NULL AND theirs IS NULL THEN 'Unchanged' WHEN ours IS NULL THEN CASE WHEN base IS NOT NULL THEN 'Conflict' ELSE 'TakeTheirs' END
  WHEN theirs IS NULL THEN CASE WHEN base IS NOT NULL THEN 'Conflict' ELSE 'TakeOurs' END WHEN ours = theirs THEN 'Unchanged' WHEN base IS NULL THEN 'Conflict'
  WHEN ours <> base AND theirs <> base THEN 'Conflict' WHEN ours <> base THEN 'TakeOurs' ELSE 'TakeTheirs' END AS outcome FROM m)
"""


def _merged(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    rows = table(spark, sf_dir, "customer")
    side = lambda drop, more: rows.where(k % drop != 0).select(k.alias("k"), (cents + more).alias("v"))
    ours = side(11, F.when(k % 5 == 0, 1).otherwise(0))
    theirs = side(13, F.when(k % 7 == 0, 2).when(k % 35 == 5, 1).otherwise(0))
    return D.three_way(side(17, F.lit(0)), ours, theirs, "k", "v")


def _shown(merged: DataFrame) -> DataFrame:
    """-1 for what a side doesn't have."""
    return merged.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("base", "ours", "theirs")})


@query(SIDES + "SELECT k, coalesce(base, -1) AS base, coalesce(ours, -1) AS ours, coalesce(theirs, -1) AS theirs, outcome FROM z")
def three_way_merge(spark, sf_dir):
    return _shown(_merged(spark, sf_dir)).select("k", "base", "ours", "theirs", "outcome")


@query(SIDES + "SELECT k, coalesce(base, -1) AS base, coalesce(ours, -1) AS ours, coalesce(theirs, -1) AS theirs FROM z WHERE outcome = 'Conflict'")
def merge_conflicts(spark, sf_dir):
    return _shown(_merged(spark, sf_dir).where("outcome = 'Conflict'")).select("k", "base", "ours", "theirs")


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS n, sum(round(l_extendedprice * 100)::BIGINT) AS full_bytes, sum(round(l_extendedprice * l_quantity / 50 * 100)::BIGINT) AS delta_bytes FROM lineitem GROUP BY 1),
i AS (SELECT *, l_orderkey % 9 <> 0 AS has_base, l_orderkey % 8 <> 0 AS alignable, l_orderkey % 7 AS depth FROM g)
SELECT l_orderkey, delta_bytes::BIGINT AS delta_bytes, full_bytes::BIGINT AS full_bytes, CASE WHEN NOT has_base THEN 'full_no_base' WHEN NOT alignable THEN 'full_not_alignable'
  WHEN depth + 1 > 5 THEN 'full_chain_depth' WHEN delta_bytes > 0.5 * full_bytes THEN 'full_large_delta' ELSE 'delta' END AS decision FROM i
""")
def snapshot_decision(spark, sf_dir):
    cents = lambda c: F.round(c * 100).cast("long")
    price = F.col("l_extendedprice")
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(cents(price * F.col("l_quantity") / 50)).alias("delta_bytes"), F.sum(cents(price)).alias("full_bytes"))
    k = F.col("l_orderkey")
    return g.select("l_orderkey", "delta_bytes", "full_bytes", D.snapshot(k % 9 != 0, k % 8 != 0, k % 7, F.col("delta_bytes"), F.col("full_bytes")).alias("decision"))


@query("""
WITH RECURSIVE m AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 40 = 6 THEN 'full' ELSE 'delta' END AS mode FROM part),
n AS (SELECT p_partkey AS node, p_partkey // 2 AS needs FROM part WHERE p_partkey > 0),
f AS (SELECT node FROM m WHERE mode = 'full' UNION SELECT n.node FROM f JOIN n ON n.needs = f.node)
SELECT node, CASE WHEN node IN (SELECT node FROM f) THEN 'full' ELSE mode END AS mode FROM m
""")
def dependency_downgrade(spark, sf_dir):
    """Part k needs part k div 2; what needs a full part, at any remove, becomes full."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    modes = part.select(k.alias("node"), F.when(k % 40 == 6, "full").otherwise("delta").alias("mode"))
    return D.downgraded(modes, part.where(k > 0).select(k.alias("node"), F.floor(k / 2).alias("needs")))


def _axis_links(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("l_orderkey").alias("a"), (-1 - F.col("l_partkey")).alias("b"))


@query()
def axis_components(spark, sf_dir):
    """Components of a bipartite graph of axes (orders) and groups (parts), over every line.

    SQL would list all pairs of a component that holds nearly every node; the tests compare with union-find.
    """
    return G.components(_axis_links(table(spark, sf_dir, "lineitem")))


DELTAS = ", d AS (SELECT node AS commit, CASE WHEN node % 29 = 3 THEN lead(node) OVER (ORDER BY node) ELSE CASE WHEN pos = 1 THEN root ELSE l2 END END AS base FROM c WHERE pos >= 1) "


def _deltas(found: DataFrame) -> DataFrame:
    """Each commit's delta base is its first parent, save for planted ones, whose base is the next commit of any customer."""
    from tessera.operators.sequences import neighbours

    # The next key in order is, seen from the other end, the one before.
    flipped = found.where("pos >= 1").withColumn("_k", F.lit(1 << 40) - F.col("node"))
    after = neighbours(flipped, "_k", {"_next": F.col("node")})
    return after.select(F.col("node").alias("commit"), F.when(F.col("node") % 29 == 3, F.col("_next")).otherwise(F.col("p1")).alias("base")).where("base is not null")


@query(COMMITS + DELTAS + "SELECT commit, base FROM d WHERE base IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.node = d.commit AND cl.ancestor = d.base)")
def ancestor_invariant(spark, sf_dir):
    found = commits(spark, sf_dir)
    deltas = materialise(_deltas(found))
    return D.not_ancestors(deltas, G.ancestors(materialise(parents(found)), deltas.select(F.col("commit").alias("node"))))


@query(COMMITS + DELTAS + """
SELECT 'AncestorInvariantViolated' AS kind, commit AS object FROM d WHERE base IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.node = d.commit AND cl.ancestor = d.base)
UNION ALL SELECT 'MissingObject', l_orderkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_partkey % 53 = 11
UNION ALL SELECT 'DepthMismatch', child FROM (SELECT e.child, x.pos // 2 + CASE WHEN x.node % 31 = 7 THEN 1 ELSE 0 END AS depth, y.pos // 2 + CASE WHEN y.node % 31 = 7 THEN 1 ELSE 0 END AS base_depth, x.pos AS p FROM e JOIN c x ON x.node = e.child JOIN c y ON y.node = e.parent WHERE k = 1) WHERE depth <> base_depth + 1 AND p >= 2
""")
def verify_findings(spark, sf_dir):
    """Broken ancestor bases, references to objects that aren't stored, and chain depths that don't follow their base."""
    found = commits(spark, sf_dir)
    wrong = ancestor_invariant(spark, sf_dir).select(F.lit("AncestorInvariantViolated").alias("kind"), F.col("commit").alias("object"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object"), F.col("l_partkey").alias("part")).distinct()
    stored = table(spark, sf_dir, "part").where("p_partkey % 53 <> 11").select(F.col("p_partkey").alias("part"))
    lost = T.missing(lines, stored, "part").select(F.lit("MissingObject"), "object")
    depth = F.floor(F.col("pos") / 2) + F.when(F.col("node") % 31 == 7, 1).otherwise(0)
    deep = found.select("node", "p1", "pos", depth.alias("depth"))
    base = deep.select(F.col("node").alias("p1"), F.col("depth").alias("base_depth"))
    off = deep.where("pos >= 2").join(base, "p1").where("depth <> base_depth + 1").select(F.lit("DepthMismatch"), F.col("node"))
    return wrong.union(lost).union(off)


@query("""
WITH r AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 23 = 4 THEN NULL ELSE p_size END AS size FROM part),
l AS (SELECT p_partkey AS path, p_size + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS size FROM part WHERE p_partkey % 9 <> 0)
SELECT r.path, coalesce(r.size, -1) AS size, CASE WHEN l.path IS NULL THEN 'missing' ELSE 'differs' END AS reason FROM r LEFT JOIN l USING (path) WHERE l.path IS NULL OR r.size IS DISTINCT FROM l.size
""")
def inventory_diff(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    remote = part.select(k.alias("path"), F.when(k % 23 == 4, F.lit(None)).otherwise(F.col("p_size")).alias("size"))
    local = part.where(k % 9 != 0).select(k.alias("path"), (F.col("p_size") + F.when(k % 10 == 0, 1).otherwise(0)).alias("size"))
    return T.inventory_difference(remote, local, "path", "size").select("path", F.coalesce("size", F.lit(-1)).alias("size"), "reason")


@query("""
WITH h AS (SELECT conv_id, turn, sha256(coalesce(text, '')) AS d FROM conversations)
SELECT conv_id, count(*)::BIGINT AS commits, count(DISTINCT d)::BIGINT AS objects, max(turn) AS depth FROM h GROUP BY conv_id
""")
def verify_counters(spark, sf_dir):
    """Short linear histories: commits walked, distinct objects, longest chain."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("d"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("d").alias("objects"), F.max("turn").alias("depth"))


@query("""
SELECT p_partkey, NOT (p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0) AS identity,
       NOT (p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 7 <> 0) AS no_evidence FROM part
""")
def group_predicates(spark, sf_dir):
    """Pinned, unreported, identity and not alignable groups: which need no permutation, which have no evidence."""
    k = F.col("p_partkey")
    pinned, reported, same, fits = k % 4 == 0, k % 3 != 0, k % 5 == 0, k % 7 != 0
    return table(spark, sf_dir, "part").select("p_partkey", D.effectively_identity(pinned, reported, same, fits).alias("identity"), D.without_evidence(pinned, reported, fits).alias("no_evidence"))


@query("""
WITH g AS (SELECT n_nationkey AS grp, CASE WHEN n_nationkey = 3 THEN 0 ELSE n_nationkey + 2 END AS size FROM nation),
b AS (SELECT c_custkey AS tensor, CASE WHEN c_custkey % 37 = 5 THEN 99 ELSE c_nationkey END AS grp, CASE WHEN c_custkey % 41 = 6 THEN 2 ELSE 0 END AS dim FROM customer),
s AS (SELECT c_custkey AS tensor, (c_nationkey + 2 + CASE WHEN c_custkey % 43 = 7 THEN 1 ELSE 0 END) * 4 AS extent FROM customer WHERE c_custkey % 47 <> 8)
SELECT 'EmptyGroup' AS kind, grp::VARCHAR AS object FROM g WHERE size <= 0
UNION ALL SELECT * FROM (SELECT CASE WHEN extent IS NULL THEN 'UnknownTensor' WHEN dim >= 2 THEN 'DimOutOfRange' WHEN size IS NULL THEN 'UnknownGroup' WHEN extent <> size * 4 THEN 'ShapeMismatch' END AS kind, tensor::VARCHAR AS object
  FROM b LEFT JOIN s USING (tensor) LEFT JOIN g USING (grp)) WHERE kind IS NOT NULL
""")
def topology_validate(spark, sf_dir):
    """Planted faults of groups and axis bindings."""
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    cust = table(spark, sf_dir, "customer")
    groups = table(spark, sf_dir, "nation").select(n.cast("string").alias("group"), F.when(n == 3, 0).otherwise(n + 2).alias("size"))
    bindings = cust.select(k.cast("string").alias("tensor"), F.when(k % 41 == 6, 2).otherwise(0).alias("dim"), F.when(k % 37 == 5, 99).otherwise(F.col("c_nationkey")).cast("string").alias("group"), F.lit(4).alias("block"))
    extent = (F.col("c_nationkey") + 2 + F.when(k % 43 == 7, 1).otherwise(0)) * 4
    shapes = cust.where(k % 47 != 8).select(k.cast("string").alias("tensor"), F.array(extent, F.lit(8)).alias("shape"))
    return D.topology_findings(groups, bindings, shapes)


@query("""
WITH b AS (SELECT 'g' || (p_partkey // 5) AS grp, (p_partkey // 5) || CASE p_partkey % 5 WHEN 0 THEN '.weight' WHEN 1 THEN '.bias' WHEN 2 THEN CASE WHEN p_partkey % 3 = 0 THEN '.running_mean' ELSE '.scale' END WHEN 3 THEN '.beta' ELSE '.weight' END AS tensor FROM part),
s AS (SELECT tensor, any_value(grp) AS grp FROM b GROUP BY tensor HAVING count(*) = 1)
SELECT grp AS "group", tensor, regexp_extract(tensor, '[^.]+$') AS role FROM s WHERE grp IN (SELECT grp FROM s WHERE tensor LIKE '%.running_mean')
""")
def norm_tensors(spark, sf_dir):
    """Members of normalised groups by role; tensors with two axes bound don't count."""
    k, g = F.col("p_partkey"), F.floor(F.col("p_partkey") / 5).cast("string")
    name = F.when(k % 5 == 0, ".weight").when(k % 5 == 1, ".bias").when(k % 5 == 2, F.when(k % 3 == 0, ".running_mean").otherwise(".scale")).when(k % 5 == 3, ".beta").otherwise(".weight")
    return D.norm_members(table(spark, sf_dir, "part").select(F.concat(F.lit("g"), g).alias("group"), F.concat(g, name).alias("tensor")))
