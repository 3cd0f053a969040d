"""Graph operators over edge tables: components, closures, merge bases and fixed points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise


def components(links: DataFrame, part_rows: int | None = None) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the smallest node that is reachable.

    Each round takes the smallest label among neighbours and then that label's own
    label, so the distance a label travels doubles. Minima are aggregated before they
    are shuffled and both joins can be split by the optimiser where a node has very many links.
    With ``part_rows`` the tables of a round have one partition for so many links, so that
    few links don't make many files.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialise(edges)
    parts = max(1, -(-edges.count() // part_rows)) if part_rows else None
    fit = (lambda df: df.coalesce(parts)) if parts else (lambda df: df)
    edges = fit(edges)
    labels = materialise(fit(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"))))
    while True:
        offered = edges.join(labels, edges.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("comp").alias("m"))
        near = labels.join(offered, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        own = near.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        moved = materialise(fit(near.join(own, "comp").select("node", "old", F.least("comp", "up").alias("comp"))))
        labels = moved.select("node", "comp")
        if moved.where("old <> comp").isEmpty():
            return labels


def ancestors(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, distance) of the edges (child, parent), each node its own at 0; distance is the shortest.

    With ``of`` only the ancestors of those nodes are followed. A round joins the pairs
    found last with the edges; a pair that is already known never enters the next round, so
    merges don't multiply paths, and what earlier rounds found is not written again.
    """
    if of is None:
        of = edges.select(F.col("child").alias("node")).union(edges.select(F.col("parent").alias("node")))
    front = materialise(of.select("node").distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")))
    found, step = front, 0
    while True:
        step += 1
        reached = front.join(edges, front.ancestor == edges.child).select("node", F.col("parent").alias("ancestor")).distinct()
        front = materialise(reached.join(found, ["node", "ancestor"], "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            return found
        found = found.union(front)


def reachable(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """Distinct nodes reachable from the tips (node), tips included."""
    front = found = materialise(tips.select("node").distinct())
    while True:
        step = front.join(edges, front.node == edges.child).select(F.col("parent").alias("node")).distinct()
        front = materialise(step.join(found, "node", "left_anti"))
        if front.isEmpty():
            return found
        found = found.union(front)


def merge_bases(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (ours, theirs): the ancestor of both that is nearest to theirs, ties to the larger node."""
    mine = closure.select(F.col("node").alias("ours"), "ancestor")
    other = closure.select(F.col("node").alias("theirs"), "ancestor", "distance")
    both = pairs.join(mine, "ours").join(other, ["theirs", "ancestor"])
    best = both.groupBy("ours", "theirs").agg(F.min(F.struct("distance", (-F.col("ancestor")).alias("m"))).alias("b"))
    return best.select("ours", "theirs", (-F.col("b.m")).alias("base"), F.col("b.distance").alias("distance"))


def spread(edges: DataFrame, start: DataFrame) -> DataFrame:
    """The fixed point of: a node joins the set when something it depends on is in it; edges (node, needs)."""
    return reachable(edges.select(F.col("needs").alias("child"), F.col("node").alias("parent")), start)


def topological_levels(edges: list[tuple[str, str]], nodes: list[str]) -> list[str]:
    """Nodes in dependency order, alphabetically among the ready ones; a cycle gives plain alphabetical order."""
    import heapq

    waits = {n: 0 for n in nodes}
    after: dict[str, set[str]] = {n: set() for n in nodes}
    for before, then in set(edges):
        if before != then and then not in after[before]:
            after[before].add(then)
            waits[then] += 1
    ready, out = sorted(n for n in nodes if not waits[n]), []
    heapq.heapify(ready)
    while ready:
        n = heapq.heappop(ready)
        out.append(n)
        for then in after[n]:
            waits[then] -= 1
            if not waits[then]:
                heapq.heappush(ready, then)
    return out if len(out) == len(nodes) else sorted(nodes)


def probe_depths(closure_first_parent: DataFrame) -> DataFrame:
    """First-parent ancestors at distances 0, 1, 3, 7, ...: one less than a power of two."""
    return closure_first_parent.where(F.bit_count(F.col("distance") + 1) == 1)


def newest_first(commits: DataFrame, when: str, key: str, n: int) -> DataFrame:
    return commits.orderBy(F.desc(when), F.desc(key)).limit(n)


def previous_in(df: DataFrame, group: str, order: str, column: str, back: int = 1):
    return F.lag(column, back).over(Window.partitionBy(group).orderBy(order))
