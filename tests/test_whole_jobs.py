"""Queries over whole tables against brute force."""

import duckdb
import numpy as np
import pytest

from tessera.functions import residual as R
from tessera.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def brute_components(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {n: find(n) for n in up}


def test_axis_components_of_every_line(spark, tmp_path):
    rows = [(1, 7, 1), (1, 8, 2), (3, 8, 1), (3, 9, 2), (4, 9, 1), (5, 20, 1), (6, 20, 3), (9, 30, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {r["node"]: r["comp"] for r in QUERIES["axis_components"](spark, str(tmp_path)).collect()}
    assert found == brute_components([(o, -1 - p) for o, p, _ in rows]) and len(set(found.values())) == 3
    links = duckdb.sql(f"SELECT l_orderkey, -1 - l_partkey FROM '{DATA}/lineitem.parquet'").fetchall()
    found = {r["node"]: r["comp"] for r in QUERIES["axis_components"](spark, DATA).collect()}
    assert found == brute_components(links)


@pytest.mark.parametrize("transform", ["byteplane", "bitshuffle"])
def test_residual_roundtrip_sees_the_end_of_a_text(spark, tmp_path, monkeypatch, transform):
    texts = ["", "short", "é" * 50, "x" * 64, "the last byte of a longer text counts as well " * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda: {(r["doc_id"], r["transform"]): r["same"] for r in QUERIES["residual_roundtrip"](spark, str(tmp_path)).collect()}
    assert len(run()) == 3 * len(texts) and all(run().values())
    apply, undo = R.TRANSFORMS[transform]
    # Loses the last byte of what isn't a multiple of 64 bytes.
    monkeypatch.setitem(R.TRANSFORMS, transform, (apply, lambda raw, width: undo(raw, width) if len(raw) % 64 == 0 else undo(raw, width)[:-1] + b"?"))
    assert {k for k, same in run().items() if not same} == {(i, transform) for i, t in enumerate(texts) if len(t.encode()) % 64}


def test_dependency_runs_of_every_slice(spark, tmp_path):
    n = 400
    spark.range(n).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    found = {(r["slice"], r["first"], r["count"]) for r in QUERIES["dependency_runs"](spark, str(tmp_path)).collect()}
    want = set()
    for k in range(0, n, 64):
        units = {(i * 7 + 3) % n for i in range(k, min(k + 64, n))}
        for u in (u for u in units if u - 1 not in units):
            want.add((k // 64, u, next(m for m in range(1, n + 1) if u + m not in units)))
    assert found == want and sum(c for _, _, c in found) == n


def test_reachable_objects_from_every_open_order(spark, tmp_path):
    # Each order is its customer's only one; the open ones are no multiples of 4.
    for name, rows, columns in (
        ("orders", [(1, 1, "O"), (2, 2, "O"), (3, 3, "F"), (5, 4, "P")], "o_orderkey long, o_custkey long, o_orderstatus string"),
        ("lineitem", [(1, 10), (2, 11), (3, 12), (5, 13)], "l_orderkey long, l_partkey long"),
        ("part", [(k, k) for k in range(10, 15)], "p_partkey long, p_size int"),
    ):
        frame = spark.createDataFrame(rows, columns)
        (frame.selectExpr("*", "current_date() AS o_orderdate") if name == "orders" else frame).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = {tuple(r) for r in QUERIES["reachable_objects"](spark, str(tmp_path)).collect()}
    assert found == {("commit", 1), ("commit", 2), ("raw", 10), ("raw", 11)}
    pruned = {(r["kind"], r["object"]) for r in QUERIES["gc_prune"](spark, str(tmp_path)).collect()}
    assert pruned == {("commit", 3), ("commit", 5), ("raw", 12), ("raw", 13), ("raw", 14)}


@pytest.mark.parametrize("name", ["jv_assignment", "greedy_assignment", "auction_assignment", "solver_choice"])
def test_assignments_where_the_numbers_of_target_units_repeat(spark, tmp_path, name):
    n = 21
    x = np.random.default_rng(0).normal(size=(n, 64))
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.sql(ORACLES[name])
    found = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
