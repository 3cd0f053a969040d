"""Operators on small tables with edge cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import integers as I
from tessera.operators import decisions as D
from tessera.operators import graph as G
from tessera.operators import sequences as Q
from tessera.operators import store as T
from tessera.streaming.streak import streaks, streaming_streaks


def test_islands_and_totals_across_buckets(spark):
    keys = [0, 1, 2, 7, 8, 9, 10, 20, 21, 40]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert sorted(map(tuple, Q.islands(df, "k", bucket=4).collect())) == [(0, 3), (7, 4), (20, 2), (40, 1)]
    total = Q.running_total(df, "k", "k", bucket=4).collect()
    assert {r["k"]: r["before"] for r in total} == {k: sum(x for x in keys if x < k) for k in keys}
    assert Q.islands(df.limit(0), "k").isEmpty()


def test_range_lookup_boundaries(spark):
    spans = spark.createDataFrame([(1, 0, 16), (2, 16, 116), (3, 116, 116), (4, 200, 300)], "id int, a long, b long")
    probes = spark.createDataFrame([(x,) for x in (0, 15, 16, 115, 116, 199, 200, 299, 300)], "x long")
    found = {r["x"]: r["id"] for r in Q.range_lookup(probes, spans, "x", "a", "b", 32).collect()}
    assert found == {0: 1, 15: 1, 16: 2, 115: 2, 200: 4, 299: 4}


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)]
    found = {r["node"]: r["comp"] for r in G.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(21)) and all(found[100 + i] == 100 for i in range(30))


@pytest.mark.parametrize(
    ("base", "ours", "theirs", "outcome"),
    [
        (None, None, None, "Unchanged"), (None, "x", None, "TakeOurs"), (None, None, "x", "TakeTheirs"), ("x", None, "x", "Conflict"), ("x", "x", None, "Conflict"),
        ("x", "x", "x", "Unchanged"), ("x", "y", "y", "Unchanged"), (None, "x", "y", "Conflict"), ("x", "y", "z", "Conflict"), ("x", "y", "x", "TakeOurs"), ("x", "x", "y", "TakeTheirs"),
    ],
)
def test_merge_table(spark, base, ours, theirs, outcome):
    df = spark.createDataFrame([(base, ours, theirs)], "b string, o string, t string")
    assert df.select(D.resolution(F.col("b"), F.col("o"), F.col("t"))).first()[0] == outcome


@pytest.mark.parametrize(
    ("has_base", "alignable", "depth", "delta", "full", "why"),
    [(False, True, 0, 1, 9, "full_no_base"), (True, False, 0, 1, 9, "full_not_alignable"), (True, True, 5, 1, 9, "full_chain_depth"), (True, True, 4, 1, 9, "delta"), (True, True, 0, 5, 10, "delta"), (True, True, 0, 6, 10, "full_large_delta")],
)
def test_snapshot_policy(spark, has_base, alignable, depth, delta, full, why):
    df = spark.createDataFrame([(has_base, alignable, depth, delta, full)], "h boolean, a boolean, d int, x long, f long")
    assert df.select(D.snapshot(F.col("h"), F.col("a"), F.col("d"), F.col("x"), F.col("f"))).first()[0] == why


def test_collection_without_tips_drops_nothing(spark):
    stored = spark.createDataFrame([("a",), ("b",)], "oid string")
    assert T.collectable(stored, stored.limit(0)).isEmpty()
    assert [r[0] for r in T.collectable(stored, stored.where("oid = 'a'")).collect()] == ["b"]


def test_chunks(spark):
    df = spark.createDataFrame([(0, 1), (65535, 2), (65536, 0), (10, 200000)], "off long, n long")
    got = df.select(I.first_chunk(F.col("off")), I.last_chunk(F.col("off"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 1), (1, None), (0, 3)]


def test_streaming_streaks_agree_with_the_batch(spark, tmp_path):
    reads = spark.createDataFrame([(h, f"2024-01-01 00:00:{i:02d}", i, i if h == 1 or i != 3 else 9, 1) for h in (1, 2) for i in range(6)], "handle long, ts string, event_id long, off int, len int")
    reads = reads.withColumn("ts", F.col("ts").cast("timestamp"))
    reads.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    q = streaming_streaks(stream).writeStream.format("memory").queryName("streaks").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in streaks(reads).select("handle", "event_id", "streak", "prefetch").collect()}
    assert {tuple(r) for r in spark.sql("select handle, event_id, streak, prefetch from streaks").collect()} == want
