"""PageRank with hubs cut into parts: the same ranks, and no task with far more edges than the others."""
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import graph as G


@pytest.fixture(scope="module")
def star(spark):
    hub = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), (1 + F.col("id") % 3).cast("double").alias("weight"))
    back = spark.range(1, 3000).select(F.col("id").alias("src"), (F.col("id") * 7 % 50).alias("dst"), F.lit(1.0).alias("weight"))
    return hub.unionByName(back)


def test_cut_hubs_give_the_same_ranks(star):
    whole, ok, n = G.pagerank(star, max_iter=6, tol=None)
    parts, ok2, n2 = G.pagerank(star, max_iter=6, tol=None, hub_edges=1000)
    assert (ok, n) == (ok2, n2)
    one, two = (dict(map(tuple, x.collect())) for x in (whole, parts))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-12) for k in one)


def test_a_hub_is_spread(spark, star):
    known = star.select("src", "dst", F.col("weight").alias("w"), F.lit(1.0).alias("_s")).where("src = 0").withColumn("_d", F.lit(20_000))
    hubs, edges = G._hub_transitions(known, 1000, 16)
    assert [tuple(r) for r in hubs.collect()] == [(0, 20)]
    sizes = [r["count"] for r in edges.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2 * statistics.median(sizes)
    per_part = [r["count"] for r in edges.groupBy("_part").count().collect()]
    assert len(per_part) == 20 and max(per_part) <= 2 * statistics.median(per_part)
