"""The skew-safe plans must give exactly the plain plans' results."""
import math

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from ledgerscope import schema as S
from ledgerscope.operators import causal as C
from ledgerscope.operators.ordered import global_positions, ordered_prefix, rank_pct
from ledgerscope.sources import transactions as TX


def _assert_same(a, b, key=S.ID):
    pa = a.toPandas().sort_values(key).reset_index(drop=True)
    pb = b.toPandas().sort_values(key).reset_index(drop=True)
    assert list(pa.columns) == list(pb.columns)
    assert len(pa) == len(pb)
    for c in pa.columns:
        for x, y in zip(pa[c], pb[c]):
            if isinstance(x, float) and isinstance(y, float):
                assert (math.isnan(x) and math.isnan(y)) or math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-9), c
            else:
                assert x == y, c


def test_chunked_causal_equals_plain(spark):
    tx = TX.load_transactions(spark, SF001)
    plain = C.add_causal_features(tx, mode="plain")
    # every (account, period) group with more than one row is "hot" and split;
    # rolling blocks of 25 rows carry a 20-row halo
    chunked = C.add_causal_features(tx, mode="chunked", max_rows_per_task=1, block_rows=25)
    _assert_same(plain, chunked)


def test_auto_mode_switches_on_hot_accounts(spark):
    tx = TX.load_transactions(spark, SF001)
    assert C._choose_mode(tx, [S.ORIGIN, S.DEST], "auto", 10) == "chunked"
    assert C._choose_mode(tx, [S.ORIGIN, S.DEST], "auto", 10 ** 9) == "plain"


def test_partition_count_invariance(spark):
    tx = TX.load_transactions(spark, SF001)
    one = C.add_causal_features(tx.repartition(1), mode="plain")
    seven = C.add_causal_features(tx.repartition(7), mode="plain")
    _assert_same(one, seven)


def test_causality(spark):
    tx = TX.load_transactions(spark, SF001)
    cut = 70
    full = C.add_causal_features(tx).filter(F.col(S.PERIOD) < cut)
    early = C.add_causal_features(tx.filter(F.col(S.PERIOD) < cut))
    _assert_same(full, early)


def test_ordered_prefix_matches_window(spark):
    tx = TX.load_transactions(spark, SF001)
    per = tx.groupBy(S.AMOUNT).agg(F.count(F.lit(1)).alias("n"))
    got = ordered_prefix(per, S.AMOUNT, {"c": F.col("n")}, n_buckets=16, inclusive=False)
    pdf = per.toPandas().sort_values(S.AMOUNT)
    exp = dict(zip(pdf[S.AMOUNT], pdf["n"].cumsum() - pdf["n"]))
    for r in got.collect():
        assert r["c"] == exp[r[S.AMOUNT]]


def test_global_positions_total_order(spark):
    tx = TX.load_transactions(spark, SF001)
    pos = global_positions(tx.select(S.ID, S.PERIOD).repartition(5), [S.PERIOD, S.ID]).toPandas()
    pdf = pos.sort_values([S.PERIOD, S.ID]).reset_index(drop=True)
    assert list(pdf["pos"]) == list(range(len(pdf)))


def test_rank_pct_matches_pandas(spark):
    tx = TX.load_transactions(spark, SF001)
    got = rank_pct(tx.select(S.ID, S.AMOUNT), S.AMOUNT, "r", n_buckets=8).toPandas().set_index(S.ID)["r"]
    pdf = tx.select(S.ID, S.AMOUNT).toPandas().set_index(S.ID)[S.AMOUNT]
    exp = pdf.rank(method="average", pct=True)
    assert ((got.sort_index() - exp.sort_index()).abs() < 1e-12).all()


def test_exact_quantiles_match_percentile_with_a_hot_group(spark):
    from ledgerscope.operators.ordered import exact_quantiles
    tx = TX.load_transactions(spark, SF001)
    # one group holds every row, the others are the origin accounts
    x = tx.select(F.lit(-1).cast("long").alias("g"), S.AMOUNT).unionByName(
        tx.select(F.col(S.ORIGIN).alias("g"), S.AMOUNT))
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(len(qs))]
           for r in exact_quantiles(x, S.AMOUNT, qs, ["g"], n_buckets=8).collect()}
    exp = {r["g"]: list(r["p"]) for r in x.groupBy("g").agg(F.percentile(S.AMOUNT, qs).alias("p")).collect()}
    assert got == exp


def test_chunked_plan_keeps_rows_without_account_or_period(spark):
    tx = TX.load_transactions(spark, SF001)
    tx = (tx.withColumn(S.DEST, F.when(F.col(S.ID) % 10 != 0, F.col(S.DEST)))
            .withColumn(S.ORIGIN, F.when(F.col(S.ID) % 7 != 0, F.col(S.ORIGIN)))
            .withColumn(S.PERIOD, F.when(F.col(S.ID) % 31 != 0, F.col(S.PERIOD))))
    # a null period sorts first in its account in both plans
    _assert_same(C.add_causal_features(tx, mode="plain"),
                 C.add_causal_features(tx, mode="chunked", max_rows_per_task=15, block_rows=32))


def test_pagerank_keeps_small_ranks_apart(spark):
    """Ranks are rounded relative to 1/N: a chain ending in a star keeps its different ranks."""
    from ledgerscope.operators import graph as G
    edges = spark.range(20000).selectExpr("id as src", "id + 100000 as dst", "cast(1 as double) as weight").unionAll(
        spark.range(3).selectExpr("id as src", "cast(7 as bigint) as dst", "cast(1 as double) as weight"))
    ranks, _, _ = G.pagerank(edges, max_iter=3, tol=None)
    n = ranks.count()
    got = ranks.selectExpr(f"round(pagerank * {n}, 6) as r").distinct().count()
    assert got >= 4 and abs(ranks.agg(F.sum("pagerank")).first()[0] - 1) < 1e-6


def test_only_a_local_master_gets_a_temporary_folder():
    from ledgerscope import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://driver:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())
