"""Graph, encoding, metric, fusion and submission micro-fixtures."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import tx_frame
from ledgerscope import schema as S
from ledgerscope.operators import encoding as EN
from ledgerscope.operators import fusion as FU
from ledgerscope.operators import graph as G
from ledgerscope.operators import metrics as M
from ledgerscope.operators import submission as SU
from ledgerscope.operators.ordered import rank_pct


def _edge_rows(pairs):
    return [(i, 0, "op_01", 1.0, a, 0.0, 0.0, b, 0.0, 0.0, 0) for i, (a, b) in enumerate(pairs)]


def test_two_cycles(spark):
    # self-loop 5->5, one-way 1->2 (a<b), one-way 4->3 (a>b), reciprocal 6<->7 (twice 6->7)
    df = tx_frame(spark, _edge_rows([(5, 5), (1, 2), (4, 3), (6, 7), (6, 7), (7, 6)]))
    o, d = G.reciprocal_pairs(df)
    o = {r["account"]: r["o_cycle2_count"] for r in o.collect()}
    d = {r["account"]: r["d_cycle2_count"] for r in d.collect()}
    assert o == {1: 1, 6: 3} and d == {2: 1, 7: 3}


def test_pagerank_star_with_dangling_hub(spark):
    edges = spark.createDataFrame([(1, 0, 2.0), (2, 0, 1.0), (3, 0, 0.0), (0, 0, 0.0)][:3],
                                  "src long, dst long, weight double")
    ranks, conv, _ = G.pagerank(edges)
    pr = {r["node"]: r["pagerank"] for r in ranks.collect()}
    assert conv and math.isclose(sum(pr.values()), 1.0, abs_tol=1e-9)
    # node 3's only edge has weight 0: it is dangling like the hub
    assert pr[0] > pr[1] and math.isclose(pr[1], pr[2], abs_tol=1e-12) and math.isclose(pr[3], pr[1], abs_tol=1e-12)


def test_rank_pct_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, 5.0)], "id long, v double")
    out = {r["id"]: r["r"] for r in rank_pct(df, "v", "r").collect()}
    assert out == {1: 0.375, 2: 0.375, 3: 0.75, 4: 1.0}


def _ap(spark, scores, labels, group=None):
    rows = [(i, float(s), int(y)) for i, (s, y) in enumerate(zip(scores, labels))]
    df = spark.createDataFrame(rows, "id long, s double, fraud_flag int")
    return M.average_precision_value(df, "s")


def test_ap_reference_case(spark):
    assert math.isclose(_ap(spark, [.9, .8, .7, .6, .5, .4], [1, 0, 1, 0, 1, 0]),
                        (1 + 2 / 3 + 3 / 5) / 3, abs_tol=1e-12)


def test_ap_ties_and_degenerate(spark):
    # ties grouped: threshold .5 holds one positive and one negative
    assert math.isclose(_ap(spark, [.9, .5, .5, .1], [1, 1, 0, 0]), 0.5 * 1 + 0.5 * (2 / 3), abs_tol=1e-12)
    assert _ap(spark, [.3, .2, .1], [0, 0, 0]) == 0.0
    assert math.isclose(_ap(spark, [.3, .2, .1], [1, 1, 1]), 1.0)


def test_oof_encoding_hand_values_and_no_self_leak(spark):
    rows = [(1, "a", 1, 0), (2, "a", 0, 0), (3, "b", 1, 0), (4, "a", 1, 1), (5, "b", 0, 1),
            (6, "c", 1, 1), (7, "c", 0, 0), (8, "b", 1, 1)]
    df = spark.createDataFrame(rows, "id long, k string, fraud_flag int, fold int")
    folds = df.select("id", "fold")
    train = df.drop("fold")
    out = {r["id"]: r["k_fraud_rate"] for r in
           EN.oof_target_encoding(train, folds, "id", cols=["k"], m=2.0).collect()}
    # row 1 (fold 0, key a): other fold holds a: [1] -> n=1, s=1; fold-1 prior = 3/4
    assert math.isclose(out[1], (1 * 1 + 0.75 * 2) / 3)
    # row 7 (fold 0, key c): other fold holds c: [1]
    assert math.isclose(out[7], (1 + 0.75 * 2) / 3)
    flipped = train.withColumn(S.LABEL, F.when(F.col("id") == 1, 1 - F.col(S.LABEL)).otherwise(F.col(S.LABEL)))
    out2 = {r["id"]: r["k_fraud_rate"] for r in
            EN.oof_target_encoding(flipped, folds, "id", cols=["k"], m=2.0).collect()}
    assert out2[1] == out[1]


def test_operation_prior_single_kind_unchanged(spark):
    df = spark.createDataFrame([(1, "op_03", 0.4), (2, "op_03", 0.9)], "id long, operation string, s double")
    out = {r["id"]: r["adjusted"] for r in FU.operation_prior(df, "s").collect()}
    assert out == {1: 0.4, 2: 0.9}


def test_two_stage_without_positive_operation(spark):
    df = spark.createDataFrame([(1, "op_01", 0.4, 0.1), (2, "op_02", 0.9, 0.3), (3, "op_04", 0.1, 0.9)],
                               "id long, operation string, g double, s double")
    out = [r["fused"] for r in FU.two_stage_scores(df, "g", "s").collect()]
    assert out == [1e-8, 1e-8, 1e-8]


def test_submission_contract(spark):
    preds = spark.createDataFrame([(1, 0.2), (2, 1.2), (9, 0.5)], "id long, target double")
    sample = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    sub = SU.build_submission(preds, sample, 0.1)
    got = {r["id"]: r["target"] for r in sub.collect()}
    assert got == {1: 0.2, 2: 1.0, 3: 0.1}          # clip, fill, extra id dropped
    SU.check_submission(sub, sample)
    dup = sub.unionByName(sub.filter("id = 1"))
    with pytest.raises(SU.SubmissionError):
        SU.check_submission(dup, sample)


@pytest.mark.parametrize("y", [0, 1])
def test_focal_gradient_matches_numeric_derivative(spark, y):
    xs = [-2.0, 0.0, 2.0]
    df = spark.createDataFrame([(x, y) for x in xs], "x double, fraud_flag int")
    g, h = M.focal_gradient("x", S.LABEL)
    got = df.select("x", g.alias("g"), h.alias("h")).collect()

    def loss(x):
        p = 1 / (1 + math.exp(-x))
        pt = p if y == 1 else 1 - p
        a = 0.25 if y == 1 else 0.75
        return -a * (1 - pt) ** 2 * math.log(pt)

    for r in got:
        eps = 1e-5
        num_g = (loss(r["x"] + eps) - loss(r["x"] - eps)) / (2 * eps)
        num_h = (loss(r["x"] + eps) - 2 * loss(r["x"]) + loss(r["x"] - eps)) / eps ** 2
        assert math.isclose(r["g"], num_g, abs_tol=1e-6)
        assert math.isclose(r["h"], max(num_h, 1e-6), abs_tol=1e-4)
