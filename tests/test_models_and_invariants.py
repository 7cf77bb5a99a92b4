"""Model planted-signal test and feature-table / fold / graph invariants."""
import math

from pyspark.sql import functions as F

from conftest import SF001, SF01
from ledgerscope import schema as S
from ledgerscope.operators import graph as G
from ledgerscope.operators import splits as SP
from ledgerscope.plans import features as FT
from ledgerscope.plans import models as MD
from ledgerscope.plans import validation as VA
from ledgerscope.sources import transactions as TX


def test_feature_names_count():
    assert len(FT.feature_names(include_iso=True)) == 157
    assert len(set(FT.feature_names(include_iso=True))) == 157


def test_pagerank_sums_to_one(spark):
    ranks, conv, _ = G.pagerank(G.edge_weights(TX.load_transactions(spark, SF01)))
    total = ranks.agg(F.sum("pagerank")).first()[0]
    assert conv and math.isclose(total, 1.0, abs_tol=1e-6)


def test_group_folds_disjoint_and_balanced(spark):
    train = TX.load_train_test(spark, SF01)[0]
    folds = SP.stratified_group_folds(train)
    assert folds.count() == folds.select(S.ORIGIN).distinct().count()
    sizes = train.join(folds, S.ORIGIN).groupBy("fold").agg(F.count(F.lit(1)).alias("n"),
                                                            F.sum(S.LABEL).alias("p")).collect()
    ns = [r["n"] for r in sizes]
    ps = [r["p"] for r in sizes]
    assert len(sizes) == 5 and max(ns) - min(ns) <= 0.1 * max(ns) and max(ps) - min(ps) <= 0.1 * max(ps) + 2


def test_planted_signal(spark):
    train = TX.load_train_test(spark, SF01)[0]
    tr, va = SP.temporal_split(train)
    trA, vaA, _ = VA.fold_frames(tr, va, unsupervised_ref="train", blocks=())
    model = MD.fit_learner(MD.BASE_LEARNERS["gbt"], trA, vaA)
    ap = VA.ap_of(MD.predict(model, vaA, "s"), "s")
    base = vaA.agg(F.avg(S.LABEL)).first()[0]
    assert ap > 4 * base
    shuffled = trA.withColumn(S.LABEL, (F.xxhash64(S.ID) % 20 == 0).cast("int"))
    model2 = MD.fit_learner(MD.BASE_LEARNERS["gbt"], shuffled)
    ap2 = VA.ap_of(MD.predict(model2, vaA, "s"), "s")
    assert ap2 < 0.5 * ap


def test_pipeline_submission_is_valid(spark):
    train, test = TX.load_train_test(spark, SF001)
    sample = TX.sample_ids(test)
    sub = VA.train_final_and_submit(spark, train, test, sample, iso=True)
    assert sub.count() == sample.count()
    assert sub.columns == [S.ID, S.TARGET]
