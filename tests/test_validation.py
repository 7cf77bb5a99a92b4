"""Feature frames of folds against pandas, amounts finer than the scale, pipelines and files."""
import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SF001
from ledgerscope import schema as S
from ledgerscope.operators import aggregates as A
from ledgerscope.operators import splits as SP
from ledgerscope.plans import features as FT
from ledgerscope.plans import models as MD
from ledgerscope.plans import validation as VA
from ledgerscope.session import materialize
from ledgerscope.sources import sinks as SK
from ledgerscope.sources import transactions as TX


@pytest.fixture(scope="module")
def parts(spark):
    """Train, valid and test with accounts that only valid or test has, and rows without accounts."""
    train, test = TX.load_train_test(spark, SF001)

    def holes(df):
        return (df.withColumn(S.DEST, F.when(F.col(S.ID) % 19 != 0, F.col(S.DEST)))
                .withColumn(S.ORIGIN, F.when((F.col(S.ID) % 7 == 0) & (F.col(S.PERIOD) >= 96), F.lit(10 ** 6))
                            .otherwise(F.col(S.ORIGIN))))

    tr, va = SP.temporal_split(holes(train))
    return materialize(tr, "tr"), materialize(va, "va"), materialize(holes(test), "te")


def test_fold_features_equal_pandas(spark, parts):
    tr, va, te = parts
    got = FT.build_feature_table(tr, te, valid=va, unsupervised_ref="train", iso=True)
    assert len(FT.feature_columns(got)) == 157
    got = got.toPandas()
    assert got[S.SPLIT].value_counts().to_dict() == {"train": tr.count(), "valid": va.count(), "test": te.count()}
    ref, rows = tr.toPandas(), [x.toPandas() for x in (tr, va, te)]
    by = got.set_index(S.ID)
    for account, side, p, kind, other in ((S.ORIGIN, "origin", "o", "out", S.DEST), (S.DEST, "dest", "d", "in", S.ORIGIN)):
        g = ref.groupby(account)
        want = by[account].map(g[S.AMOUNT].count()).fillna(0)
        assert (by[f"{side}_txn_count"] == want).all()
        want = by[account].map(g[other].nunique())
        distinct = by["origin_dest_nunique" if side == "origin" else "dest_origin_nunique"].astype(float)
        np.testing.assert_array_equal(distinct, want.astype(float))
        np.testing.assert_array_equal(by[f"{p}_{kind}_degree"].astype(float), want.fillna(0).astype(float))
        np.testing.assert_allclose(by[f"{side}_amount_sum"].astype(float), by[account].map(g[S.AMOUNT].sum()).astype(float))
        # profiles come from all rows
        every = pd.concat(rows).groupby(account)[S.AMOUNT]
        prof = "op_orig" if side == "origin" else "op_dest"
        np.testing.assert_allclose(by[f"{prof}_amt_q25"], by[account].map(every.quantile(0.25)).fillna(0), rtol=1e-12)
        assert (by.loc[by[account].isna() | ~by[account].isin(ref[account]), f"{p}_pagerank"] == 0).all()
    both = ref.dropna(subset=[S.ORIGIN, S.DEST]).groupby([S.ORIGIN, S.DEST]).size().to_dict()
    cycles = {}
    for (a, b), n in both.items():
        if a < b:
            cycles[a] = cycles.get(a, 0) + n + both.get((b, a), 0)
    assert (by["o_cycle2_count"] == by[S.ORIGIN].map(cycles).fillna(0)).all()
    # the rank gap is taken within each split, unseen and missing accounts ranking as 0
    for _, x in by.groupby(S.SPLIT):
        gap = (x["o_pagerank"].rank(pct=True) - x["d_pagerank"].rank(pct=True)).abs()
        np.testing.assert_allclose(x["graph_pagerank_gap"], gap, atol=1e-12)


def test_amounts_finer_than_the_scale_fail(spark):
    tx = TX.load_transactions(spark, SF001).withColumn(S.AMOUNT, F.col(S.AMOUNT) + F.lit(0.001))
    with pytest.raises(PySparkException, match="finer than"):
        A.origin_stats(tx).collect()
    total = tx.agg(F.sum(S.AMOUNT)).first()[0]
    for scale in (3, None):
        assert abs(A.origin_stats(tx, scale).agg(F.sum("origin_amount_sum")).first()[0] - total) < 1e-6


def test_feature_plan_reads_the_rows_few_times(spark):
    train, test = TX.load_train_test(spark, SF001)
    plan = FT.build_feature_table(train, test)._jdf.queryExecution().optimizedPlan().toString()
    assert 3 <= plan.count("Relation [") <= 12   # the rows and the written tables


@pytest.fixture
def small_learners(monkeypatch):
    """A few trees each: these tests check the composition, not the models."""
    small = {n: dict(v, **({"maxIter": 3, "maxDepth": 3} if v["kind"] == "gbt" else {"numTrees": 5, "maxDepth": 3}))
             for n, v in MD.BASE_LEARNERS.items()}
    monkeypatch.setattr(MD, "BASE_LEARNERS", small)
    monkeypatch.setattr(MD, "SPECIALIST", dict(MD.SPECIALIST, maxIter=3, maxDepth=3))
    monkeypatch.setattr(MD, "MIN_FULL_ITERS", {"gbt": 4})


def test_stored_report_gives_the_weights(spark, small_learners, monkeypatch, tmp_path):
    """A stored report is read, not computed again; the files are written."""
    train, test = TX.load_train_test(spark, SF001)
    sample, path = TX.sample_ids(test), str(tmp_path / "report")
    weights = {"gbt": 0.5, "forest": 0.25, "gbt_deep": 0.25}
    SK.write_report(spark, {"ensemble_weights": weights}, path)
    monkeypatch.setattr(VA, "validation_report", None)
    sub = VA.train_final_and_submit(spark, train, test, sample, iso=False, report=path,
                                    predictions_path=str(tmp_path / "preds"), submission_path=str(tmp_path / "sub"))
    written = spark.read.schema("id bigint, target double").option("header", True).csv(str(tmp_path / "sub"))
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, sub.collect()))
    assert spark.read.parquet(str(tmp_path / "preds")).columns == [S.ID, *VA.LEARNERS]


def test_two_stage_report(spark, small_learners):
    train, test = TX.load_train_test(spark, SF001)
    sample = TX.sample_ids(test)
    sub, report = VA.two_stage(spark, train, test, sample)
    assert sub.count() == sample.count() and report["n_features"] == 157
    assert abs(sum(report["ensemble_weights"].values()) - 1) < 1e-9
    assert 0 <= report["val_ap_global"] <= 1 and 0 <= report["val_ap_two_stage"] <= 1
    assert report["trees"]["gbt"] == 4
    assert set(report["trees"]) == {*VA.LEARNERS, "specialist"}


def test_first_existing_path(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert TX.first_existing(spark, paths) == paths[1]
    with pytest.raises(FileNotFoundError):
        TX.first_existing(spark, paths[:1])
