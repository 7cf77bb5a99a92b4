"""Statistics of every fold from one scan: equal to the statistics of the fold's rows, and one scan per side."""
import pytest
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.operators import folds as FO
from ledgerscope.operators import splits as SP
from ledgerscope.plans import catalog
from ledgerscope.session import materialize
from tests.conftest import SF001


def test_every_fold_equals_its_own_aggregate(spark):
    train, _ = catalog._lacking_accounts(spark, SF001)
    train = train.withColumn(S.AMOUNT, F.when(F.col(S.ID) % 11 != 0, F.col(S.AMOUNT)))
    rows = SP.with_folds(train, SP.stratified_group_folds(train, 3), k=3)
    got = FO.fold_account_stats(FO.fold_pairs(rows, S.DEST, S.ORIGIN, 3), 3)
    for f in range(3):
        plain = rows.where((F.col("fold") != f) & F.col(S.DEST).isNotNull()).groupBy(F.col(S.DEST).alias("account")).agg(
            F.count(F.lit(1)), F.count(S.AMOUNT), F.sum(S.AMOUNT), F.avg(S.AMOUNT), F.stddev_samp(S.AMOUNT), F.min(S.PERIOD), F.max(S.PERIOD), F.countDistinct(S.ORIGIN))
        want = {r[0]: list(r[1:]) for r in plain.collect()}
        mine = {r["account"]: list(r[2:]) for r in got.where(F.col("fold") == f).select("fold", "account", "rows", "txn_count", "amount_sum", "amount_mean", "amount_std",
                                                                                       "period_min", "period_max", "n_counterparts").collect()}
        assert mine.keys() == want.keys()
        for a in want:
            assert mine[a] == [pytest.approx(x, abs=1e-7) if isinstance(x, float) else x for x in want[a]], (f, a)


def test_one_scan_for_all_folds(spark, monkeypatch):
    train = catalog._train(spark, SF001)
    rows = materialize(SP.with_folds(train, SP.stratified_group_folds(train)), "folded")
    written = []
    monkeypatch.setattr(FO, "materialize", lambda df, name: written.append(df._jdf.queryExecution().executedPlan().toString()) or materialize(df, name))
    pairs = FO.fold_pairs(rows, S.ORIGIN, S.DEST, 5)
    assert len(written) == 1 and written[0].count("FileScan") == 1 and "partial_sum" in written[0]
    plan = FO.fold_account_stats(pairs, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "folded" not in plan  # the pairs, for the sums and for the masks


def test_too_many_folds(spark):
    with pytest.raises(ValueError):
        FO.fold_pairs(catalog._train(spark, SF001).withColumn("fold", F.lit(0)), S.ORIGIN, S.DEST, 63)
