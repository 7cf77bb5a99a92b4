"""Hand-made micro-fixtures for the row and window features (FIXTURES.md part 3)."""
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import tx_frame
from ledgerscope import schema as S
from ledgerscope.operators import balance as B
from ledgerscope.operators import causal as C


def _row(i, period, amount, origin=1, dest=2, op="op_01", ob=100.0, oa=90.0, db=5.0, da=15.0, y=0):
    return (i, period, op, amount, origin, ob, oa, dest, db, da, y)


def test_single_transaction(spark):
    df = tx_frame(spark, [_row(1, 3, 10.0)])
    out = C.add_causal_features(df).first().asDict()
    assert out["o_roll_amt_std_w5"] == 0.0 and out["o_roll_amt_std_w20"] == 0.0
    for c in ("mean", "max", "min", "sum"):
        assert out[f"o_roll_amt_{c}_w5"] == -1.0
    assert out["o_roll_dt_prev"] == -1.0 and out["o_roll_dt_prev2"] == -1.0
    assert out["origin_amount_cumsum_prior"] == 0.0 and out["origin_amount_cummean_prior"] == 0.0
    assert out["origin_period_since_last"] == 0 and out["origin_txn_rank"] == 0
    assert out["o_roll_is_first"] == 1.0 and out["o_roll_burst2"] == 0.0


def test_three_in_one_period_ordered_by_id(spark):
    df = tx_frame(spark, [_row(30, 7, 3.0), _row(10, 7, 1.0), _row(20, 7, 2.0)])
    out = {r["id"]: r for r in C.add_causal_features(df).collect()}
    assert [out[i]["origin_txn_rank"] for i in (10, 20, 30)] == [0, 1, 2]
    assert out[20]["o_roll_dt_prev"] == 0.0 and out[30]["o_roll_dt_prev2"] == 0.0
    assert [out[i]["o_roll_burst2"] for i in (10, 20, 30)] == [0.0, 1.0, 1.0]
    assert out[30]["origin_amount_cumsum_prior"] == 3.0
    assert out[30]["o_roll_amt_mean_w5"] == 1.5


def test_window_edges_against_pandas(spark):
    rng = np.random.default_rng(0)
    amounts = np.round(rng.uniform(0, 100, 22), 2)
    rows = [_row(i, i // 3, float(a)) for i, a in enumerate(amounts)]
    out = C.add_causal_features(tx_frame(spark, rows)).orderBy("id").toPandas()
    s = pd.Series(amounts).shift(1)
    for w in (5, 20):
        r = s.rolling(w, min_periods=1)
        exp_mean = r.mean().fillna(-1).to_numpy()
        exp_std = r.std().fillna(0).to_numpy()
        exp_sum = r.sum().fillna(-1).to_numpy()
        for k in (0, 4, 5, 19, 20, 21):
            assert math.isclose(out[f"o_roll_amt_mean_w{w}"][k], exp_mean[k], abs_tol=1e-9)
            assert math.isclose(out[f"o_roll_amt_std_w{w}"][k], exp_std[k], abs_tol=1e-9)
            assert math.isclose(out[f"o_roll_amt_sum_w{w}"][k], exp_sum[k], abs_tol=1e-9)


def test_null_amount_stays_null(spark):
    df = tx_frame(spark, [_row(1, 0, None), _row(2, 1, 4.0)])
    out = {r["id"]: r for r in B.add_balance_features(df).collect()}
    assert out[1]["amount_log1p"] is None and out[1]["amount_sqrt"] is None
    assert out[1]["origin_negative_before"] == 0 and out[1]["origin_wiped"] == 0


def test_negative_amount_and_balances(spark):
    df = tx_frame(spark, [_row(1, 0, -5.0, ob=-10.0, oa=-20.0, db=-4.0, da=-1.0)])
    r = B.add_balance_features(df).first()
    assert r["amount_log1p"] == 0.0 and r["amount_sqrt"] == 0.0
    assert math.isclose(r["amount_to_origin_before"], -5.0 / (10.0 + 1e-6))
    assert r["origin_negative_before"] == 1 and r["dest_negative_after"] == 1
    assert math.isclose(r["origin_balance_ratio"], -20.0 / (10.0 + 1e-6))


def test_zero_balances(spark):
    df = tx_frame(spark, [_row(1, 0, 3.0, ob=0.0, oa=0.0, db=0.0, da=0.0)])
    r = B.add_balance_features(df).first()
    assert math.isclose(r["amount_to_origin_before"], 3.0 / 1e-6)
    assert r["dest_empty_before"] == 1 and r["dest_empty_after"] == 1 and r["origin_unchanged"] == 1
    assert r["origin_wiped"] == 1


def test_operation_code_without_digits(spark):
    df = tx_frame(spark, [_row(1, 0, 1.0, op="transfer"), _row(2, 0, 1.0, op=None), _row(3, 0, 1.0, op="op_04")])
    out = {r["id"]: r["operation_code"] for r in B.encode_operation(df).collect()}
    assert out == {1: 0.0, 2: 0.0, 3: 4.0}
