"""Row-wise projections: balance features (27 columns), operation encoding,
and the minimal starter projection.  All are single ``select``s that stay in
whole-stage codegen."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import TWO_PI, digits_as_double, flag, pos_part, ratio

BALANCE_COLUMNS = [
    "amount_log1p", "amount_sqrt", "origin_balance_change", "destination_balance_change",
    "origin_expected_debit", "dest_expected_credit", "origin_balance_mismatch",
    "dest_balance_mismatch", "amount_to_origin_before", "amount_to_destination_before",
    "amount_to_origin_after", "amount_to_destination_after", "origin_negative_before",
    "origin_negative_after", "dest_negative_before", "dest_negative_after", "origin_unchanged",
    "dest_unchanged", "origin_wiped", "dest_empty_before", "dest_empty_after",
    "origin_balance_ratio", "dest_balance_ratio", "total_balance_before", "total_balance_after",
    "balance_sum_change", "same_account",
]
ENCODING_COLUMNS = ["operation_code", "period_sin", "period_cos"]


def balance_columns(eps: float = S.EPS) -> list:
    a = F.col(S.AMOUNT)
    ob, oa = F.col(S.OB_BEFORE), F.col(S.OB_AFTER)
    db, da = F.col(S.DB_BEFORE), F.col(S.DB_AFTER)
    o_change = oa - ob
    d_change = da - db
    o_debit = ob - oa
    d_credit = da - db
    total_before = ob + db
    total_after = oa + da
    return [
        F.log1p(pos_part(a)).alias("amount_log1p"),
        F.sqrt(pos_part(a)).alias("amount_sqrt"),
        o_change.alias("origin_balance_change"),
        d_change.alias("destination_balance_change"),
        o_debit.alias("origin_expected_debit"),
        d_credit.alias("dest_expected_credit"),
        F.abs(o_debit - a).alias("origin_balance_mismatch"),
        F.abs(d_credit - a).alias("dest_balance_mismatch"),
        ratio(a, ob, eps).alias("amount_to_origin_before"),
        ratio(a, db, eps).alias("amount_to_destination_before"),
        ratio(a, oa, eps).alias("amount_to_origin_after"),
        ratio(a, da, eps).alias("amount_to_destination_after"),
        flag(ob < 0).alias("origin_negative_before"),
        flag(oa < 0).alias("origin_negative_after"),
        flag(db < 0).alias("dest_negative_before"),
        flag(da < 0).alias("dest_negative_after"),
        flag(o_change == 0).alias("origin_unchanged"),
        flag(d_change == 0).alias("dest_unchanged"),
        flag(oa <= 0).alias("origin_wiped"),
        flag(db == 0).alias("dest_empty_before"),
        flag(da == 0).alias("dest_empty_after"),
        ratio(oa, ob, eps).alias("origin_balance_ratio"),
        ratio(da, db, eps).alias("dest_balance_ratio"),
        total_before.alias("total_balance_before"),
        total_after.alias("total_balance_after"),
        (total_after - total_before).alias("balance_sum_change"),
        flag(F.col(S.ORIGIN) == F.col(S.DEST)).alias("same_account"),
    ]


def add_balance_features(df: DataFrame, eps: float = S.EPS) -> DataFrame:
    return df.select("*", *balance_columns(eps))


def encoding_columns(cycle: int = S.PERIODS_PER_CYCLE) -> list:
    angle = F.lit(TWO_PI) * F.col(S.PERIOD) / F.lit(float(cycle))
    return [
        digits_as_double(S.OPERATION).alias("operation_code"),
        F.sin(angle).alias("period_sin"),
        F.cos(angle).alias("period_cos"),
    ]


def encode_operation(df: DataFrame, cycle: int = S.PERIODS_PER_CYCLE) -> DataFrame:
    return df.select("*", *encoding_columns(cycle))


def starter_features(df: DataFrame, origin_freq: DataFrame, dest_freq: DataFrame,
                     eps: float = S.EPS) -> DataFrame:
    """Starter projection: log amount, 2 changes, 2 ratios, 2 account frequencies
    (fitted on train, 0 when unseen); the account columns are dropped."""
    a = F.col(S.AMOUNT)
    base = df.select(
        "*",
        F.log1p(pos_part(a)).alias("amount_log1p"),
        (F.col(S.OB_AFTER) - F.col(S.OB_BEFORE)).alias("origin_balance_change"),
        (F.col(S.DB_AFTER) - F.col(S.DB_BEFORE)).alias("destination_balance_change"),
        ratio(a, S.OB_BEFORE, eps).alias("amount_to_origin_before"),
        ratio(a, S.DB_BEFORE, eps).alias("amount_to_destination_before"),
    )
    out = (base.join(origin_freq.withColumnRenamed("account", S.ORIGIN)
                     .withColumnRenamed("freq", "origin_account_freq"), S.ORIGIN, "left")
               .join(dest_freq.withColumnRenamed("account", S.DEST)
                     .withColumnRenamed("freq", "destination_account_freq"), S.DEST, "left"))
    return (out.fillna(0.0, ["origin_account_freq", "destination_account_freq"])
               .drop(S.ORIGIN, S.DEST))
