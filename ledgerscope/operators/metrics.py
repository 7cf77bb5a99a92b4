"""Distributed metrics: exact Average Precision and focal loss (K1-K3).

Average Precision is the step-wise sum over distinct score thresholds
(descending): ``sum_k (R_k - R_{k-1}) * P_k``, ties grouped into one
threshold.  ``BinaryClassificationEvaluator(areaUnderPR)`` interpolates and
gives a different number, so AP is computed here from per-score counts and
bucketed prefix sums (:func:`ordered_prefix`); no task sees all rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import clip, col, sigmoid
from .ordered import ordered_prefix


def average_precision(df: DataFrame, score: str, label: str = S.LABEL,
                      group_cols: list | None = None) -> DataFrame:
    """AP per group (one row per group, column ``ap``).  No positives gives 0."""
    parts = list(group_cols or [])
    per_score = (df.filter(F.col(score).isNotNull()).groupBy(*parts, score)
                 .agg(F.sum(label).cast("long").alias("_tp"), F.count(F.lit(1)).alias("_n")))
    pref = ordered_prefix(per_score, score, {"_ctp": F.col("_tp"), "_cn": F.col("_n")},
                          parts, descending=True, inclusive=True, bounds_from=df.select(score))
    if parts:
        totals = per_score.groupBy(*parts).agg(F.sum("_tp").alias("_P"))
        x = pref.join(totals, parts, "inner")
    else:
        p_total = per_score.agg(F.sum("_tp")).first()[0] or 0
        x = pref.withColumn("_P", F.lit(int(p_total)))
    term = F.when(F.col("_P") > 0, (F.col("_tp") / F.col("_P")) * (F.col("_ctp") / F.col("_cn")))
    res = x.groupBy(*parts).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("ap"))
    return res


def average_precision_value(df: DataFrame, score: str, label: str = S.LABEL) -> float:
    row = average_precision(df, score, label).first()
    return float(row["ap"]) if row is not None else 0.0


def focal_terms(x: str | Column, y: str | Column, gamma: float = 2.0, alpha: float = 0.25):
    p = sigmoid(x)
    yy = col(y)
    a_t = F.when(yy == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    p_t = F.when(yy == 1, p).otherwise(F.lit(1.0) - p)
    sign = F.when(yy == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    log_pt = F.ln(clip(p_t, 1e-9, 1.0))
    return a_t, p_t, sign, log_pt


def focal_loss_column(x: str | Column, y: str | Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    """K2 per row: ``-a_t (1-p_t)^g ln p_t`` with ``p = sigmoid(x)``."""
    a_t, p_t, _, log_pt = focal_terms(x, y, gamma, alpha)
    return -a_t * F.pow(F.lit(1.0) - p_t, F.lit(gamma)) * log_pt


def focal_loss(df: DataFrame, x: str, y: str = S.LABEL, gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    return df.agg(F.avg(focal_loss_column(x, y, gamma, alpha)).alias("focal_loss"))


def focal_gradient(x: str | Column, y: str | Column, gamma: float = 2.0, alpha: float = 0.25,
                   hess_floor: float = 1e-6) -> tuple[Column, Column]:
    """K3: exact first and second derivative of the focal loss w.r.t. the raw
    score (the reference's closed form swaps p_t and 1-p_t; this one agrees
    with finite differences).  The hessian is floored like the reference."""
    a_t, p_t, sign, log_pt = focal_terms(x, y, gamma, alpha)
    g = F.lit(gamma)
    one_m = F.lit(1.0) - p_t
    grad = a_t * sign * F.pow(one_m, g) * (g * p_t * log_pt + p_t - F.lit(1.0))
    hess = a_t * p_t * F.pow(one_m, g) * (
        one_m * (g * log_pt + F.lit(2.0 * gamma + 1.0)) - F.lit(gamma * gamma) * p_t * log_pt)
    return grad, F.greatest(hess, F.lit(hess_floor))
