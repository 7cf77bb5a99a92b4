"""Statistics of every fold's training rows from one scan.

The training rows of fold ``f`` are all rows outside it.  One aggregate of the rows per (account, counterpart, fold) is
written; every fold's tables follow from it: counts and sums by leaving the fold out, extremes from the other folds', and distinct
counterparts from a bit mask of the folds in which a pair occurs.  Sums are taken over integers, so what a fold's statistics
are does not depend on the way they were merged.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import units
from ..session import materialize

MOST_FOLDS = 62   # bits of a mask


def fold_pairs(rows: DataFrame, account: str, other: str, k: int, scale: int = S.AMOUNT_SCALE) -> DataFrame:
    """The one scan: ``account, other, fold`` with rows, amounts (count, sum, sum of squares in integer units) and periods.
    ``rows`` have a ``fold`` from 0 to ``k - 1``; rows without the account have no part."""
    if k > MOST_FOLDS:
        raise ValueError(f"at most {MOST_FOLDS} folds")
    u = units(S.AMOUNT, scale).cast("decimal(19,0)")
    return materialize(rows.filter(F.col(account).isNotNull()).groupBy(F.col(account).alias("account"), F.col(other).alias("other"), "fold").agg(
        F.count(F.lit(1)).alias("rows"), F.count(u).alias("n"), F.sum(u).alias("s"), F.sum((u * u).cast("decimal(38,0)")).alias("q"),
        F.min(S.PERIOD).alias("pmin"), F.max(S.PERIOD).alias("pmax")), "fold_pairs")


def fold_account_stats(pairs: DataFrame, k: int, scale: int = S.AMOUNT_SCALE) -> DataFrame:
    """``fold, account`` with the statistics over the rows outside the fold: ``rows, txn_count, amount_sum, amount_mean,
    amount_std, period_min, period_max, n_counterparts``; accounts that occur only in the fold are absent from it."""
    def outside(c: str, f: int) -> Column:
        return F.when(F.col("fold") != f, F.col(c))

    merge = {"rows": F.sum, "n": F.sum, "s": F.sum, "q": F.sum, "pmin": F.min, "pmax": F.max}
    sums = pairs.groupBy("account").agg(*[fn(outside(c, f)).alias(f"{c}{f}") for f in range(k) for c, fn in merge.items()])
    masks = pairs.where("other is not null").groupBy("account", "other").agg(F.bit_or(F.expr("shiftleft(1L, fold)")).alias("mask"))
    every = (1 << k) - 1
    others = masks.groupBy("account").agg(*[F.count_if(F.col("mask").bitwiseAND(F.lit(every & ~(1 << f)).cast("long")) != 0).alias(f"d{f}") for f in range(k)])
    unit = F.lit(float(10 ** scale))

    def stats(f: int) -> Column:
        n, s, q = F.col(f"n{f}"), F.col(f"s{f}").cast("double"), F.col(f"q{f}")
        # n q - s^2 in integers: nothing cancels
        spread = (q * n).cast("decimal(38,0)") - (F.col(f"s{f}").cast("decimal(19,0)") * F.col(f"s{f}").cast("decimal(19,0)")).cast("decimal(38,0)")
        std = F.when(n > 1, F.sqrt(spread.cast("double") / (n.cast("double") * (n - 1).cast("double"))) / unit)
        return F.struct(F.lit(f).alias("fold"), F.col(f"rows{f}").alias("rows"), n.alias("txn_count"), (s / unit).alias("amount_sum"),
                        F.when(n > 0, s / unit / n).alias("amount_mean"), std.alias("amount_std"), F.col(f"pmin{f}").alias("period_min"),
                        F.col(f"pmax{f}").alias("period_max"), F.coalesce(F.col(f"d{f}"), F.lit(0)).alias("n_counterparts"))

    return (sums.join(others, "account", "left").select("account", F.explode(F.array(*[stats(f) for f in range(k)])).alias("e"))
            .select("account", "e.*").where("rows > 0"))

