"""Account profiles (E6-E8): exact amount quartiles, row count, distinct
operations, IQR, and the operation-share pivot, in one aggregation per side."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import clip
from .ordered import exact_quantiles

PROFILE_SIDES = {"origin": (S.ORIGIN, "op_orig"), "dest": (S.DEST, "op_dest")}


def profile_columns(prefix: str, operations=tuple(S.OPERATIONS)) -> list:
    base = [f"{prefix}_amt_q25", f"{prefix}_amt_q50", f"{prefix}_amt_q75", f"{prefix}_amt_freq",
            f"{prefix}_op_nunique", f"{prefix}_amt_iqr"]
    return base + [f"{prefix}_share_{op}" for op in operations]


def fit_account_profile(ref: DataFrame, side: str, operations=tuple(S.OPERATIONS),
                        quantiles: str = "distributed") -> DataFrame:
    """One row per account.  Quartiles use linear interpolation.

    ``quantiles='distributed'`` (default) computes them exactly with
    :func:`exact_quantiles` (no per-account buffer, safe for an account holding
    a third of the rows); ``'buffer'`` uses ``percentile`` (one value-count map
    per account); ``'approx'`` uses ``percentile_approx``.  The share pivot uses
    the explicit operation list, so no extra job discovers the values; absent
    operations give 0; the denominator counts rows with a non-null operation."""
    acct, prefix = PROFILE_SIDES[side]
    a = F.col(S.AMOUNT)
    qs = [0.25, 0.5, 0.75]
    base = ref.filter(F.col(acct).isNotNull())
    extra = []
    if quantiles == "buffer":
        extra = [F.percentile(a, qs).alias("_q")]
    elif quantiles == "approx":
        extra = [F.percentile_approx(a, qs, 100_000).cast("array<double>").alias("_q")]
    g = (base.groupBy(acct)
         .agg(*extra, *profile_counts(operations)))
    if quantiles == "distributed":
        qt = exact_quantiles(base, S.AMOUNT, qs, [acct], prefix="_q")
        g = g.join(qt, acct, "left").withColumn("_q", F.array("_q0", "_q1", "_q2"))
    return g.select(F.col(acct).alias("account"),
                    *profile_output(prefix, [F.col("_q")[i] for i in range(3)], operations))


def profile_counts(operations=tuple(S.OPERATIONS)) -> list:
    """Aggregates of an account's rows that a profile needs beside the quartiles."""
    return [F.count(F.lit(1)).alias("_freq"), F.count_distinct(S.OPERATION).alias("_nops"),
            F.count(S.OPERATION).alias("_ops_total"),
            *[F.count_if(F.col(S.OPERATION) == op).alias(f"_c_{op}") for op in operations]]


def profile_output(prefix: str, quartiles: list, operations=tuple(S.OPERATIONS)) -> list:
    """The profile columns from :func:`profile_counts` and the three quartile columns."""
    q25, q50, q75 = quartiles
    denom = F.greatest(F.col("_ops_total"), F.lit(1)).cast("double")
    zero = F.lit(0.0)
    return [
        F.coalesce(q25, zero).alias(f"{prefix}_amt_q25"),
        F.coalesce(q50, zero).alias(f"{prefix}_amt_q50"),
        F.coalesce(q75, zero).alias(f"{prefix}_amt_q75"),
        F.col("_freq").cast("double").alias(f"{prefix}_amt_freq"),
        F.col("_nops").cast("double").alias(f"{prefix}_op_nunique"),
        F.coalesce(clip(q75 - q25, lo=0.0), zero).alias(f"{prefix}_amt_iqr"),
        *[(F.col(f"_c_{op}") / denom).alias(f"{prefix}_share_{op}") for op in operations],
    ]


def _np_div(num: Column, den: Column) -> Column:
    """NumPy float division: x/0 is +-inf (NaN for 0/0) instead of an ANSI error."""
    return (F.when(den != 0, num / den)
            .when(num > 0, F.lit(float("inf")))
            .when(num < 0, F.lit(float("-inf")))
            .when(num == 0, F.lit(float("nan"))))


PROFILE_DERIVED = ["amt_vs_orig_q50", "amt_vs_dest_q50", "amt_orig_iqr_z", "amt_dest_iqr_z",
                   "op_orig_amt_freq_log1p", "op_dest_amt_freq_log1p"]


def apply_account_profiles(df: DataFrame, origin_profile: DataFrame, dest_profile: DataFrame,
                           operations=tuple(S.OPERATIONS)) -> DataFrame:
    """Left joins (unseen accounts get 0 in every profile column), then the
    deviation columns."""
    keep = list(df.columns)
    o_cols = profile_columns("op_orig", operations)
    d_cols = profile_columns("op_dest", operations)
    out = (df.join(origin_profile.withColumnRenamed("account", S.ORIGIN), S.ORIGIN, "left")
             .join(dest_profile.withColumnRenamed("account", S.DEST), S.DEST, "left"))
    filled = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in o_cols + d_cols]
    return apply_account_profiles_derived(out.select(*keep, *filled))


def apply_account_profiles_derived(out: DataFrame) -> DataFrame:
    """The six deviation / log-count columns from filled profile columns."""
    a = F.col(S.AMOUNT)
    return out.select(
        "*",
        clip(_np_div(a, F.col("op_orig_amt_q50") + 1.0), 0.0, 1e4).alias("amt_vs_orig_q50"),
        clip(_np_div(a, F.col("op_dest_amt_q50") + 1.0), 0.0, 1e4).alias("amt_vs_dest_q50"),
        clip(_np_div(a - F.col("op_orig_amt_q50"), F.col("op_orig_amt_iqr") + 1.0), -100.0, 100.0)
        .alias("amt_orig_iqr_z"),
        clip(_np_div(a - F.col("op_dest_amt_q50"), F.col("op_dest_amt_iqr") + 1.0), -100.0, 100.0)
        .alias("amt_dest_iqr_z"),
        F.log1p(F.col("op_orig_amt_freq")).alias("op_orig_amt_freq_log1p"),
        F.log1p(F.col("op_dest_amt_freq")).alias("op_dest_amt_freq_log1p"),
    )
