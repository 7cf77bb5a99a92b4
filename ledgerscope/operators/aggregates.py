"""Account, operation and pair aggregates.

Every statistic is a ``groupBy().agg()`` with map-side partial aggregation, so
a hot account is pre-combined before the shuffle.  One table per side carries
all per-account statistics, so the rows are joined once per side instead of
once per statistic block.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import money_mean, money_sum
from .ordered import exact_quantiles


def _std0(c: str) -> Column:
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def origin_stats(ref: DataFrame, scale=S.AMOUNT_SCALE) -> DataFrame:
    return ref.groupBy(S.ORIGIN).agg(
        F.count(S.AMOUNT).alias("origin_txn_count"),
        money_sum(S.AMOUNT, scale).alias("origin_amount_sum"),
        money_mean(S.AMOUNT, scale).alias("origin_amount_mean"),
        F.stddev_samp(S.AMOUNT).alias("origin_amount_std"),
        F.min(S.PERIOD).alias("origin_period_min"),
        F.max(S.PERIOD).alias("origin_period_max"),
        F.count_distinct(S.DEST).alias("origin_dest_nunique"),
    ).filter(F.col(S.ORIGIN).isNotNull())


def destination_stats(ref: DataFrame, scale=S.AMOUNT_SCALE) -> DataFrame:
    return ref.groupBy(S.DEST).agg(
        F.count(S.AMOUNT).alias("dest_txn_count"),
        money_sum(S.AMOUNT, scale).alias("dest_amount_sum"),
        money_mean(S.AMOUNT, scale).alias("dest_amount_mean"),
        F.stddev_samp(S.AMOUNT).alias("dest_amount_std"),
        F.min(S.PERIOD).alias("dest_period_min"),
        F.max(S.PERIOD).alias("dest_period_max"),
        F.count_distinct(S.ORIGIN).alias("dest_origin_nunique"),
    ).filter(F.col(S.DEST).isNotNull())


def operation_stats(ref: DataFrame, scale=S.AMOUNT_SCALE) -> DataFrame:
    """Per operation: count, mean, std, exact median.  An operation holds a
    large share of all rows, so the median is computed by distributed exact
    quantiles instead of one value-count buffer per operation."""
    base = ref.filter(F.col(S.OPERATION).isNotNull())
    stats = base.groupBy(S.OPERATION).agg(
        F.count(S.AMOUNT).alias("op_count"),
        money_mean(S.AMOUNT, scale).alias("op_amount_mean"),
        F.stddev_samp(S.AMOUNT).alias("op_amount_std"),
    )
    med = exact_quantiles(base, S.AMOUNT, [0.5], [S.OPERATION], prefix="op_amount_median")
    return (stats.join(med, S.OPERATION, "left")
            .withColumnRenamed("op_amount_median0", "op_amount_median"))


def pair_counts(ref: DataFrame) -> DataFrame:
    return (ref.filter(F.col(S.ORIGIN).isNotNull() & F.col(S.DEST).isNotNull())
            .groupBy(S.ORIGIN, S.DEST).agg(F.count(F.lit(1)).alias("pair_count")))


AGGREGATE_COLUMNS = [
    "origin_txn_count", "origin_amount_sum", "origin_amount_mean", "origin_amount_std",
    "origin_period_min", "origin_period_max", "origin_dest_nunique",
    "dest_txn_count", "dest_amount_sum", "dest_amount_mean", "dest_amount_std",
    "dest_period_min", "dest_period_max", "dest_origin_nunique",
    "op_count", "op_amount_mean", "op_amount_std", "op_amount_median", "pair_count",
    "origin_dest_ratio", "amount_vs_origin_mean", "amount_vs_dest_mean", "amount_vs_op_mean",
    "origin_period_span", "dest_period_span",
]


def aggregate_projection(eps: float = S.EPS, suffix: str = "") -> list:
    """Fills and derived columns after the stats joins (E5); ``suffix`` is that of the statistics' names and of the results'."""
    col = lambda name: F.col(name + suffix)
    a = F.col(S.AMOUNT)
    o_n = F.coalesce(col("origin_txn_count"), F.lit(0))
    d_n = F.coalesce(col("dest_txn_count"), F.lit(0))
    return [
        o_n.alias(f"origin_txn_count{suffix}"),
        col("origin_amount_sum").alias(f"origin_amount_sum{suffix}"), col("origin_amount_mean").alias(f"origin_amount_mean{suffix}"),
        F.coalesce(col("origin_amount_std"), F.lit(0.0)).alias(f"origin_amount_std{suffix}"),
        col("origin_period_min").alias(f"origin_period_min{suffix}"), col("origin_period_max").alias(f"origin_period_max{suffix}"), col("origin_dest_nunique").alias(f"origin_dest_nunique{suffix}"),
        d_n.alias(f"dest_txn_count{suffix}"),
        col("dest_amount_sum").alias(f"dest_amount_sum{suffix}"), col("dest_amount_mean").alias(f"dest_amount_mean{suffix}"),
        F.coalesce(col("dest_amount_std"), F.lit(0.0)).alias(f"dest_amount_std{suffix}"),
        col("dest_period_min").alias(f"dest_period_min{suffix}"), col("dest_period_max").alias(f"dest_period_max{suffix}"), col("dest_origin_nunique").alias(f"dest_origin_nunique{suffix}"),
        col("op_count").alias(f"op_count{suffix}"), col("op_amount_mean").alias(f"op_amount_mean{suffix}"),
        F.coalesce(col("op_amount_std"), F.lit(0.0)).alias(f"op_amount_std{suffix}"),
        col("op_amount_median").alias(f"op_amount_median{suffix}"),
        F.coalesce(col("pair_count"), F.lit(0)).alias(f"pair_count{suffix}"),
        (o_n / (d_n + F.lit(1.0))).alias(f"origin_dest_ratio{suffix}"),
        (a / (F.coalesce(col("origin_amount_mean"), F.lit(0.0)) + F.lit(eps))).alias(f"amount_vs_origin_mean{suffix}"),
        (a / (F.coalesce(col("dest_amount_mean"), F.lit(0.0)) + F.lit(eps))).alias(f"amount_vs_dest_mean{suffix}"),
        (a / (F.coalesce(col("op_amount_mean"), F.lit(0.0)) + F.lit(eps))).alias(f"amount_vs_op_mean{suffix}"),
        (col("origin_period_max") - col("origin_period_min")).alias(f"origin_period_span{suffix}"),
        (col("dest_period_max") - col("dest_period_min")).alias(f"dest_period_span{suffix}"),
    ]


def add_unsupervised_aggregations(df: DataFrame, ref: DataFrame, eps: float = S.EPS,
                                  scale=S.AMOUNT_SCALE) -> DataFrame:
    """E5: join origin / destination / operation / pair statistics fitted on ``ref``.

    The operation table has one row per distinct operation (5 here); it is
    joined with a broadcast hint only because its row count is bounded by the
    operation vocabulary; AQE handles the account-keyed joins (broadcast when
    small at runtime, skew split of hot accounts otherwise).
    """
    keep = [c for c in df.columns]
    out = (df.join(origin_stats(ref, scale), S.ORIGIN, "left")
             .join(destination_stats(ref, scale), S.DEST, "left")
             .join(F.broadcast(operation_stats(ref, scale)), S.OPERATION, "left")
             .join(pair_counts(ref), [S.ORIGIN, S.DEST], "left"))
    return out.select(*keep, *aggregate_projection(eps))


# -- frequency encoding (D8) -------------------------------------------------

def frequency_table(ref: DataFrame, account_col: str) -> DataFrame:
    """Share of rows per account in ``ref`` (``value_counts(normalize=True)``)."""
    total = ref.filter(F.col(account_col).isNotNull()).count()
    return (ref.filter(F.col(account_col).isNotNull()).groupBy(account_col)
            .agg((F.count(F.lit(1)) / F.lit(float(max(total, 1)))).alias("freq"))
            .withColumnRenamed(account_col, "account"))


# -- class weight (E12) --------------------------------------------------------

def class_balance(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """neg / max(pos, 1) as a one-row table."""
    return df.agg(
        F.sum(label).cast("long").alias("pos"),
        (F.count(F.lit(1)) - F.sum(label)).cast("long").alias("neg"),
    ).select("pos", "neg", (F.col("neg") / F.greatest(F.col("pos"), F.lit(1))).cast("double")
             .alias("scale_pos_weight"))


# -- describe (E13) ------------------------------------------------------------

def describe_column(df: DataFrame, c: str) -> DataFrame:
    """count, mean, std (ddof 1), min, exact quartiles, max of one column."""
    base = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                  F.min(c).alias("min"), F.max(c).alias("max"))
    q = exact_quantiles(df, c, [0.25, 0.5, 0.75], prefix="q")
    k = F.lit(1).alias("_k")   # two one-row tables
    return (base.select("*", k).join(q.select("*", k), "_k")
            .select("count", "mean", "std", "min", F.col("q0").alias("q25"), F.col("q1").alias("q50"),
                    F.col("q2").alias("q75"), "max"))


# -- EDA summary (E10, E11, D13, S2) -------------------------------------------

def missing_cells(df: DataFrame) -> Column:
    return sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).cast("long")


def eda_summary(train: DataFrame, test: DataFrame) -> DataFrame:
    """One-row EDA report (16 fields)."""
    tr = train.agg(
        F.count(F.lit(1)).alias("train_rows"),
        F.min(S.PERIOD).alias("train_period_min"), F.max(S.PERIOD).alias("train_period_max"),
        F.avg(S.LABEL).alias("fraud_rate"),
        missing_cells(train).alias("train_missing"),
        F.concat_ws(",", F.array_sort(F.collect_set(S.OPERATION))).alias("train_operations"),
        F.count_distinct(S.ORIGIN).alias("origin_accounts_train"),
        F.count_distinct(S.DEST).alias("dest_accounts_train"),
    )
    te = test.agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.min(S.PERIOD).alias("test_period_min"), F.max(S.PERIOD).alias("test_period_max"),
        missing_cells(test).alias("test_missing"),
        F.count_distinct(S.ORIGIN).alias("origin_accounts_test"),
        F.count_distinct(S.DEST).alias("dest_accounts_test"),
    )
    ov = account_overlap(train, test)
    # three one-row tables: joined on a constant key (each side has exactly one row)
    k = F.lit(1).alias("_k")
    return (tr.select("*", k).join(te.select("*", k), "_k")
              .join(ov.select("*", k), "_k").drop("_k"))


def account_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct accounts present in both splits, per side (semi-join counts)."""
    def overlap(c):
        a = train.select(c).filter(F.col(c).isNotNull()).distinct()
        b = test.select(c).filter(F.col(c).isNotNull()).distinct()
        return a.join(b, c, "left_semi").agg(F.count(F.lit(1)).alias("n"))
    o = overlap(S.ORIGIN).withColumnRenamed("n", "accounts_overlap_origin")
    d = overlap(S.DEST).withColumnRenamed("n", "accounts_overlap_dest")
    k = F.lit(1).alias("_k")
    return o.select("*", k).join(d.select("*", k), "_k").drop("_k")


# -- edge list (E9) -------------------------------------------------------------

def edge_list(ref: DataFrame, scale=S.AMOUNT_SCALE) -> DataFrame:
    return (ref.filter(F.col(S.ORIGIN).isNotNull() & F.col(S.DEST).isNotNull())
            .groupBy(S.ORIGIN, S.DEST)
            .agg(money_sum(S.AMOUNT, scale).alias("weight"), F.count(S.AMOUNT).alias("count")))

