"""Leakage-safe smoothed target encoding (H1-H4).

Out-of-fold encoding uses leave-fold-out by subtraction: per-key totals minus
the (key, fold) totals give the statistics of the other K-1 folds, so each
encoded column costs one aggregation and one join instead of K passes.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import stable_hash
from .splits import with_folds


def _enc_name(c: str) -> str:
    return f"{c}_fraud_rate"


def _smoothed(s: F.Column, n: F.Column, prior: F.Column, m: float) -> F.Column:
    # same operation order as (rate * count + prior * m) / (count + m)
    rate = s / n
    return (rate * n + prior * F.lit(float(m))) / (n + F.lit(float(m)))


def fit_target_encoding(train: DataFrame, cols=tuple(S.TE_COLUMNS), label: str = S.LABEL,
                        m: float = S.TE_SMOOTHING) -> tuple[dict, float]:
    """H2: ``{col: DataFrame(key, rate)}`` and the global prior (label mean)."""
    prior = train.agg(F.avg(label)).first()[0]
    prior = float(prior) if prior is not None else 0.0
    maps = {}
    for c in cols:
        g = (train.filter(F.col(c).isNotNull()).groupBy(c)
             .agg(F.sum(label).cast("double").alias("_s"), F.count(label).cast("double").alias("_n")))
        maps[c] = g.select(F.col(c).alias("key"),
                           _smoothed(F.col("_s"), F.col("_n"), F.lit(prior), m).alias("rate"))
    return maps, prior


def apply_target_encoding(df: DataFrame, maps: dict, prior: float) -> DataFrame:
    """H4: left join of each map; unseen keys get the prior."""
    out = df
    for c, mp in maps.items():
        out = (out.join(mp.withColumnRenamed("key", c).withColumnRenamed("rate", "_rate"), c, "left")
                  .withColumn(_enc_name(c), F.coalesce(F.col("_rate"), F.lit(prior))).drop("_rate"))
    return out


def oof_target_encoding(train: DataFrame, folds: DataFrame, fold_key: str,
                        cols=tuple(S.TE_COLUMNS), label: str = S.LABEL,
                        m: float = S.TE_SMOOTHING, k: int = 5) -> DataFrame:
    """H3: out-of-fold encodings for the training rows.

    ``folds`` maps ``fold_key`` (an account for group folds, the id for row
    folds) to one of ``k`` folds; rows without a ``fold_key`` get theirs by the hash
    of their id, so every row is encoded and counted.  A row of fold f gets the smoothed rate computed on the
    rows of the other folds, with those folds' label mean as prior and as the
    value for keys absent from them.  Returns ``train`` plus the encoded
    columns and ``fold``.
    """
    x = with_folds(train, folds, fold_key, k)
    # fold-level label totals: K rows
    per_fold = x.groupBy("fold").agg(F.sum(label).cast("double").alias("_fs"),
                                     F.count(label).cast("double").alias("_fn"))
    tot = x.agg(F.sum(label).cast("double").alias("_ts"), F.count(label).cast("double").alias("_tn"))
    trow = tot.first()
    ts, tn = float(trow["_ts"] or 0.0), float(trow["_tn"] or 0.0)
    fold_prior = per_fold.select(
        "fold", ((F.lit(ts) - F.col("_fs")) / (F.lit(tn) - F.col("_fn"))).alias("_fprior"))
    out = x.join(F.broadcast(fold_prior), "fold", "left")   # K rows
    for c in cols:
        kf = (x.filter(F.col(c).isNotNull()).groupBy(c, "fold")
              .agg(F.sum(label).cast("double").alias("_kfs"), F.count(label).cast("double").alias("_kfn")))
        kt = kf.groupBy(c).agg(F.sum("_kfs").alias("_kts"), F.sum("_kfn").alias("_ktn"))
        # one row per (key, fold) the key could be asked for: all K folds
        stats = kt.join(kf, c, "left")
        enc = stats.select(c, "fold", (F.col("_kts") - F.col("_kfs")).alias("_s"),
                           (F.col("_ktn") - F.col("_kfn")).alias("_n"))
        out = (out.join(enc, [c, "fold"], "left")
                  .withColumn(_enc_name(c),
                              F.when(F.coalesce(F.col("_n"), F.lit(0.0)) > 0,
                                     _smoothed(F.col("_s"), F.col("_n"), F.col("_fprior"), m))
                              .otherwise(F.col("_fprior")))
                  .drop("_s", "_n"))
    return out.drop("_fprior")


def encoded_names(cols=tuple(S.TE_COLUMNS)) -> list:
    return [_enc_name(c) for c in cols]


# ---------------------------------------------------------------- ordered statistics

ORDERED_WEIGHT = 1.0
ORDERED_ROWS = 1_000_000   # rows of one category that a task may order


def ordered_target_statistics(train: DataFrame, cols=tuple(S.TE_COLUMNS), label: str = S.LABEL, weight: float = ORDERED_WEIGHT,
                              seed: int = S.RANDOM_STATE, key: str = S.ID, max_rows: int = ORDERED_ROWS) -> DataFrame:
    """Each row's category rate over the rows that a permutation puts before it.

    The permutation is the order of the hash of ``key``.  The rate of a row is ``(s + weight * prior) / (n + weight)`` with
    the label sum and count of the earlier rows of its category, so no row sees its own label.  The hash is spread
    evenly, so equal ranges of it cut a category into equal chunks, as many as the largest category needs: a window
    orders one chunk, and the totals of the chunks before it are added.  Rows with a null category are a category; rows with a
    null label count nowhere and are encoded like any other; ``key`` must be unique.

    Adds ``{col}_ordered_rate``.
    """
    prior = train.agg(F.avg(label)).first()[0]
    prior = float(prior) if prior is not None else 0.0
    out = train
    for c in cols:
        names = list(out.columns)
        largest = train.groupBy(c).count().agg(F.max("count")).first()[0] or 0
        chunks = max(1, -(-int(largest) // max_rows))
        place = F.floor(F.col("_h") * chunks / F.lit(float(1 << 32))).cast("int")
        x = out.select("*", stable_hash(key, seed).alias("_h")).withColumn("_part", place)
        before = Window.partitionBy(c, "_part").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)
        x = x.withColumn("_s", F.coalesce(F.sum(label).over(before), F.lit(0))).withColumn("_n", F.count(label).over(before))
        if chunks > 1:
            earlier = Window.partitionBy(c).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)   # at most ``chunks`` rows
            totals = (out.select(c, label, stable_hash(key, seed).alias("_h")).withColumn("_part", place).groupBy(c, "_part")
                      .agg(F.coalesce(F.sum(label), F.lit(0)).alias("_cs"), F.count(label).alias("_cn")))
            totals = totals.select(F.col(c).alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_cs").over(earlier), F.lit(0)).alias("_os"),
                                   F.coalesce(F.sum("_cn").over(earlier), F.lit(0)).alias("_on"))
            x = x.join(totals, x[c].eqNullSafe(totals["_k"]) & (x["_part"] == totals["_p"]), "inner")
            s, n = F.col("_os") + F.col("_s"), F.col("_on") + F.col("_n")
        else:
            s, n = F.col("_s"), F.col("_n")
        rate = (s.cast("double") + F.lit(prior * weight)) / (n.cast("double") + F.lit(weight))
        out = x.select(*names, rate.alias(f"{c}_ordered_rate"))
    return out
