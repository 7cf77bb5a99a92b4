"""Deterministic splits and folds.

Randomness is replaced by a portable hash of the key and the seed
(:func:`ledgerscope.functions.columns.stable_hash`), so every split is
repeatable, independent of partitioning, and reproducible in SQL.  Orderings
over keys use :func:`ledgerscope.operators.ordered.hash_positions` (cells of the hash) or
``global_positions`` (parallel range sort), never a single-task window.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import stable_hash
from ..session import materialize
from .ordered import global_positions, hash_bits, hash_cell, hash_positions


class InsufficientData(ValueError):
    pass


def temporal_split(df: DataFrame, cutoff: int = S.VAL_PERIOD_CUTOFF) -> tuple[DataFrame, DataFrame]:
    """Train ``period < cutoff``, valid ``period >= cutoff`` (pushed to the scan)."""
    return df.filter(F.col(S.PERIOD) < cutoff), df.filter(F.col(S.PERIOD) >= cutoff)


def temporal_roles(df: DataFrame, cutoff: int = S.VAL_PERIOD_CUTOFF) -> DataFrame:
    return df.select("*", F.when(F.col(S.PERIOD) < cutoff, "train").otherwise("valid").alias("role"))


def fold_table(df: DataFrame, cutoffs=tuple(S.ROLLING_CUTOFFS), width: int | None = None) -> DataFrame:
    """One row per (cutoff, transaction) with its role.

    Open folds (``width=None``): valid is every row with ``period >= cutoff``.
    Bounded folds: valid is ``[cutoff, cutoff + width)``; other rows are not in
    the fold.  Rows are expanded by a generator over the literal cutoff list
    (no join).
    """
    cut = F.explode(F.array(*[F.lit(int(c)) for c in cutoffs])).alias("cutoff")
    x = df.select("*", cut)
    p, c = F.col(S.PERIOD), F.col("cutoff")
    role = F.when(p < c, "train")
    if width is None:
        role = role.otherwise("valid")
    else:
        role = role.when(p < c + width, "valid")
    return x.select("*", role.alias("role")).filter(F.col("role").isNotNull())


def fold_summary(folds: DataFrame, min_valid_rows: int = 1000, min_train_pos: int = 10,
                 require_nonempty: bool = False, rows: Column | None = None, positives: str = S.LABEL) -> DataFrame:
    """Per-cutoff sizes and the skip rule (open folds: valid >= 1000 rows and
    train positives >= 10; bounded folds: train and valid non-empty).  ``rows`` and
    ``positives`` are the counts behind a row where rows are already counted."""
    rows = F.lit(1) if rows is None else rows

    def total(role: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("role") == role, value)), F.lit(0)).cast("long")

    g = folds.groupBy("cutoff").agg(
        total("train", rows).alias("train_rows"), total("valid", rows).alias("valid_rows"),
        total("train", F.col(positives)).alias("train_pos"), total("valid", F.col(positives)).alias("valid_pos"))
    if require_nonempty:
        kept = (F.col("train_rows") > 0) & (F.col("valid_rows") > 0)
    else:
        kept = (F.col("valid_rows") >= min_valid_rows) & (F.col("train_pos") >= min_train_pos)
    return g.select("*", kept.alias("kept"))


def rolling_summary(df: DataFrame, cutoffs=tuple(S.ROLLING_CUTOFFS), width: int | None = None, **rule) -> DataFrame:
    """The :func:`fold_summary` of the rolling folds.  Rows are counted per period first, and
    only those counts are repeated for each cutoff."""
    periods = df.groupBy(S.PERIOD).agg(F.count(F.lit(1)).alias("_rows"), F.sum(S.LABEL).alias("_pos"))
    return fold_summary(fold_table(periods, cutoffs, width), rows=F.col("_rows"), positives="_pos", **rule)


def _distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).filter(F.col(key).isNotNull()).distinct()


def group_split(df: DataFrame, frac: float = 0.15, key: str = S.ORIGIN,
                seed: int = S.RANDOM_STATE) -> tuple[DataFrame, DataFrame]:
    """C4: ``ceil(frac * n_accounts)`` accounts (first in hash order) go to valid."""
    keys = _distinct_keys(df, key)
    n = keys.count()
    n_valid = int(math.ceil(frac * n))
    ranked = hash_positions(keys.select(key, stable_hash(key, seed).alias("_h")), "_h", key, "_pos", n=n)
    valid_keys = ranked.filter(F.col("_pos") < n_valid).select(key)
    return df.join(valid_keys, key, "left_anti"), df.join(valid_keys, key, "left_semi")


def group_roles(df: DataFrame, frac: float = 0.15, key: str = S.ORIGIN,
                seed: int = S.RANDOM_STATE) -> DataFrame:
    tr, va = group_split(df, frac, key, seed)
    return (tr.select("*", F.lit("train").alias("role"))
            .unionByName(va.select("*", F.lit("valid").alias("role"))))


def stratified_group_folds(df: DataFrame, k: int = 5, group: str = S.ORIGIN,
                           label: str = S.LABEL, seed: int = S.RANDOM_STATE) -> DataFrame:
    """Fold per group.  Groups ordered by (positives desc, rows desc, hash,
    key) are dealt to folds in a snake (0..k-1, k-1..0, ...), which keeps both
    the row counts and the positives balanced; no group spans two folds.
    Returns ``(group, fold)``."""
    stats = (df.filter(F.col(group).isNotNull()).groupBy(group)
             .agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_pos")))
    return deal_folds(stats, k, group, seed)


def deal_folds(stats: DataFrame, k: int = 5, group: str = S.ORIGIN, seed: int = S.RANDOM_STATE) -> DataFrame:
    """Folds of groups whose rows (``_n``) and positives (``_pos``) are already counted."""
    hashed = stats.select(group, "_n", "_pos", stable_hash(group, seed).alias("_h"))
    ranked = global_positions(hashed, [F.col("_pos").desc(), F.col("_n").desc(),
                                      F.col("_h"), F.col(group)], "_i")
    rnd = F.floor(F.col("_i") / k)
    j = F.col("_i") % k
    fold = F.when(rnd % 2 == 0, j).otherwise(F.lit(k - 1) - j).cast("int")
    return ranked.select(group, fold.alias("fold"))


def _dealt(loads: list, size: tuple, n: int, totals: tuple) -> list:
    """How many of ``n`` equal groups of ``size`` (per class) each fold gets when one after the other goes to the fold where it
    adds least to the variance of the class shares (then: with fewest rows so far, then the first).  ``loads`` are the folds' sums.

    What a group adds is, up to what all folds share, ``sum(load * size / total**2)`` over the classes.  Each group put
    into a fold raises that fold's cost by the same step, so the folds' costs are arithmetic progressions and the choices are
    the ``n`` smallest terms of all of them: found by bisection instead of one by one, in integers.
    """
    product = 1
    for t in totals:
        product *= max(t, 1) ** 2
    weights = [c * (product // max(t, 1) ** 2) for c, t in zip(size, totals)]
    costs = [sum(w * x for w, x in zip(weights, load)) for load in loads]
    step, k = sum(w * c for w, c in zip(weights, size)), len(loads)
    if step == 0:  # groups without rows add nothing anywhere
        return [n, *[0] * (k - 1)]
    below = lambda level: [max(0, -(-(level - c) // step)) for c in costs]  # terms under ``level``
    low, high = min(costs), max(costs) + step * (n + 1)
    while high - low > 1:  # the highest level with at most n terms under it
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= n else (low, mid)
    taken = below(low)
    # the terms at this level: fewest rows at that moment first, then the first fold
    rows = lambda f: sum(loads[f]) + taken[f] * sum(size)
    tied = sorted((f for f in range(k) if costs[f] + taken[f] * step == low), key=lambda f: (rows(f), f))
    for f in tied[:n - sum(taken)]:
        taken[f] += 1
    return taken


def greedy_group_folds(df: DataFrame, k: int = 5, group: str = S.ORIGIN, label: str = S.LABEL, seed: int = S.RANDOM_STATE) -> DataFrame:
    """C5, greedy: each group goes to the fold that keeps the class shares of the folds most even, the groups with the
    largest difference of their class counts first.  Returns ``(group, fold)``; null groups have none (:func:`with_folds`).

    Groups with the same counts are dealt together (:func:`_dealt`); the driver holds one row per pair of counts, not
    per group.  A group learns its fold from its rank among its equals, in the order of its hash.
    """
    stats = materialize(df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.sum(F.coalesce(F.col(label), F.lit(0))).cast("long").alias("_pos"), F.count(F.lit(1)).alias("_n")), "groups")
    runs = stats.groupBy("_n", "_pos").count().collect()   # one row per pair of counts
    runs = sorted(((r["_n"] - r["_pos"], r["_pos"], r["count"]) for r in runs), key=lambda r: (-abs(r[0] - r[1]), -r[0] - r[1], -r[1]))
    totals = tuple(sum(r[c] * r[2] for r in runs) for c in (0, 1))
    loads, start, ranges = [[0, 0] for _ in range(k)], 0, []
    for neg, pos, n in runs:
        at = start
        for f, taken in enumerate(_dealt(loads, (neg, pos), n, totals)):
            loads[f][0] += taken * neg
            loads[f][1] += taken * pos
            if taken:
                ranges.append((neg + pos, pos, start, at, at + taken, f))
            at += taken
        start += n
    spark = df.sparkSession
    kinds = "_n long, _pos long, _start long, _from long, _to long, fold int"
    plan = spark.createDataFrame(ranges, kinds)   # at most k rows per pair of counts; Spark broadcasts it if it is small
    hashed = stats.select(group, "_n", "_pos", stable_hash(group, seed).alias("_h"))
    differ = F.abs(F.col("_n") - 2 * F.col("_pos")).desc()
    ranked = global_positions(hashed, [differ, F.col("_n").desc(), F.col("_pos").desc(), F.col("_h"), F.col(group)], "_i")
    return (ranked.join(plan, ["_n", "_pos"]).where((F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_to")))
            .select(group, "fold"))


def fold_of_row(k: int, key: str = S.ID, seed: int = S.RANDOM_STATE) -> Column:
    """Fold of a row that belongs to no group: by the hash of its id."""
    return (stable_hash(key, seed) % k).cast("int")


def with_folds(df: DataFrame, folds: DataFrame, group: str = S.ORIGIN, k: int = 5, key: str = S.ID,
               seed: int = S.RANDOM_STATE) -> DataFrame:
    """``df`` with the ``fold`` of its group; every row gets one.  Rows without a group go by
    their id and are not part of the join, so they never meet in one task."""
    mine = df.filter(F.col(group).isNotNull()).join(folds, group, "left")
    mine = mine.select(*df.columns, F.coalesce(F.col("fold"), fold_of_row(k, key, seed)).alias("fold"))
    return mine.unionByName(df.filter(F.col(group).isNull()).select("*", fold_of_row(k, key, seed).alias("fold")))


def stratified_folds(df: DataFrame, k: int = 5, label: str = S.LABEL, key: str = S.ID,
                     seed: int = S.RANDOM_STATE) -> DataFrame:
    """Fold per row = position within its label class (hash order) mod k.
    Returns ``(key, fold)``."""
    base = df.select(key, label, stable_hash(key, seed).alias("_h"))
    ranked = hash_positions(base, "_h", key, "_i", by=(label,))
    return ranked.select(key, (F.col("_i") % k).cast("int").alias("fold"))


def account_sample(train: DataFrame, test: DataFrame, frac: float = 0.25, key: str = S.ORIGIN,
                   seed: int = S.RANDOM_STATE) -> tuple[DataFrame, DataFrame]:
    """Keep ``max(int(n * frac), 1)`` accounts of train and test (hash order)
    and all their rows in both."""
    keys = _distinct_keys(train, key).union(_distinct_keys(test, key)).distinct()
    n = keys.count()
    n_keep = max(int(n * frac), 1)
    ranked = hash_positions(keys.select(key, stable_hash(key, seed).alias("_h")), "_h", key, "_pos", n=n)
    kept = ranked.filter(F.col("_pos") < n_keep).select(key)
    return train.join(kept, key, "left_semi"), test.join(kept, key, "left_semi")


def row_subsample(df: DataFrame, n_max: int = S.ISO_SUBSAMPLE, key: str = S.ID,
                  seed: int = S.RANDOM_STATE) -> DataFrame:
    """At most ``n_max`` rows, the first in hash order (repeatable).

    Counts per cell of the hash (partial aggregates, a million cells at most) tell the cell in which the
    ``n_max``-th row stands; only rows up to that cell are numbered.
    """
    n = df.count()
    if n <= n_max:
        return df
    x = df.select("*", stable_hash(key, seed).alias("_h"))
    cell = hash_cell("_h", min(20, hash_bits(n, max(n_max // 8, 1))))
    upto = Window.orderBy("_cell")
    counts = x.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_c"))
    last = (counts.select("_cell", F.sum("_c").over(upto).alias("_upto")).where(F.col("_upto") >= n_max)
            .agg(F.min("_cell")).first()[0])
    ranked = hash_positions(x.filter(cell <= F.lit(last)), "_h", key, "_pos")
    return ranked.filter(F.col("_pos") < n_max).drop("_h", "_pos")


def operation_filter(df: DataFrame, operation: str = S.POSITIVE_OPERATION, min_rows: int = 100,
                     min_pos: int = 5, label: str = S.LABEL, check: bool = True) -> DataFrame:
    """Rows of one operation; fails when there are too few rows or positives."""
    out = df.filter(F.col(S.OPERATION) == operation)
    if check:
        row = out.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()
        if row["n"] < min_rows or (row["p"] or 0) < min_pos:
            raise InsufficientData(f"not enough {operation} rows for the specialist: "
                                   f"{row['n']} rows, {row['p']} positives")
    return out


def combine_splits(train: DataFrame, *others: tuple[str, DataFrame]) -> DataFrame:
    """Union by name with a ``split`` tag; missing columns (the label) are null."""
    out = train.select("*", F.lit("train").alias(S.SPLIT))
    for name, d in others:
        out = out.unionByName(d.select("*", F.lit(name).alias(S.SPLIT)), allowMissingColumns=True)
    return out
