"""Isolation-forest anomaly score (I1, I2) on Spark.

Fit: each tree draws ``psi`` rows (default 256) from the row subsample by a
per-tree hash order; the candidate rows of all trees are produced by one
generator pass and grouped by tree, so ``applyInPandas`` builds each tree from
at most a few hundred rows.  The fitted node table has at most
``n_trees * (2 * psi - 1)`` rows whatever the data size, which is the bound
that makes it safe to ship to executors for scoring.

Score: a vectorised ``pandas_udf`` walks all trees for a batch of rows with
NumPy; the score is ``-2 ** (-mean path length / c(psi))`` (more negative is
more abnormal), path length = leaf depth + c(leaf size).
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import materialize

EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int, is_leaf boolean")


def average_path_length(n: np.ndarray | float) -> np.ndarray:
    """c(n): expected path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


def _build_tree(tree_id: int, x: np.ndarray, max_depth: int, seed: int) -> list:
    rng = np.random.default_rng([seed, tree_id])
    nodes = []   # (node, feature, threshold, left, right, size, depth, is_leaf)

    def grow(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(None)
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[me] = (me, -1, 0.0, -1, -1, len(idx), depth, True)
            return me
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            nodes[me] = (me, -1, 0.0, -1, -1, len(idx), depth, True)
            return me
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < t
        left = grow(idx[go_left], depth + 1)
        right = grow(idx[~go_left], depth + 1)
        nodes[me] = (me, f, t, left, right, len(idx), depth, False)
        return me

    grow(np.arange(len(x)), 0)
    return nodes


@dataclass
class IsolationForestModel:
    features: list
    nodes: pd.DataFrame          # the node table (bounded size)
    psi: int

    def arrays(self):
        out = []
        for _, g in self.nodes.groupby("tree"):
            g = g.sort_values("node")
            out.append((g["feature"].to_numpy(), g["threshold"].to_numpy(), g["left"].to_numpy(),
                        g["right"].to_numpy(), g["depth"].to_numpy(),
                        average_path_length(g["size"].to_numpy()) + g["depth"].to_numpy()))
        return out


def fit_isolation_forest(df: DataFrame, features=tuple(S.ISO_FEATURES), n_trees: int = S.ISO_TREES,
                         max_samples: int = S.ISO_SAMPLES_PER_TREE,
                         seed: int = S.RANDOM_STATE, key: str = S.ID) -> IsolationForestModel:
    features = list(features)
    sample = df.select(key, *features)  # every tree draws from all rows
    n = sample.count()
    psi = int(min(max_samples, n))
    if psi == 0:
        raise ValueError("no rows to fit the isolation forest")
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    rate = min(1.0, 3.0 * psi / n)
    u = lambda t: (F.abs(F.xxhash64(F.col(key), t, F.lit(seed))) % F.lit(2 ** 31)) / F.lit(float(2 ** 31))
    while True:
        # the rows are read once: the candidates, about 3 * psi a tree, are written and counted there.  Exploding all tree
        # numbers keeps the hash in generated code, a filter of an array does not
        cand = (sample.select(key, *features, F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
                .filter(u(F.col("tree")) < F.lit(rate)).select("tree", u(F.col("tree")).alias("_u"), *features))
        cand = materialize(cand, "forest_rows")
        counts = cand.groupBy("tree").count().agg(F.count_if(F.col("count") < psi), F.count(F.lit(1))).first()
        if (counts[0] == 0 and counts[1] == n_trees) or rate >= 1.0:
            break
        rate = min(1.0, rate * 2.0)

    feats = list(features)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_u", kind="mergesort").head(psi)
        x = pdf[feats].to_numpy(dtype=float)
        x = np.nan_to_num(x, nan=0.0)
        rows = _build_tree(t, x, max_depth, seed)
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "size",
                                          "depth", "is_leaf"])
        out.insert(0, "tree", t)
        return out

    nodes = cand.groupBy("tree").applyInPandas(build, NODE_SCHEMA)
    # bounded by n_trees * (2 * psi - 1) rows
    return IsolationForestModel(feats, nodes.toPandas(), psi)


def score_arrays(model_arrays, psi: int, x: np.ndarray) -> np.ndarray:
    n = len(x)
    cells, rows = np.ascontiguousarray(x.T).ravel(), np.arange(n)   # one column after the other
    total = np.zeros(n)
    for feature, threshold, left, right, depth, leaf_len in model_arrays:
        # a leaf is its own child, so all rows take the same number of steps
        inner, me = feature >= 0, np.arange(len(feature))
        start = np.where(inner, feature, 0).astype(np.int64) * n
        child = np.stack([np.where(inner, right, me), np.where(inner, left, me)], axis=1).ravel().astype(np.int64)
        node = np.zeros(n, dtype=np.int64)
        for _ in range(int(depth.max())):
            goes_left = cells.take(start.take(node) + rows) < threshold.take(node)
            node = child.take(2 * node + goes_left)
        total += leaf_len.take(node)
    mean = total / len(model_arrays)
    return -np.power(2.0, -mean / average_path_length(np.array([psi], dtype=float))[0])


def score_column(model: IsolationForestModel, df: DataFrame) -> Column:
    """I2 as a column expression (vectorised pandas UDF)."""
    arrays = df.sparkSession.sparkContext.broadcast(model.arrays())
    psi = model.psi

    @F.pandas_udf("double")
    def _score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float, na_value=0.0) for c in cols])
        return pd.Series(score_arrays(arrays.value, psi, x))

    return _score(*[F.col(c).cast("double") for c in model.features])


def add_isolation_score(df: DataFrame, model: IsolationForestModel, out: str = "iso_anomaly_score") -> DataFrame:
    return df.withColumn(out, score_column(model, df))
