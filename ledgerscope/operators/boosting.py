"""Second-order histogram boosting with an objective of one's own.

Features are cut into bins once: numeric ones at quantiles of the training rows, categorical ones at their values; a missing
value is a bin of its own, and a category that training never saw goes to the right of every split.  Each level of a tree is one
Spark job: tasks add up gradients and hessians per (node, feature, bin) with numpy, Spark sums the tasks' cells, and window
functions over the cells find the best split of each node.  The driver receives one row per node.

Gradients are rounded to integer multiples of ``2**-30`` and summed as integers, so a tree does not depend on how the rows are
dealt out.  Splits of numeric features try both directions for missing values; categories are ordered by their gradient ratio
and cut at the best prefix.

Margins are a column: after each block of rounds the rows are written again with the margins reached so far, and in
between a pass adds the few pending trees.  Holdout rows get one staged margin per round; the rounds end when their average
precision has not improved for ``patience`` rounds, and the best round is kept.

Null labels take part nowhere; an empty training table gives a model of no trees and margin 0.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import materialize, together
from . import metrics as M
from .ordered import exact_quantiles

UNIT = 1 << 30           # gradients are integers of this fraction
MISSING, UNSEEN = -1, -2  # bins beside 0, 1, ...
MAX_CATEGORIES = 255     # of one column, checked when the bins are fitted
SKETCHES = 16            # columns whose quantile sketches one task merges


# ---------------------------------------------------------------- objectives

def focal(gamma: float = 2.0, alpha: float = 0.25, floor: float = 1e-6) -> Callable:
    """``(margin, label) -> gradient, hessian, loss`` of the focal loss (K2, K3)."""
    def objective(x, y):
        p = 1.0 / (1.0 + np.exp(-x))
        p_t, a_t = np.where(y == 1, p, 1.0 - p), np.where(y == 1, alpha, 1.0 - alpha)
        log_pt, rest = np.log(np.clip(p_t, 1e-9, 1.0)), 1.0 - p_t
        grad = a_t * np.where(y == 1, 1.0, -1.0) * rest ** gamma * (gamma * p_t * log_pt + p_t - 1.0)
        hess = a_t * p_t * rest ** gamma * (rest * (gamma * log_pt + (2.0 * gamma + 1.0)) - gamma * gamma * p_t * log_pt)
        return grad, np.maximum(hess, floor), -a_t * rest ** gamma * log_pt
    return objective


def logistic(positive_weight: float = 1.0, floor: float = 1e-6) -> Callable:
    """The same for the log loss with weighted positives."""
    def objective(x, y):
        p, w = 1.0 / (1.0 + np.exp(-x)), np.where(y == 1, positive_weight, 1.0)
        loss = -np.log(np.clip(np.where(y == 1, p, 1.0 - p), 1e-15, 1.0))
        return w * (p - y), np.maximum(w * p * (1.0 - p), floor), w * loss
    return objective


def units(values: np.ndarray) -> np.ndarray:
    return np.floor(values * UNIT + 0.5)


# ---------------------------------------------------------------- bins

@dataclass(frozen=True)
class Binner:
    """Cut points of numeric columns and codes of categorical ones; bounded by ``bins`` and ``MAX_CATEGORIES`` a column."""
    numeric: list
    categorical: list
    edges: list
    codes: list

    @property
    def names(self) -> list:
        return [*self.numeric, *self.categorical]

    @property
    def width(self) -> int:
        """Cells of a feature: its bins, the missing and the unseen one."""
        return 2 + max([len(e) + 1 for e in self.edges] + [len(c) for c in self.codes], default=1)

    def transform(self, df: DataFrame, keep: list) -> DataFrame:
        """``keep`` and ``bins``, the bin of every feature in the order of ``names``: 16-bit integers in one binary value, which
        Spark passes on as it is, where an array is copied entry by entry in every pass."""
        edges, codes, n = self.edges, self.codes, len(keep)
        typed = [*[F.col(c).cast("double") for c in self.numeric], *[F.col(c).cast("string") for c in self.categorical]]
        taken = df.select(*keep, *[c.alias(f"_f{k}") for k, c in enumerate(typed)])  # a feature may be kept as well
        schema = ", ".join(f"`{name}` {kind}" for name, kind in df.select(*keep).dtypes)

        def run(batches):
            for b in batches:
                cells = np.empty((b.num_rows, len(edges) + len(codes)), np.int16)
                for k, cut in enumerate(edges):
                    x = b.column(n + k).to_numpy(zero_copy_only=False)
                    cells[:, k] = np.where(np.isnan(x), MISSING, np.searchsorted(cut, x))
                for k, known in enumerate(codes):
                    found = b.column(n + len(edges) + k).dictionary_encode()
                    place = np.array([*(known.get(v, UNSEEN) for v in found.dictionary.to_pylist()), MISSING], np.int16)
                    cells[:, len(edges) + k] = place[found.indices.fill_null(len(found.dictionary)).to_numpy()]
                starts = np.arange(b.num_rows + 1, dtype=np.int32) * (cells.itemsize * cells.shape[1])
                packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(starts), pa.py_buffer(cells)])
                yield pa.RecordBatch.from_arrays([*b.columns[:n], packed], [*keep, "bins"])

        return taken.mapInArrow(run, f"{schema}, bins binary")


def fit_bins(train: DataFrame, numeric: list, categorical: list, bins: int = 32, exact: bool = False) -> Binner:
    """Quantile cut points of the numeric columns and the values of the categorical ones.

    By default one aggregate of sketches; ``exact`` takes interpolated quantiles from counts per value, which costs a row per
    (column, value).  Nulls and NaN have no part in them.
    """
    steps = [k / bins for k in range(1, bins)]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    edges = {c: np.zeros(0) for c in numeric}
    if numeric and exact:
        long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), value(c).alias("value")) for c in numeric])).alias("e")).select("e.*")
        for row in exact_quantiles(long, "value", steps, ["name"]).collect():  # one row per column
            edges[row["name"]] = np.unique([row[f"q{k}"] for k in range(len(steps)) if row[f"q{k}"] is not None])
    elif numeric:
        # a sketch is large and every task has one per column: a job per block of columns reads only these and merges only theirs
        def quantiles(block):
            return train.agg(*[F.percentile_approx(value(c), steps, 10_000).alias(f"c{k}") for k, c in enumerate(block)]).first()

        blocks = [numeric[k:k + SKETCHES] for k in range(0, len(numeric), SKETCHES)]
        for block, row in zip(blocks, together([partial(quantiles, b) for b in blocks])):
            edges |= {c: np.unique(row[k] or []) for k, c in enumerate(block)}
    codes = []
    for c in categorical:
        found = train.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct().limit(MAX_CATEGORIES + 1).collect()
        if len(found) > MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {MAX_CATEGORIES} values: encode it as a number")
        codes.append({v: k for k, v in enumerate(sorted(r["v"] for r in found))})
    return Binner(list(numeric), list(categorical), [np.asarray(edges[c], float) for c in numeric], codes)


# ---------------------------------------------------------------- trees

@dataclass
class Tree:
    """Nodes in arrays: ``feature`` (-1 in a leaf), ``left`` (per node and cell: does it go left), ``child`` (the left one, the right
    one follows) and ``value``.  At most ``2 ** (depth + 1)`` nodes."""
    width: int
    feature: list = field(default_factory=lambda: [-1])
    left: list = field(default_factory=lambda: [None])
    child: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cells: np.ndarray, values: tuple[float, float]) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.left[node], self.child[node] = feature, cells, at
        for v in values:
            self.feature.append(-1)
            self.left.append(None)
            self.child.append(0)
            self.value.append(v)
        return at, at + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins has reached."""
        feature, child = np.array(self.feature), np.array(self.child)
        goes = np.stack([np.zeros(self.width, bool) if c is None else c for c in self.left])
        at = np.zeros(len(bins), np.int64)
        while len(moving := np.flatnonzero(feature[at] >= 0)):
            here = at[moving]
            at[moving] = child[here] + ~goes[here, bins[moving, feature[here]] + 2]
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass(frozen=True)
class BoostSpec:
    rounds: int = 100
    depth: int = 5
    rate: float = 0.1
    bins: int = 32
    l2: float = 1.0
    min_rows: int = 20
    min_hess: float = 1e-3
    patience: int = 100
    block: int = 5           # rounds between two writings of the margins
    objective: str = "focal"
    exact_bins: bool = False
    columns: float = 1.0     # share of the features that a tree may use
    seed: int = S.RANDOM_STATE


def _bins_of(column) -> np.ndarray:
    """The bins of a batch, a row each."""
    column = column.cast(pa.large_binary())
    if column.buffers()[2] is None:   # no features
        return np.zeros((len(column), 0), np.int16)
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.int16, (starts[-1] - starts[0]) // 2, starts[0]).reshape(len(column), -1)


def histogram(rows: DataFrame, objective: Callable, pending: list, tree: Tree, active: list, width: int, features: list) -> DataFrame:
    """``node, feature, bin, n, g, h`` over ``rows`` (``bins, label, margin``): integer sums of the rows that stand in the
    ``active`` nodes of ``tree`` with the margins of the ``pending`` trees added."""
    def run(batches):
        total = None
        place = np.full(len(tree.feature), -1)
        place[active] = np.arange(len(active))
        chosen = np.array(features, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            bins, y = _bins_of(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
            margin = b.column(2).to_numpy(zero_copy_only=False) + sum((t.margins(bins) for t in pending), np.zeros(len(y)))
            node = place[tree.nodes(bins)]
            some = np.flatnonzero(node >= 0)
            grad, hess, _ = objective(margin[some], y[some])
            grad, hess, first, columns = units(grad), units(hess), node[some] * width + 2, np.ascontiguousarray(bins[some].T)
            size = len(active) * width
            if total is None:
                total = np.zeros((3, len(chosen), size), np.int64)
            for k, f in enumerate(chosen):   # a column at a time stays in the cache
                cell = first + columns[f]
                # integers below 2**53 add up exactly in doubles; the batches' sums are added as integers
                for sums, weights in zip(total, (None, grad, hess)):
                    sums[k] += np.bincount(cell, weights, size).astype(np.int64)
        if total is not None:
            total = total.reshape(3, len(chosen), len(active), width).swapaxes(1, 2).reshape(3, -1)
            found = np.flatnonzero(total[0])
            at, cell = np.divmod(found, width)
            at, feature = np.divmod(at, len(chosen))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(active, np.int32)[at]), pa.array(chosen[feature].astype(np.int32)), pa.array((cell - 2).astype(np.int32)),
                                              *[pa.array(x[found]) for x in total]], ["node", "feature", "bin", "n", "g", "h"])

    cells = rows.select("bins", F.col(S.LABEL).cast("int"), "margin").mapInArrow(run, "node int, feature int, bin int, n long, g long, h long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    # a task has one row per cell already, so this one exchange serves the sums and the windows over them
    return cells.repartition("node", "feature").groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), wide("g"), wide("h"))


def split_candidates(hist: DataFrame, first_categorical: int, l2: float, min_rows: int, min_hess: float) -> DataFrame:
    """Every cut of every (node, feature): ``node, feature, place, missing_left, lefts, gain`` and the sums of both sides.

    Numeric features are cut after a bin, with the missing values on either side; categories, the missing one among them, after
    a prefix in the order of their gradient ratio.  ``lefts`` are the bins on the left (for numeric features the last one).
    """
    real = lambda c: c.cast("double") / F.lit(float(UNIT))
    category = F.col("feature") >= first_categorical
    side = Window.partitionBy("node", "feature")
    x = hist.withColumn("key", F.when(category, real(F.col("g")) / (real(F.col("h")) + F.lit(l2))).otherwise(F.col("bin").cast("double")))
    absent = ~category & (F.col("bin") == MISSING)
    order = side.orderBy("absent", "key", "bin")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("absent", absent)
    for c in ("n", "g", "h"):
        x = (x.withColumn(f"{c}_all", F.sum(c).over(side)).withColumn(f"{c}_absent", F.sum(F.when(F.col("absent"), F.col(c)).otherwise(0)).over(side))
             .withColumn(f"{c}_upto", F.sum(c).over(until)))
    x = (x.withColumn("place", F.row_number().over(order)).withColumn("lefts", F.when(category, F.collect_list("bin").over(until)).otherwise(F.array("bin")))
         .where(~F.col("absent")))
    x = x.withColumn("missing_left", F.explode(F.when(category, F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))))
    for c in ("n", "g", "h"):
        mine = F.col(f"{c}_upto") + F.when(F.col("missing_left"), F.col(f"{c}_absent")).otherwise(0)
        x = x.withColumn(f"{c}_left", mine).withColumn(f"{c}_right", F.col(f"{c}_all") - F.col(f"{c}_left"))
    part = lambda s: real(F.col(f"g_{s}")) * real(F.col(f"g_{s}")) / (real(F.col(f"h_{s}")) + F.lit(l2))
    fits = F.least("n_left", "n_right") >= min_rows
    for s in ("left", "right"):
        fits &= real(F.col(f"h_{s}")) >= min_hess
    return (x.where(fits).withColumn("gain", (part("left") + part("right")) - part("all"))
            .select("node", "feature", "place", "missing_left", "lefts", "gain", *[real(F.col(f"{c}_{s}")).alias(f"{c}_{s}") for c in "gh" for s in ("left", "right")],
                    "n_left", "n_right"))


def best_splits(candidates: DataFrame, *by: str) -> DataFrame:
    """The candidate of highest gain per ``by``; of equal ones the first feature, the earliest place, missing values left."""
    rest = ["lefts", "g_left", "g_right", "h_left", "h_right", "n_left", "n_right"]
    best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("place")).alias("p"), F.col("missing_left"), *rest)).alias("b")
    return candidates.groupBy(*by).agg(best).select("*", (-F.col("b.f")).alias("_feature"), (-F.col("b.p")).alias("place"), "b.gain", "b.missing_left",
                                                    *[f"b.{c}" for c in rest]).drop("b", *[c for c in ("feature",) if "feature" in by]).withColumnRenamed("_feature", "feature")


def grow(rows: DataFrame, objective: Callable, pending: list, binner: Binner, spec: BoostSpec, features: list) -> Tree:
    """One tree, a level per job; the driver gets a row per node that splits."""
    tree, active = Tree(binner.width), [0]
    for _ in range(spec.depth):
        if not active:
            break
        hist = histogram(rows, objective, pending, tree, active, binner.width, features)
        if tree.feature == [-1]:
            hist = materialize(hist, "root")  # also tells the root's own value
            one = hist.where(F.col("feature") == features[0]).agg(F.sum("g").cast("double"), F.sum("h").cast("double")).first()
            tree.value[0] = -spec.rate * (one[0] or 0.0) / ((one[1] or 0.0) + spec.l2 * UNIT)
        found = best_splits(split_candidates(hist, len(binner.numeric), spec.l2, spec.min_rows, spec.min_hess), "node").where("gain > 1e-12").collect()
        active = []
        for s in sorted(found, key=lambda s: s["node"]):
            cells = np.zeros(binner.width, bool)
            if s["feature"] < len(binner.numeric):
                cells[2:s["lefts"][0] + 3] = True
                cells[MISSING + 2] = s["missing_left"]
            else:
                cells[np.array(s["lefts"]) + 2] = True
            values = tuple(-spec.rate * s[f"g_{side}"] / (s[f"h_{side}"] + spec.l2) for side in ("left", "right"))
            active += tree.split(s["node"], s["feature"], cells, values)
    return tree


# ---------------------------------------------------------------- boosting

@dataclass
class Booster:
    binner: Binner
    start: float
    trees: list
    history: list = field(default_factory=list)  # (round, train loss, AP of the holdout or None)

    def margin(self, df: DataFrame, keep: list, out: str = "margin") -> DataFrame:
        return add_trees(self.binner.transform(df, keep).withColumn("margin", F.lit(self.start)), self.trees, keep).select(*keep, F.col("margin").alias(out))

    def predict(self, df: DataFrame, keep: list, out: str = "score") -> DataFrame:
        """``keep`` and the probability of label 1."""
        return self.margin(df, keep, "_m").withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_m")))).drop("_m")

    def report(self, spark: SparkSession) -> DataFrame:
        """``round, train_loss, ap, kept`` for every round that was fitted."""
        rows = [(r, loss, ap, r <= len(self.trees)) for r, loss, ap in self.history]
        return spark.createDataFrame(rows, "round int, train_loss double, ap double, kept boolean")


def add_trees(rows: DataFrame, trees: list, keep: list) -> DataFrame:
    """``rows`` (``keep, bins, margin``) with the trees added to the margin."""
    names = [*keep, "bins", "margin"]
    rows = rows.select(*names)

    def run(batches):
        for b in batches:
            margin = b.column(len(names) - 1).to_numpy(zero_copy_only=False)
            if b.num_rows:
                bins = _bins_of(b.column(len(names) - 2))
                for t in trees:
                    margin = margin + t.margins(bins)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(margin)], names)

    return rows.mapInArrow(run, rows.schema)


def staged(rows: DataFrame, trees: list, first: int) -> DataFrame:
    """``round, label, margin``: every row once per tree, with the margin after it; the first tree is round ``first``."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            bins, margin = _bins_of(b.column(0)), b.column(2).to_numpy(zero_copy_only=False)
            for k, t in enumerate(trees):
                margin = margin + t.margins(bins)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(margin), first + k, np.int32)), b.column(1), pa.array(margin)], ["round", S.LABEL, "margin"])
    return rows.select("bins", F.col(S.LABEL).cast("int"), "margin").mapInArrow(run, f"round int, {S.LABEL} int, margin double")


def stage_losses(rows: DataFrame, trees: list, first: int, objective: Callable) -> dict:
    """Mean loss of the rows after each tree; a task sends one row per tree."""
    def run(batches):
        sums, n = np.zeros(len(trees)), 0
        for b in batches:
            if not b.num_rows:
                continue
            bins, y, margin = _bins_of(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for k, t in enumerate(trees):
                margin = margin + t.margins(bins)
                sums[k] += objective(margin, y)[2].sum()
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(trees), dtype=np.int32)), pa.array(sums), pa.array(np.full(len(trees), n))], ["round", "s", "n"])
    done = rows.select("bins", F.col(S.LABEL).cast("int"), "margin").mapInArrow(run, "round int, s double, n long")
    return {r["round"]: r["m"] for r in done.groupBy("round").agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1))).alias("m")).collect()}


def kept_round(scores: list, patience: int) -> tuple[int, bool]:
    """The round (from 1) of the first highest score before it has not risen for ``patience`` rounds, and whether that happened."""
    best = 0
    for k, s in enumerate(scores):
        if best == 0 or s > scores[best - 1]:
            best = k + 1
        elif k + 1 - best >= patience:
            return best, True
    return best, False


def start_margin(train: DataFrame) -> float:
    """Log odds of the labels; 0 where one class is absent."""
    return log_odds(*train.agg(F.count(S.LABEL), F.sum(F.col(S.LABEL).cast("long"))).first())


def log_odds(n: int, positives: int | None) -> float:
    return float(np.log(positives / (n - positives))) if 0 < (positives or 0) < n else 0.0


@dataclass(frozen=True)
class Binned:
    """Training rows ``label, bins, margin`` (null where there are none) with what they were made from; fits of other settings can share them."""
    binner: Binner
    rows: DataFrame | None
    start: float
    n: int
    positives: int

    def prepare(self, df: DataFrame) -> DataFrame:
        known = self.binner.transform(df.where(F.col(S.LABEL).isNotNull()), [S.LABEL])
        return materialize(known.withColumn("margin", F.lit(self.start)), "binned")


def bin_rows(train: DataFrame, numeric: list, categorical: list, spec: BoostSpec = BoostSpec(), binner: Binner | None = None) -> Binned:
    """The labelled rows of ``train`` in bins (``binner``: known ones), written."""
    known = train.where(F.col(S.LABEL).isNotNull())
    binner = binner or fit_bins(known, numeric, categorical, spec.bins, spec.exact_bins)
    n, positives = known.agg(F.count(F.lit(1)), F.sum(F.col(S.LABEL).cast("long"))).first()
    made = Binned(binner, None, log_odds(n, positives), n, positives or 0)
    return replace(made, rows=made.prepare(known)) if n and binner.names else made


def fit_boosted(train: DataFrame, numeric: list, categorical: list, spec: BoostSpec = BoostSpec(), holdout: DataFrame | None = None,
                objective: Callable | None = None, resume: Booster | None = None, binned: Binned | None = None) -> Booster:
    """Boosted trees on ``train``; with ``holdout`` the rounds stop by its average precision.

    ``resume`` is a model of the same rows and settings with fewer rounds: its trees are kept and the rounds go on from there, with
    the same result as a fit in one go.  ``binned`` are the rows of ``train`` from :func:`bin_rows` with the same bins.
    """
    binned = binned or bin_rows(train, numeric, categorical, spec, resume.binner if resume else None)
    binner, start, n, positives = binned.binner, binned.start, binned.n, binned.positives
    objective = objective or (focal() if spec.objective == "focal" else logistic((n - positives) / max(positives, 1)))
    if binned.rows is None:
        return Booster(binner, start, [])
    trees, history = (list(resume.trees), list(resume.history)) if resume else ([], [])
    rows, held = binned.rows, None if holdout is None else binned.prepare(holdout)
    if trees:
        rows = materialize(add_trees(rows, trees, [S.LABEL]), "binned")
        held = held if held is None else materialize(add_trees(held, trees, [S.LABEL]), "binned")
    names = range(len(binner.names))
    while len(trees) < spec.rounds:
        pending = []
        for _ in range(min(spec.block, spec.rounds - len(trees))):
            draw = np.random.default_rng([spec.seed, len(trees) + len(pending)])
            features = sorted(draw.choice(len(names), max(1, round(spec.columns * len(names))), replace=False).tolist()) if spec.columns < 1 else list(names)
            pending.append(grow(rows, objective, pending, binner, spec, features))
        first = len(trees) + 1
        losses = stage_losses(rows, pending, first, objective)
        aps = {} if held is None else {r["round"]: r["ap"] for r in M.average_precision(staged(held, pending, first), "margin", S.LABEL, ["round"]).collect()}
        history += [(r, losses[r], aps.get(r)) for r in range(first, first + len(pending))]
        trees += pending
        if held is not None:
            best, over = kept_round([ap or 0.0 for _, _, ap in history], spec.patience)
            if over or len(trees) >= spec.rounds:
                return Booster(binner, start, trees[:best], history)
            held = materialize(add_trees(held, pending, [S.LABEL]), "binned")
        if len(trees) < spec.rounds:
            rows = materialize(add_trees(rows, pending, [S.LABEL]), "binned")
    return Booster(binner, start, trees, history)
