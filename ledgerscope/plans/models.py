"""Distributed model fit / predict through ``pyspark.ml``.

The three base learners are Spark tree ensembles (boosted trees with holdout
early stopping, a random forest with balanced class weights, deeper boosted
trees).  Their hyper-parameters are Spark's own (each boosting iteration is a
distributed pass), not the single-machine boosters' values.  Class imbalance
is handled with ``weightCol``; AP is measured with the exact aggregate of
:mod:`ledgerscope.operators.metrics`.
"""
from __future__ import annotations

import contextlib
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import logit
from ..operators.ordered import exact_quantiles
from ..session import materialize

CATEGORICAL = [S.OPERATION]
MISSING = -1e9
SPREAD_ROWS = 5_000   # rows of a task below which dealing rows to more tasks does not pay
VECTOR_ROWS = (S.ID, S.LABEL, S.PERIOD, S.OPERATION, "features")   # what is read of assembled rows

# Spark learners standing in for the three boosters (see module docstring)
BASE_LEARNERS = {
    "gbt": dict(kind="gbt", maxIter=60, maxDepth=5, stepSize=0.1, subsamplingRate=0.8,
                featureSubsetStrategy="0.7", minInstancesPerNode=20, seed=S.RANDOM_STATE),
    "forest": dict(kind="rf", numTrees=60, maxDepth=8, subsamplingRate=0.8,
                   featureSubsetStrategy="sqrt", seed=S.RANDOM_STATE),
    "gbt_deep": dict(kind="gbt", maxIter=40, maxDepth=8, stepSize=0.1, subsamplingRate=0.8,
                     featureSubsetStrategy="0.7", minInstancesPerNode=10, seed=S.RANDOM_STATE + 1),
}
SPECIALIST = dict(kind="gbt", maxIter=60, maxDepth=6, stepSize=0.08, subsamplingRate=0.85,
                  featureSubsetStrategy="0.65", minInstancesPerNode=10, seed=S.RANDOM_STATE)
STARTER = dict(kind="gbt", maxIter=150, maxDepth=5, stepSize=0.06, seed=S.RANDOM_STATE)
META_GBT = dict(kind="gbt", maxIter=60, maxDepth=4, stepSize=0.05, minInstancesPerNode=200,
                subsamplingRate=0.9, seed=S.RANDOM_STATE)
# refit floors, in the learners' own iteration units
MIN_FULL_ITERS = {"gbt": 40, "gbt_deep": 30, "specialist": 40}


@dataclass
class Assembler:
    """Categorical index (fitted on train; unseen -> extra index) + vector."""
    feature_cols: list
    model: PipelineModel = None
    categorical: list = field(default_factory=lambda: list(CATEGORICAL))

    def fit(self, train: DataFrame) -> "Assembler":
        cats = [c for c in self.categorical if c in self.feature_cols]
        stages = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                                stringOrderType="alphabetAsc") for c in cats]
        inputs = [f"{c}__idx" if c in cats else c for c in self.feature_cols]
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
        self.model = Pipeline(stages=stages).fit(train)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        # Spark trees do not route missing values: nulls / NaN (unseen accounts)
        # become a sentinel below every real value, so a split can isolate them
        numeric = [c for c in self.feature_cols if c not in self.categorical]
        return self.model.transform(df.fillna(MISSING, subset=numeric))


def with_class_weight(df: DataFrame, scheme: str = "pos_ratio", label: str = S.LABEL,
                      out: str = "weight", counted: DataFrame | None = None) -> DataFrame:
    """E12 as a weight column: positives get neg/pos ('pos_ratio') or both
    classes n / (2 n_c) ('balanced'), by the labels of ``counted`` (default: ``df``)."""
    row = (df if counted is None else counted).agg(F.sum(label).alias("p"), F.count(label).alias("n")).first()
    pos, n = float(row["p"] or 0), float(row["n"] or 0)
    neg = n - pos
    if scheme == "balanced":
        wp = n / (2 * max(pos, 1.0))
        wn = n / (2 * max(neg, 1.0))
    else:
        wp, wn = neg / max(pos, 1.0), 1.0
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(wp)).otherwise(F.lit(wn)))


def _estimator(spec: dict, weight: str | None, validation_col: str | None = None):
    kw = {k: v for k, v in spec.items() if k != "kind"}
    common = dict(featuresCol="features", labelCol=S.LABEL)
    if weight:
        common["weightCol"] = weight
    if spec["kind"] == "gbt":
        if validation_col:
            common["validationIndicatorCol"] = validation_col
        return GBTClassifier(**common, **kw)
    if spec["kind"] == "rf":
        return RandomForestClassifier(**common, **kw)
    raise ValueError(spec["kind"])


@contextlib.contextmanager
def kept_vectors(*frames: DataFrame):
    """The frames with only what fits and scores read of them, kept on the executors' disks while the block runs.

    A fit reads its rows four times before its trees begin, and assembling the vectors takes most of such a pass.  Partitions and
    the order of rows stay as they are, and the trees' draws go by those.  On disk, as memory is for the fits' binned rows.
    """
    held = [df.select(*[c for c in VECTOR_ROWS if c in df.columns]).persist(StorageLevel.DISK_ONLY) for df in frames]
    try:
        yield held
    finally:
        for df in held:
            df.unpersist()


def fit_learner(spec: dict, train: DataFrame, valid: DataFrame | None = None,
                weight_scheme: str = "pos_ratio"):
    """Fit on assembled rows; with ``valid`` a boosted model stops early
    on the holdout loss (``validationIndicatorCol``)."""
    if spec["kind"] == "rf":
        weight_scheme = "balanced"
    if valid is not None and spec["kind"] == "gbt":
        both = (train.select("*", F.lit(False).alias("_is_valid"))
                .unionByName(valid.select("*", F.lit(True).alias("_is_valid"))))
        both = with_class_weight(both, weight_scheme, counted=train)  # holdout labels do not count
        return _estimator(spec, "weight", "_is_valid").fit(both)
    return _estimator(spec, "weight").fit(with_class_weight(train, weight_scheme))


def kept_iterations(model) -> int:
    """Trees kept by a (possibly early-stopped) boosted model."""
    return int(getattr(model, "getNumTrees", len(model.trees)))


def refit_full(spec: dict, name: str, holdout_model, full: DataFrame):
    """Refit on all training rows with the holdout's tree count, floored."""
    iters = max(kept_iterations(holdout_model), MIN_FULL_ITERS.get(name, 1))
    spec = dict(spec, maxIter=iters) if spec["kind"] == "gbt" else spec
    return fit_learner(spec, full)


def predict(model, df: DataFrame, out: str = "score") -> DataFrame:
    """Positive-class probability."""
    return (model.transform(df).withColumn(out, vector_to_array(F.col("probability"))[1])
            .drop("rawPrediction", "probability", "prediction"))


# ---------------------------------------------------------------- starter

def starter_preprocess(train: DataFrame, numeric: list, categorical: list) -> tuple[Pipeline, dict]:
    """Exact medians of the train columns fill numeric nulls (from counts per
    value, no task holds a column); categorical columns are one-hot encoded with
    unknown -> zero vector."""
    medians = dict.fromkeys(numeric, 0.0)
    if numeric:
        long = train.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in numeric])).alias("_e"))
        med = exact_quantiles(long.select("_e.*"), "value", [0.5], ["name"])
        medians |= {r["name"]: float(r["q0"]) for r in med.collect() if r["q0"] is not None}   # one row per column
    stages = []
    for c in categorical:
        # the indexer puts unknown values last, and the last category is the zero vector
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                                 stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=[f"{c}__idx"], outputCols=[f"{c}__oh"], dropLast=True,
                                 handleInvalid="error")]
    stages.append(VectorAssembler(inputCols=numeric + [f"{c}__oh" for c in categorical],
                                  outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages), medians


def spread(rows: DataFrame) -> DataFrame:
    """Written rows dealt evenly over the cores and written again, if they would be read by fewer tasks than there are cores.

    Narrow rows make small files, which Spark reads in few tasks; a boosted fit passes over them some hundred times.  Below
    ``SPREAD_ROWS`` rows a task they stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores or rows.count() < SPREAD_ROWS * cores:
        return rows
    return materialize(rows.repartition(cores), "spread")


def fit_starter(train: DataFrame, numeric: list, categorical: list, spec: dict = STARTER):
    """Preprocessing + boosted trees in one ``Pipeline``.  The rows are written once: medians, indexes, bins and the
    boosted rows are passes of their own, which would repeat the plan behind ``train``."""
    train = spread(materialize(train, "starter_rows"))
    pre, medians = starter_preprocess(train, numeric, categorical)
    filled = train.fillna(medians)
    gbt = _estimator(spec, None)
    model = Pipeline(stages=pre.getStages() + [gbt]).fit(filled)
    return model, medians


# -------------------------------------------------------------- stacking

def _logit_features(df: DataFrame, cols: list) -> DataFrame:
    x = df.select("*", *[logit(c).alias(f"{c}__logit") for c in cols])
    return VectorAssembler(inputCols=[f"{c}__logit" for c in cols], outputCol="features").transform(x)


def fit_stack_logistic(oof: DataFrame, cols: list, label: str = S.LABEL):
    """L2 logistic regression on logits; sklearn's C = 1 is regParam = 1 / n."""
    n = oof.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / max(n, 1),
                            elasticNetParam=0.0, standardization=False, maxIter=200)
    return lr.fit(_logit_features(oof, cols))


def predict_stack_logistic(model, df: DataFrame, cols: list, out: str = "stack") -> DataFrame:
    return predict(model, _logit_features(df, cols), out).drop("features", *[f"{c}__logit" for c in cols])


def fit_stack_gbt(oof: DataFrame, cols: list, spec: dict = META_GBT):
    """Shallow boosted trees on the base scores."""
    x = VectorAssembler(inputCols=cols, outputCol="features").transform(oof)
    return _estimator(spec, "weight").fit(with_class_weight(x))


def predict_stack_gbt(model, df: DataFrame, cols: list, out: str = "stack") -> DataFrame:
    x = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
    return predict(model, x, out).drop("features")
