"""Validation and pipelines (J12-J19, L2-L4, E14) composed from the operators.

Every fold has its own encodings and reference statistics (no leakage of the valid
labels).  What is the same in all folds of the same rows is computed once
(:class:`SharedFeatures`).  Feature tables are written to the checkpoint directory, so
the model fits read materialised rows and a lost executor does not replay the feature plan.

Folds, learners and trials do not depend on each other: their jobs are submitted side
by side (:func:`~ledgerscope.session.together`), as many as ``fits_at_once`` allows for their rows.
"""
from __future__ import annotations

import json
import random
import threading
import uuid
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import fusion as FU
from ..operators import metrics as M
from ..operators import splits as SP
from ..operators import submission as SU
from ..session import ensure_checkpoint_dir, files_of, fits_at_once, materialize, scratch, together
from ..sources import publish as PB
from ..sources import sinks as SK
from . import features as FT
from . import models as MD

LEARNERS = ("gbt", "forest", "gbt_deep")


def feature_frames(train: DataFrame, valid: DataFrame | None = None, test: DataFrame | None = None,
                   iso: bool = True, **feature_kw) -> tuple[dict, list]:
    """Assembled feature rows by split tag, written once, and the feature columns
    (157 with the anomaly score).  Valid and test rows are ranked apart."""
    return assembled(materialize(FT.build_feature_table(train, test, valid=valid, iso=iso, **feature_kw), "features"))


def assembled(ft: DataFrame) -> tuple[dict, list]:
    """The :func:`feature_frames` of a written feature table."""
    cols = FT.feature_columns(ft)
    parts = {s: ft.filter(F.col(S.SPLIT) == s) for s in ("train", "valid", "test")}
    assembler = MD.Assembler(cols).fit(parts["train"])
    # Spark moves no filter below the assembler: a split is taken before, or its vectors would be made of all rows
    return {s: assembler.transform(df) for s, df in parts.items()}, cols


def fold_frames(tr: DataFrame, va: DataFrame, shared: SharedFeatures | None = None, way: object = None, **feature_kw):
    """Assembled train and valid rows of one fold and the feature columns, where given from the features that folds share."""
    frames, cols = feature_frames(tr, va, **feature_kw) if shared is None else shared.frames(way)
    return frames["train"], frames["valid"], cols


class SharedFeatures:
    """Feature frames of several folds of the same rows from one table, written when the first fold asks for it.

    ``splits`` gives each fold's split of a row as a column; see :func:`~ledgerscope.plans.features.build_fold_features`.
    """

    def __init__(self, rows: DataFrame, splits: dict, iso: bool = True, **feature_kw):
        self._rows, self._splits, self._kw = rows, splits, dict(iso=iso, **feature_kw)
        self._lock, self._table = threading.Lock(), None

    def table(self) -> DataFrame:
        """The written table of all folds."""
        with self._lock:
            if self._table is None:
                ways = {f"__{w}": c for w, c in self._splits.items()}
                self._table = materialize(FT.build_fold_features(self._rows, ways, **self._kw), "features")
            return self._table

    def frames(self, way) -> tuple[dict, list]:
        """The :func:`feature_frames` of one fold."""
        return assembled(FT.fold_table(self.table(), f"__{way}"))


def split_at(cutoff: int, width: int | None = None) -> Column:
    """Split of a row by its period; null outside of a bounded fold."""
    p = F.col(S.PERIOD)
    return F.when(p < cutoff, "train").when(p >= cutoff if width is None else (p >= cutoff) & (p < cutoff + width), "valid")


def split_out(fold: int) -> Column:
    """Split of a row by its group fold; rows without one are test rows."""
    return F.when(F.col("fold") == fold, "valid").when(F.col("fold") != fold, "train").otherwise("test")


def ap_of(df: DataFrame, score: str) -> float:
    return M.average_precision_value(df, score, S.LABEL)


def ap_by_model(df: DataFrame, names, by: tuple = ()) -> DataFrame:
    """AP of several score columns in one pass: ``by..., model, ap``."""
    long = df.select(S.LABEL, *by, F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(n).alias("_s")) for n in names])).alias("_e")).select(
        S.LABEL, *by, "_e.*")
    return M.average_precision(long, "_s", S.LABEL, [*by, "model"])


def score_fold(trA: DataFrame, vaA: DataFrame, learners=LEARNERS, early_stop: bool = True,
               at_once: int | None = None) -> tuple[dict, DataFrame, dict]:
    """Fit each learner on the fold (holdout early stopping on valid); AP per
    learner, the valid predictions (id, label, operation, one column per
    learner) and the models.  The learners are fitted side by side, ``at_once`` of them (by
    default as the rows allow), and score one frame after the other, so nothing is joined.  The vectors are made once for all."""
    with MD.kept_vectors(trA, vaA) as (trA, vaA):
        return _fitted_and_scored(trA, vaA, learners, early_stop, at_once)


def _fitted_and_scored(trA: DataFrame, vaA: DataFrame, learners=LEARNERS, early_stop: bool = True,
                       at_once: int | None = None) -> tuple[dict, DataFrame, dict]:
    """:func:`score_fold` on frames whose vectors are kept."""
    at_once = fits_at_once(trA.count()) if at_once is None and len(learners) > 1 else at_once or 1
    fits = [partial(MD.fit_learner, MD.BASE_LEARNERS[n], trA, vaA if early_stop else None) for n in learners]
    models = dict(zip(learners, together(fits, at_once)))
    preds = materialize(scored(models, vaA).select(S.ID, S.LABEL, S.OPERATION, *learners), "predictions")
    found = {r["model"]: r["ap"] for r in ap_by_model(preds, learners).collect()}   # one row per learner
    return {n: float(found.get(n, 0.0)) for n in learners}, preds, models


def scored(models: dict, df: DataFrame) -> DataFrame:
    """``df`` with one probability column per model."""
    for name, model in models.items():
        df = MD.predict(model, df, name)
    return df


def refitted(models: dict, full: DataFrame) -> dict:
    """Each learner refitted on all labelled rows, boosted ones with the tree count kept on the holdout."""
    fits = [partial(MD.refit_full, MD.BASE_LEARNERS[n], n, model, full) for n, model in models.items()]
    return dict(zip(models, together(fits, fits_at_once(full.count()))))


def score_weights(scores: dict) -> dict:
    """K4: weights proportional to the scores, equal if their sum is not positive."""
    total = sum(scores.values())
    return {k: (v / total if total > 0 else 1.0 / len(scores)) for k, v in scores.items()}


def blend_choice(preds: DataFrame, scores: dict) -> tuple[dict, str, float]:
    """K4-K7: score-weighted weights against the weights of highest AP."""
    names = list(scores)
    w_avg = score_weights(scores)
    search = FU.search_weights(preds, names)
    w_opt = FU.best_weights(search, names)
    ap_opt = ap_of(FU.blend(preds, w_opt, "_b"), "_b")
    ap_avg = ap_of(FU.blend(preds, w_avg, "_b"), "_b")
    if ap_opt >= ap_avg:
        return w_opt, "optimized", ap_opt
    return w_avg, "score-weighted", ap_avg


def validation_report(train: DataFrame, cutoff: int = S.VAL_PERIOD_CUTOFF, path: str | None = None) -> dict:
    """Temporal holdout for the three learners and their ensemble, group
    holdout for the first; written as JSON to ``path`` when given."""
    shared = None
    if train.filter(F.col(S.PERIOD).isNull()).isEmpty():   # else the holdouts have not the same rows
        shared = SharedFeatures(SP.group_roles(train), {"temporal": split_at(cutoff), "group": F.col("role")}, unsupervised_ref="train")

    def temporal():
        trA, vaA, _ = fold_frames(*SP.temporal_split(train, cutoff), shared=shared, way="temporal", unsupervised_ref="train")
        scores, preds, _ = score_fold(trA, vaA)
        return scores, *blend_choice(preds, scores)

    def group():
        trG, vaG, _ = fold_frames(*SP.group_split(train), shared=shared, way="group", unsupervised_ref="train")
        return score_fold(trG, vaG, learners=("gbt",))[0]

    (scores, weights, kind, ens), g_scores = together([temporal, group], fits_at_once(train.count()))
    report = {"temporal_cutoff": cutoff, "temporal_scores": scores, "ensemble_kind": kind,
              "ensemble_score": float(ens), "ensemble_weights": weights, "group_score": g_scores["gbt"]}
    if path:
        SK.write_report(train.sparkSession, report, path)
    return report


def validate_models(spark: SparkSession, train: DataFrame, cutoff: int = S.VAL_PERIOD_CUTOFF,
                    path: str | None = None) -> DataFrame:
    """The :func:`validation_report` as rows."""
    r = validation_report(train, cutoff, path)
    rows = [("temporal", k, v, float(r["ensemble_weights"][k])) for k, v in r["temporal_scores"].items()]
    rows.append(("temporal", f"ensemble:{r['ensemble_kind']}", r["ensemble_score"], None))
    rows.append(("group", "gbt", r["group_score"], None))
    return spark.createDataFrame(rows, "check string, model string, ap double, weight double")


def cv_rolling(spark: SparkSession, train: DataFrame, cutoffs=tuple(S.ROLLING_CUTOFFS),
               min_valid: int = 1000, min_pos: int = 10) -> DataFrame:
    """Open-ended rolling folds, skip rule from the fold summary."""
    summary = SP.rolling_summary(train, cutoffs, min_valid_rows=min_valid, min_train_pos=min_pos).collect()  # one row per cutoff
    kept = [r for r in sorted(summary, key=lambda r: r["cutoff"]) if r["kept"]]
    shared = SharedFeatures(train.filter(F.col(S.PERIOD).isNotNull()), {int(r["cutoff"]): split_at(int(r["cutoff"])) for r in kept})

    def row(r):
        trA, vaA, _ = fold_frames(*SP.temporal_split(train, int(r["cutoff"])), shared=shared, way=int(r["cutoff"]))
        sc, _, _ = score_fold(trA, vaA, learners=("gbt",))
        return int(r["cutoff"]), int(r["train_rows"]), int(r["valid_rows"]), float(sc["gbt"])

    most = max((r["train_rows"] + r["valid_rows"] for r in kept), default=0)
    rows = together([partial(row, r) for r in kept], fits_at_once(most))
    return spark.createDataFrame(rows, "cutoff int, train_rows long, valid_rows long, ap double")


def cv_group(spark: SparkSession, train: DataFrame, k: int = 5) -> DataFrame:
    """Stratified group k-fold over origin accounts."""
    x = grouped(train, k)
    shared = SharedFeatures(x, {f: split_out(f) for f in range(k)})

    def row(f, tr, va):
        trA, vaA, _ = fold_frames(tr, va, shared=shared, way=f)
        sc, _, _ = score_fold(trA, vaA, learners=("gbt",))
        return f, trA.count(), vaA.count(), float(sc["gbt"])

    rows = together([partial(row, *part) for part in parts_of(x, k)], fits_at_once(train.count()))
    return spark.createDataFrame(rows, "fold int, train_rows long, valid_rows long, ap double")


def group_parts(train: DataFrame, k: int = 5):
    """``(fold, train rows, valid rows)`` of the stratified group folds over origin accounts; rows
    without one are in the fold of their id."""
    yield from parts_of(grouped(train, k), k)


def grouped(train: DataFrame, k: int) -> DataFrame:
    """``train`` with its group ``fold``."""
    return SP.with_folds(train, materialize(SP.stratified_group_folds(train, k), "folds"), S.ORIGIN, k)


def parts_of(x: DataFrame, k: int):
    """``(fold, train rows, valid rows)`` of rows with a ``fold``."""
    for f in range(k):
        yield f, x.filter(F.col("fold") != f).drop("fold"), x.filter(F.col("fold") == f).drop("fold")


def cv_ensemble(spark: SparkSession, train: DataFrame, cutoffs=tuple(S.ROLLING_CUTOFFS),
                width: int = S.BOUNDED_FOLD_WIDTH, k: int = 5, schemes: tuple = ("rolling", "group")) -> DataFrame:
    """Three learners and their score-weighted ensemble over bounded rolling
    folds and over group folds, on the reduced feature set (no graph, rolling,
    profile, anomaly).  One row per (scheme, fold, model); a rolling fold is named by its cutoff."""
    parts, shared = [], {}

    def share(scheme, rows, splits):
        # folds without train or valid rows are left out
        counts = rows.agg(*[F.count_if(c == s) for c in splits.values() for s in ("train", "valid")]).first()
        splits = {f: c for k, (f, c) in enumerate(splits.items()) if counts[2 * k] and counts[2 * k + 1]}
        parts.extend((scheme, f, *[rows.filter(c == s) for s in ("train", "valid")]) for f, c in splits.items())
        shared[scheme] = SharedFeatures(rows, splits, iso=False, unsupervised_ref="train", blocks=())

    if "rolling" in schemes:
        share("rolling", train.filter(F.col(S.PERIOD).isNotNull()), {int(c): split_at(int(c), width) for c in cutoffs})
    if "group" in schemes:
        share("group", grouped(train, k), {f: split_out(f) for f in range(k)})

    def scores(scheme, fold, tr, va):
        trA, vaA, _ = fold_frames(tr, va, shared=shared[scheme], way=fold)
        sc, preds, _ = score_fold(trA, vaA, at_once=1)   # the folds run side by side already
        return [*[(scheme, fold, n, v) for n, v in sc.items()],
                (scheme, fold, "ensemble", ap_of(FU.blend(preds, score_weights(sc), "_b"), "_b"))]

    together([x.table for scheme, x in shared.items() if any(p[0] == scheme for p in parts)])   # side by side, before any fold waits for its own
    found = together([partial(scores, *part) for part in parts], fits_at_once(train.count()))
    rows = [row for fold in found for row in fold]
    return spark.createDataFrame(rows, "scheme string, fold int, model string, ap double")


def fold_summary_table(report: DataFrame, *group: str) -> DataFrame:
    """Mean and population std of AP over folds (per model when given)."""
    return report.groupBy(*group).agg(F.avg("ap").alias("mean_ap"), F.stddev_pop("ap").alias("std_ap"),
                                      F.count(F.lit(1)).alias("n_folds"))


def oof_scores(spark: SparkSession, train: DataFrame, test: DataFrame, k: int = 5, shared: SharedFeatures | None = None) -> DataFrame:
    """Out-of-fold predictions of the three learners over group folds;
    each train id appears exactly once.  Test rows share the unsupervised
    statistics of a fold but are ranked apart from its valid rows."""
    shared = shared or shared_by_folds(train, test, k)

    def scores(f):
        frames, _ = shared.frames(f)
        _, preds, _ = score_fold(frames["train"], frames["valid"], at_once=1)   # the folds run side by side already
        return preds.select(S.ID, F.lit(f).alias("fold"), *LEARNERS, F.col(S.LABEL).alias(S.TARGET))

    parts = together([partial(scores, f) for f in range(k)], fits_at_once(train.count()))
    return reduce(DataFrame.unionByName, parts)


def shared_by_folds(train: DataFrame, test: DataFrame, k: int) -> SharedFeatures:
    """Features of the group folds beside the test rows, and, as the fold 'whole', of all train rows."""
    rows = grouped(train, k).unionByName(test.drop(S.LABEL), allowMissingColumns=True)
    whole = F.when(F.col("fold").isNotNull(), "train").otherwise("test")
    return SharedFeatures(rows, {f: split_out(f) for f in range(k)} | {"whole": whole})


def oof_report(oof: DataFrame, models=LEARNERS, label: str = S.TARGET, fold: str = "fold") -> DataFrame:
    """AP of each model per fold and over all rows (null fold)."""
    x = oof.withColumnRenamed(label, S.LABEL) if label != S.LABEL else oof
    whole = ap_by_model(x, models).select(F.lit(None).cast("int").alias(fold), "model", "ap")
    return ap_by_model(x, models, (fold,)).select(F.col(fold).cast("int").alias(fold), "model", "ap").unionByName(whole)


def holdout_fit(train_rows: DataFrame, cutoff: int = S.VAL_PERIOD_CUTOFF) -> tuple[dict, DataFrame, dict]:
    """The learners fitted on the periods before ``cutoff`` and stopped on the rest:
    AP, predictions of the rest, models."""
    with MD.kept_vectors(train_rows) as (rows,):
        return _fitted_and_scored(*SP.temporal_split(rows, cutoff))


def test_predictions(train: DataFrame, test: DataFrame, shared: SharedFeatures | None = None) -> DataFrame:
    """Base predictions of the test rows by the holdout-stopped learners."""
    frames, _ = feature_frames(train, test=test) if shared is None else shared.frames("whole")
    _, _, models = holdout_fit(frames["train"])
    return scored(models, frames["test"]).select(S.ID, *LEARNERS)


def stack_scores(oof: DataFrame, scores: DataFrame, cols=LEARNERS, label: str = S.TARGET) -> DataFrame:
    """Both stackers fitted on out-of-fold base scores (``cols`` and ``label``) and applied to the base scores of other rows."""
    cols = list(cols)
    base = materialize(oof.select(*cols, F.col(label).alias(S.LABEL)), "oof")
    linear, trees = MD.fit_stack_logistic(base, cols), MD.fit_stack_gbt(base, cols)
    stacked = MD.predict_stack_logistic(linear, scores.select(S.ID, *cols), cols, "stack_logistic")
    return MD.predict_stack_gbt(trees, stacked, cols, "stack_gbt").select(S.ID, "stack_logistic", "stack_gbt")


def stack_out_of_fold(spark: SparkSession, train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """Test rows stacked by models that saw only scores of learners fitted without the row's account."""
    shared = shared_by_folds(train, test, k)
    oof, scores = together([partial(oof_scores, spark, train, test, k, shared), partial(test_predictions, train, test, shared)],
                           fits_at_once(train.count()))
    return stack_scores(oof, scores)


SEARCH_SPACE = {
    "gbt": dict(maxDepth=[3, 4, 5, 6, 8], stepSize=[0.03, 0.05, 0.1, 0.2], maxIter=[20, 40, 60],
                subsamplingRate=[0.6, 0.8, 1.0], minInstancesPerNode=[5, 20, 80]),
    "forest": dict(numTrees=[30, 60, 100], maxDepth=[4, 6, 8, 10], subsamplingRate=[0.6, 0.8, 1.0],
                   featureSubsetStrategy=["sqrt", "0.3", "0.7"], minInstancesPerNode=[1, 5, 20]),
    "gbt_deep": dict(maxDepth=[6, 7, 8, 10], stepSize=[0.03, 0.05, 0.1], maxIter=[20, 40],
                     subsamplingRate=[0.6, 0.8, 1.0], minInstancesPerNode=[1, 10, 30]),
}


def random_search(spark: SparkSession, train: DataFrame, trials: int = 4, seed: int = S.RANDOM_STATE,
                  learners=LEARNERS) -> DataFrame:
    """Seeded random search of each learner's settings on the fixed temporal
    holdout; one row per trial with its settings as JSON, ``best`` marks the highest AP of a learner."""
    tr, va = SP.temporal_split(train)
    trA, vaA, _ = fold_frames(tr, va, unsupervised_ref="train")
    drawings = []
    for name in learners:
        rng = random.Random(f"{seed}-{name}")
        drawings += [(name, t, {k: rng.choice(v) for k, v in SEARCH_SPACE[name].items()}) for t in range(trials)]

    def trial(name, t, drawn):
        model = MD.fit_learner(dict(MD.BASE_LEARNERS[name], **drawn), trA, vaA)
        return name, t, drawn, ap_of(MD.predict(model, vaA, "_s"), "_s")

    with MD.kept_vectors(trA, vaA) as (trA, vaA):
        found = together([partial(trial, *d) for d in drawings], fits_at_once(trA.count()))
    best = {n: max((x for x in found if x[0] == n), key=lambda x: (x[3], -x[1]))[1] for n in learners if trials}
    rows = [(n, t, json.dumps(drawn, sort_keys=True), ap, best[n] == t) for n, t, drawn, ap in found]
    return spark.createDataFrame(rows, "learner string, trial int, settings string, ap double, best boolean")


def quick_validation(spark: SparkSession, train: DataFrame, test: DataFrame, frac: float = 0.25,
                     cutoff: int = S.VAL_PERIOD_CUTOFF, baseline: float = 0.360) -> DataFrame:
    """Account sample, temporal holdout, three learners + score-weighted ensemble."""
    tr_s, te_s = SP.account_sample(train, test, frac)
    tr, va = SP.temporal_split(tr_s, cutoff)
    frames, _ = feature_frames(tr, va, te_s)
    sc, preds, _ = score_fold(frames["train"], frames["valid"])
    ens = ap_of(FU.blend(preds, score_weights(sc), "_b"), "_b")
    rows = [(k, float(v)) for k, v in sc.items()] + [("ensemble", float(ens)), ("gain", float(ens - baseline))]
    return spark.createDataFrame(rows, "model string, value double")


def baseline_manifest(spark: SparkSession, train: DataFrame, test: DataFrame,
                      rolling_report: DataFrame | None = None,
                      group_report: DataFrame | None = None) -> DataFrame:
    """Both CVs, data fingerprints and the seed in one row."""
    from ..sources.sinks import money_canonical_columns, table_fingerprint
    roll = fold_summary_table(rolling_report if rolling_report is not None
                              else cv_rolling(spark, train)).first()
    grp = fold_summary_table(group_report if group_report is not None else cv_group(spark, train)).first()
    fp_tr = table_fingerprint(train, money_canonical_columns()).first()
    fp_te = table_fingerprint(test.withColumn(S.LABEL, F.lit(None).cast("int")), money_canonical_columns()).first()
    row = (S.RANDOM_STATE, int(fp_tr["fingerprint"] or 0), int(fp_te["fingerprint"] or 0),
           roll["mean_ap"], roll["std_ap"], grp["mean_ap"], grp["std_ap"])
    return spark.createDataFrame([row], "seed int, train_fingerprint long, test_fingerprint long, "
                                        "rolling_mean_ap double, rolling_std_ap double, group_mean_ap double, "
                                        "group_std_ap double")


# ----------------------------------------------------------------- pipelines

def report_path(spark: SparkSession, name: str) -> str:
    """A fresh place for a report under the session's shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports/{name}-{uuid.uuid4().hex}"


def train_final_and_submit(spark: SparkSession, train: DataFrame, test: DataFrame, sample: DataFrame,
                           weights: dict | None = None, iso: bool = True, report: str | None = None,
                           predictions_path: str | None = None, submission_path: str | None = None) -> DataFrame:
    """L3: the blend weights come from ``weights``, else from the stored validation
    report at ``report``, else from a validation run now (and stored there).
    Features on train + test, holdout fits (cutoff 96) to size the refits, full
    refits, blend, operation prior, right join to the sample, checks.  The base
    predictions and the submission are written where paths are given."""
    def blend_weights():
        if weights is not None:
            return weights
        if report and SK.path_exists(spark, report):
            return SK.read_report(spark, report)["ensemble_weights"]
        return validation_report(train, path=report)["ensemble_weights"]

    def test_scores():
        frames, _ = feature_frames(train, test=test, iso=iso)
        with MD.kept_vectors(frames["train"]) as (rows,):
            _, _, models = _fitted_and_scored(*SP.temporal_split(rows))
            full = refitted(models, rows)
        preds = scored(full, frames["test"]).select(S.ID, S.OPERATION, *LEARNERS)
        return materialize(preds, "test_predictions")

    chosen, preds = together([blend_weights, test_scores], fits_at_once(train.count()) if weights is None else 1)
    if predictions_path:
        SK.write_table(preds.select(S.ID, *LEARNERS), predictions_path)
    adjusted = FU.operation_prior(FU.blend(preds, chosen, "_blend"), "_blend", out=S.TARGET)
    return _submit(adjusted, sample, train, submission_path)


def _submit(preds: DataFrame, sample: DataFrame, train: DataFrame, path: str | None) -> DataFrame:
    fill = train.agg(F.avg(S.LABEL)).first()[0]      # missing ids are always filled
    sub = materialize(SU.build_submission(preds, sample, fill), "submission")
    SU.check_submission(sub, sample)
    if path:
        SK.write_submission(sub, path)
    return sub


def submission_check(sample: DataFrame):
    """The output contract (K12) of the staged table ``submission``."""
    return lambda staged: SU.submission_violations(staged["submission"], sample).first().asDict()


def publish_submission(spark: SparkSession, train: DataFrame, test: DataFrame, sample: DataFrame, root: str,
                       weights: dict | None = None, **kw) -> dict:
    """L3 as one release: submission, base predictions and validation report appear together after the contract
    holds, and no intermediate table stays behind.  Gives the manifest."""
    with scratch(spark):
        report = {"ensemble_weights": weights} if weights else validation_report(train)
        path = report_path(spark, "base_predictions")
        try:
            sub = train_final_and_submit(spark, train, test, sample, weights=report["ensemble_weights"], predictions_path=path, **kw)
            return PB.publish(spark, root, {"submission": sub, "predictions": spark.read.parquet(path)}, submission_check(sample), report)
        finally:
            fs, where = files_of(spark, path)
            fs.delete(where, True)


def two_stage(spark: SparkSession, train: DataFrame, test: DataFrame, sample: DataFrame,
              submission_path: str | None = None, report: str | None = None) -> tuple[DataFrame, dict]:
    """L4: global blend plus a specialist of the positive operation, fused by rank.

    Holdout: the learners' AP-optimal blend, the specialist on its operation's
    rows, AP of the blend and of the fused scores.  Then every model is refitted
    on all rows with its kept tree count and the test rows are scored.
    Out-of-fold encodings are used throughout (no leaked validation).
    Gives the submission and the report, both written where paths are given."""
    frames, cols = feature_frames(train, test=test)
    with MD.kept_vectors(frames["train"]) as (rows,):
        sub, out = _two_stage(rows, frames["test"], sample, train, submission_path)
    out["n_features"] = len(cols)
    if report:
        SK.write_report(spark, out, report)
    return sub, out


def _two_stage(rows: DataFrame, te: DataFrame, sample: DataFrame, train: DataFrame, submission_path: str | None) -> tuple[DataFrame, dict]:
    """:func:`two_stage` on assembled train rows, whose vectors are kept, and test rows."""
    tr, va = SP.temporal_split(rows)
    at_once = fits_at_once(rows.count())

    def only(df):
        return df.filter(F.col(S.OPERATION) == S.POSITIVE_OPERATION)

    def blended():
        scores, preds, models = _fitted_and_scored(tr, va)
        return scores, models, FU.best_weights(FU.search_weights(preds, list(LEARNERS)), list(LEARNERS))

    (scores, models, weights), specialist = together(
        [blended, lambda: MD.fit_learner(MD.SPECIALIST, SP.operation_filter(tr), only(va))], at_once)

    def fused(global_models, special, df):
        keep = [S.ID, S.OPERATION, *[c for c in (S.LABEL,) if c in df.columns]]
        x = FU.blend(scored(global_models, df), weights, "global")
        x = MD.predict(special, x, "specialist").select(   # other operations have no specialist score
            *keep, "global", F.when(F.col(S.OPERATION) == S.POSITIVE_OPERATION, F.col("specialist"))
            .otherwise(F.lit(0.0)).alias("specialist"))
        return FU.two_stage_scores(materialize(x, "two_stage"), "global", "specialist", out=S.TARGET)

    def held_ap():
        held = fused(models, specialist, va)
        return {r["model"]: float(r["ap"]) for r in ap_by_model(held, ("global", S.TARGET)).collect()}   # two rows

    ap, full, full_special = together([
        held_ap, lambda: refitted(models, rows),
        lambda: MD.refit_full(MD.SPECIALIST, "specialist", specialist, SP.operation_filter(rows))], at_once)
    sub = _submit(fused(full, full_special, te), sample, train, submission_path)
    trees = {n: MD.kept_iterations(m) for n, m in [*full.items(), ("specialist", full_special)]}
    out = {"val_ap_global": ap.get("global", 0.0), "val_ap_two_stage": ap.get(S.TARGET, 0.0), "val_scores": scores,
           "ensemble_weights": weights, "trees": trees}
    return sub, out


def pipeline_two_stage(spark: SparkSession, train: DataFrame, test: DataFrame, sample: DataFrame) -> DataFrame:
    """The :func:`two_stage` submission with the validated AP and weights beside every row."""
    sub, r = two_stage(spark, train, test, sample)
    return sub.select("*", F.lit(r["val_ap_global"]).alias("val_ap_global"),
                      F.lit(r["val_ap_two_stage"]).alias("val_ap_two_stage"),
                      *[F.lit(float(w)).alias(f"weight_{n}") for n, w in r["ensemble_weights"].items()])
