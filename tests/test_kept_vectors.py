"""Vectors of assembled rows are made once for all passes of the fits, of the rows of one split only, and are not kept longer."""
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.operators import splits as SP
from ledgerscope.plans import catalog as C
from ledgerscope.plans import models as MD
from ledgerscope.plans import validation as VA

SMALL = {"gbt": dict(kind="gbt", maxIter=3, maxDepth=2, subsamplingRate=0.8, seed=1),
         "forest": dict(kind="rf", numTrees=3, maxDepth=2, subsamplingRate=0.8, seed=1),
         "gbt_deep": dict(kind="gbt", maxIter=2, maxDepth=3, seed=2)}
N = 240


def _table(spark, seen=None):
    """Feature rows of 200 train and 40 valid rows; ``seen`` counts how often a row's feature is computed."""
    rows = spark.createDataFrame([(i, "train" if i < 200 else "valid", int(i % 11 > 7), 90 + i // 40, f"op_0{1 + i % 3}", i % 5, i % 7, float(i % 11 + i % 3))
                                  for i in range(N)],
                                 f"{S.ID} long, {S.SPLIT} string, {S.LABEL} int, {S.PERIOD} int, {S.OPERATION} string, {S.ORIGIN} long, {S.DEST} long, x double")
    if seen is None:
        return rows

    def counted(x):
        seen.add(1)
        return x

    return rows.withColumn("x", F.udf(counted, "double").asNondeterministic()("x"))


def _assembled(spark, monkeypatch, table):
    monkeypatch.setattr(VA.FT, "build_feature_table", lambda *a, **k: table)
    monkeypatch.setattr(VA, "materialize", lambda df, name="table": df)   # the predictions are checked, not written
    frames, _ = VA.feature_frames(None, None)
    return frames


def test_all_learners_read_vectors_made_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    made = MD.Assembler(["x", S.OPERATION]).fit(_table(spark)).transform(_table(spark, seen))
    with MD.kept_vectors(made.filter(F.col(S.SPLIT) == "train"), made.filter(F.col(S.SPLIT) == "valid")) as (tr, va):
        assert tr.count() + va.count() == N
        first = seen.value
        for spec in SMALL.values():
            model = MD.fit_learner(spec, tr, va)
            assert MD.predict(model, va).count() == 40
        assert seen.value == first   # no pass of the fits made a vector again
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_score_fold_keeps_nothing_and_gives_the_same_models(spark, monkeypatch):
    monkeypatch.setattr(MD, "BASE_LEARNERS", SMALL)
    table = _table(spark).repartitionByRange(3, S.ID).localCheckpoint()
    made = MD.Assembler([S.PERIOD, S.OPERATION, "x"]).fit(table.filter(F.col(S.SPLIT) == "train")).transform(table)
    tr, va = made.filter(F.col(S.SPLIT) == "train"), made.filter(F.col(S.SPLIT) == "valid")
    _, preds, models = VA.score_fold(tr, va)
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    assert preds.count() == 40
    for name, spec in SMALL.items():
        plain = MD.fit_learner(spec, tr, va)
        assert [t.toDebugString.split("\n", 1)[1] for t in plain.trees] == [t.toDebugString.split("\n", 1)[1] for t in models[name].trees]   # but for their names


def test_kept_vectors_go_when_a_fit_fails(spark):
    made = MD.Assembler(["x"]).fit(_table(spark)).transform(_table(spark))
    try:
        with MD.kept_vectors(made) as (rows,):
            rows.count()
            raise KeyError("fit")
    except KeyError:
        pass
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_a_split_is_taken_before_its_vectors_are_made(spark, monkeypatch):
    frames = _assembled(spark, monkeypatch, _table(spark))
    assert {s: df.count() for s, df in frames.items()} == {"train": 200, "valid": 40, "test": 0}
    for df in frames.values():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # in a plan's text the operators of later steps come first: the filter has to stand below the vectors
        assert "Filter" in plan and plan.index("features") < plan.index("Filter")


def test_queries_fit_on_kept_vectors(spark, monkeypatch):
    kept = []
    real = MD.kept_vectors
    monkeypatch.setattr(MD, "kept_vectors", lambda *frames: kept.append(len(frames)) or real(*frames))
    monkeypatch.setattr(MD, "BASE_LEARNERS", SMALL)
    monkeypatch.setattr(MD, "SPECIALIST", SMALL["gbt"])
    monkeypatch.setattr(MD, "MIN_FULL_ITERS", {})
    table = _table(spark)
    frames = _assembled(spark, monkeypatch, table)
    monkeypatch.setattr(C, "_holdout_frames", lambda *a: (frames["train"], frames["valid"], ["x"]))
    monkeypatch.setattr(C, "_full_frames", lambda *a: (frames["train"], frames["valid"]))
    monkeypatch.setattr(SP, "operation_filter", lambda df, *a, **k: df.filter(F.col(S.OPERATION) == S.POSITIVE_OPERATION))
    monkeypatch.setattr(S, "VAL_PERIOD_CUTOFF", 93)
    for name, rows in (("fit_gbt", 40), ("fit_forest", 40), ("fit_gbt_deep", 40), ("predict", 40), ("refit_full", 40), ("fit_specialist", 13)):
        kept.clear()
        assert C.QUERIES[name](spark, "").count() in (rows, rows + 1), name
        assert kept, name
