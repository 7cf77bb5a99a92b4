"""What SQL can know of the models and pipelines: sets of ids and folds, sizes, class weights, ranges, contracts.

Scores of fitted models have no SQL form.  These queries run the same functions as the model queries and return what follows
from the given tables whatever the scores are; a model that lost rows, mixed folds, weighed classes wrongly, kept
more trees than allowed or left its range would differ from its statement.
"""
from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import anomaly as AN
from ..operators import balance as B
from ..operators import fusion as FU
from ..operators import metrics as M
from ..operators import splits as SP
from ..operators import submission as SU
from ..session import fits_at_once, materialize, together
from ..sources import transactions as TX
from . import features as FT
from . import models as MD
from . import validation as VA

ONE_CUTOFF, TWO_FOLDS = 87, 2   # the checks run fewer folds than the reports


def _ok(c: str) -> F.Column:
    return F.col(c).isNotNull() & (F.col(c) >= 0) & (F.col(c) <= 1)


# ------------------------------------------------------------ anomaly

def forest(spark, sf_dir) -> DataFrame:
    """Rows of each tree's root and of all its leaves, and nodes whose children do not add up or lie too deep."""
    model = AN.fit_isolation_forest(B.add_balance_features(TX.load_transactions(spark, sf_dir)))
    nodes = spark.createDataFrame(model.nodes)   # at most trees x (2 x 256 - 1) rows
    child = nodes.select("tree", F.col("node").alias("child"), F.col("size").alias("child_size"), F.col("depth").alias("child_depth"))
    inner = nodes.where(~F.col("is_leaf"))
    both = inner.join(child, (child["tree"] == inner["tree"]) & ((F.col("child") == F.col("left")) | (F.col("child") == F.col("right"))))
    bad = both.groupBy(inner["tree"], "node", "size", "depth").agg(F.sum("child_size").alias("s"), F.count(F.lit(1)).alias("n"), F.min("child_depth").alias("d"), F.max("child_depth").alias("e"))
    bad = bad.groupBy("tree").agg(F.count_if((F.col("s") != F.col("size")) | (F.col("n") != 2) | (F.col("d") != F.col("depth") + 1) | (F.col("e") != F.col("d")) | (F.col("e") > 8)).alias("bad_nodes"))
    per = nodes.groupBy("tree").agg(F.max(F.when(F.col("depth") == 0, F.col("size"))).cast("long").alias("root_rows"), F.sum(F.when(F.col("is_leaf"), F.col("size"))).cast("long").alias("leaf_rows"),
                                    (F.count(F.lit(1)) - 2 * F.count_if("is_leaf") + 1).alias("odd_nodes"))
    return per.join(bad, "tree", "left").select(F.col("tree").cast("long").alias("tree"), "root_rows", "leaf_rows", "odd_nodes", F.coalesce("bad_nodes", F.lit(0)).cast("long").alias("bad_nodes"))


FOREST_SQL = (f"SELECT tree, least({S.ISO_SAMPLES_PER_TREE}, n) AS root_rows, least({S.ISO_SAMPLES_PER_TREE}, n) AS leaf_rows, 0::BIGINT AS odd_nodes, 0::BIGINT AS bad_nodes "
              f"FROM range(0, {S.ISO_TREES}) r(tree), (SELECT count(*) AS n FROM tx)")


def scores(spark, sf_dir) -> DataFrame:
    """Every transaction with whether its anomaly score lies between -1 and 0."""
    frame = B.add_balance_features(TX.load_transactions(spark, sf_dir))
    s = F.col("iso_anomaly_score")
    return AN.add_isolation_score(frame, AN.fit_isolation_forest(frame)).select(S.ID, ((s > -1) & (s < 0)).alias("in_range"))


SCORES_SQL = "SELECT id, true AS in_range FROM tx"


# ------------------------------------------------------------ learners

def learners(spark, sf_dir) -> DataFrame:
    """Rows a learner was fitted on and scores, class weights, trees within their limit, probabilities in range."""
    train, test = TX.load_train_test(spark, sf_dir)
    frames, _ = VA.feature_frames(train, test=test)
    with MD.kept_vectors(frames["train"], frames["test"]) as (rows, unseen):
        return spark.createDataFrame(_learner_rows(rows, unseen), "learner string, train_rows long, positive_weight double, negative_weight double, scored long, in_range long, trees_ok boolean")


def _learner_rows(rows: DataFrame, test: DataFrame) -> list[tuple]:
    early, late = SP.temporal_split(rows)
    only = lambda df: df.filter(F.col(S.OPERATION) == S.POSITIVE_OPERATION)
    jobs = [(n, MD.BASE_LEARNERS[n], early, late) for n in VA.LEARNERS] + [("specialist", MD.SPECIALIST, SP.operation_filter(early), only(late))]

    def fitted(name, spec, tr, va):
        model = MD.fit_learner(spec, tr, va)
        found = [_learner_row(name, spec, model, tr, va)]
        if name == "gbt":
            full = MD.refit_full(spec, "gbt", model, rows)
            spec = dict(spec, maxIter=max(MD.kept_iterations(model), MD.MIN_FULL_ITERS["gbt"]))
            found.append(_learner_row("refit", spec, full, rows, test))
        return found

    return [row for found in together([partial(fitted, *job) for job in jobs], fits_at_once(early.count())) for row in found]


def _learner_row(name: str, spec: dict, model, train: DataFrame, scored: DataFrame) -> tuple:
    weighted = MD.with_class_weight(train, "balanced" if spec["kind"] == "rf" else "pos_ratio")
    w = {r[S.LABEL]: r["w"] for r in weighted.groupBy(S.LABEL).agg(F.max("weight").alias("w")).collect()}   # two rows
    seen = MD.predict(model, scored, "score").agg(F.count(F.lit(1)), F.count_if(_ok("score"))).first()
    return (name, train.count(), float(w[1]), float(w[0]), seen[0], seen[1], MD.kept_iterations(model) <= spec.get("maxIter", spec.get("numTrees")))


def _learners_sql() -> str:
    def row(name, tr, va, balanced=False, src="train"):
        n, p = f"(SELECT count(*) FROM train WHERE {tr})", f"(SELECT sum(fraud_flag) FROM train WHERE {tr})"
        pos = f"{n} / (2.0 * {p})" if balanced else f"({n} - {p}) / {p}::DOUBLE"
        neg = f"{n} / (2.0 * ({n} - {p}))" if balanced else "1.0"
        s = f"(SELECT count(*) FROM {src} WHERE {va})"
        return (f"SELECT '{name}' AS learner, {n} AS train_rows, floor(CAST({pos} AS DOUBLE) * 1000000.0 + 0.5) / 1000000.0 AS positive_weight, "
                f"floor(CAST({neg} AS DOUBLE) * 1000000.0 + 0.5) / 1000000.0 AS negative_weight, {s} AS scored, {s} AS in_range, true AS trees_ok")
    op = f"operation = '{S.POSITIVE_OPERATION}'"
    early, late = f"period < {S.VAL_PERIOD_CUTOFF}", f"period >= {S.VAL_PERIOD_CUTOFF}"
    return " UNION ALL ".join([row("gbt", early, late), row("forest", early, late, True), row("gbt_deep", early, late),
                               row("specialist", f"{early} AND {op}", f"{late} AND {op}"), row("refit", "true", "true", src="test")])


LEARNERS_SQL = _learners_sql()


# ------------------------------------------------------------ folds

def folds(spark, sf_dir) -> DataFrame:
    """Folds of the three cross validations with their sizes (null for the ensemble) and APs in range."""
    train = TX.load_train_test(spark, sf_dir)[0]
    rolling, group, both = together([
        lambda: VA.cv_rolling(spark, train, (ONE_CUTOFF,), 1, 1), lambda: VA.cv_group(spark, train, TWO_FOLDS),
        lambda: VA.cv_ensemble(spark, train, (ONE_CUTOFF,), schemes=("rolling",))], fits_at_once(train.count()))
    rolling = rolling.select(F.lit("rolling").alias("scheme"), F.col("cutoff").alias("fold"), F.lit("gbt").alias("model"), "train_rows", "valid_rows", "ap")
    group = group.select(F.lit("group").alias("scheme"), "fold", F.lit("gbt").alias("model"), "train_rows", "valid_rows", "ap")
    none = F.lit(None).cast("long")
    both = both.select(F.lit("ensemble").alias("scheme"), "fold", "model", none.alias("train_rows"), none.alias("valid_rows"), "ap")
    return rolling.unionByName(group).unionByName(both).select("scheme", "fold", "model", "train_rows", "valid_rows", _ok("ap").alias("in_range"))


def folds_sql() -> tuple:
    c = ONE_CUTOFF
    names = ", ".join(f"('{n}')" for n in (*VA.LEARNERS, "ensemble"))
    return (f"""SELECT 'rolling' AS scheme, {c} AS fold, 'gbt' AS model, (SELECT count(*) FROM train WHERE period < {c}) AS train_rows,
  (SELECT count(*) FROM train WHERE period >= {c}) AS valid_rows, true AS in_range
UNION ALL SELECT 'group', f, 'gbt', (SELECT count(*) FROM tx2 WHERE fold <> f), (SELECT count(*) FROM tx2 WHERE fold = f), true FROM (VALUES (0), (1)) v(f)
UNION ALL SELECT 'ensemble', {c}, m, NULL, NULL, true FROM (VALUES {names}) w(m)""",)


def oof(spark, sf_dir) -> DataFrame:
    """Every train row once with its fold and label; all three scores in range."""
    train, test = TX.load_train_test(spark, sf_dir)
    out = VA.oof_scores(spark, train, test, TWO_FOLDS)
    good = F.lit(True)
    for n in VA.LEARNERS:
        good &= _ok(n)
    return out.select(S.ID, "fold", S.TARGET, good.alias("in_range"))


OOF_SQL = "SELECT id, fold, fraud_flag AS target, true AS in_range FROM tx2"


def scored_report(spark, sf_dir) -> DataFrame:
    """AP of the fixture's first score over rolling folds."""
    tx = TX.load_train_test(spark, sf_dir)[0]
    rows = SP.fold_table(TX.scored_rows(tx)).where("role = 'valid'")
    return M.average_precision(rows, "p_a", S.LABEL, ["cutoff"])


def manifest(spark, sf_dir) -> DataFrame:
    """Fingerprints of both tables, the seed, and the summary of a report."""
    train, test = TX.load_train_test(spark, sf_dir)
    report = scored_report(spark, sf_dir)
    return VA.baseline_manifest(spark, train, test, report, report.where("cutoff > 80"))


# ------------------------------------------------------------ scores and submissions

def ranges(model_scores: dict) -> DataFrame:
    """``model, rows, ids, in_range`` of tables of ``id, score``."""
    parts = [df.select(F.lit(name).alias("model"), S.ID, F.col(df.columns[1]).alias("_s")) for name, df in model_scores.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(S.ID).alias("ids"), F.count_if(_ok("_s")).alias("in_range"))


def submissions(spark, sf_dir) -> DataFrame:
    """L3/L4: violations of the output contract by both pipelines, and ids without a prediction that hold the label mean."""
    train, test = TX.load_train_test(spark, sf_dir)
    sample = TX.sample_ids(test)
    fill = train.agg(F.avg(S.LABEL)).first()[0]
    one, (two, report) = together([
        lambda: VA.train_final_and_submit(spark, train, test, sample, weights=dict.fromkeys(VA.LEARNERS, 1 / 3), iso=False),
        lambda: VA.two_stage(spark, train, test, sample)], fits_at_once(train.count()))
    parts = []
    for name, sub, ok in (("submit", one, True), ("two_stage", two, abs(sum(report["ensemble_weights"].values()) - 1) < 1e-9 and 0 <= report["val_ap_two_stage"] <= 1)):
        absent = sub.join(test.select(S.ID), S.ID, "left_anti").agg(F.count_if(F.abs(F.col(S.TARGET) - F.lit(fill)) < 1e-12).alias("filled"))
        parts.append(SU.submission_violations(sub, sample).crossJoin(F.broadcast(absent)).select(F.lit(name).alias("pipeline"), "*", F.lit(ok).alias("report_ok")))   # one row each
    return parts[0].unionByName(parts[1])


SUBMISSIONS_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS pipeline, 0::BIGINT AS row_count_diff, 0 AS column_mismatch, 0::BIGINT AS duplicate_ids, 0::BIGINT AS out_of_range, 0::BIGINT AS missing_ids, 0::BIGINT AS extra_ids, "
    "(SELECT count(*) FROM smp WHERE id NOT IN (SELECT id FROM test)) AS filled, true AS report_ok" for n in ("submit", "two_stage"))


def prepared(spark, sf_dir) -> DataFrame:
    """L2: the prepared rows: split, raw values, the number of features, and the anomaly score in its range."""
    train, test = TX.load_train_test(spark, sf_dir)
    table = materialize(FT.build_feature_table(train, test, iso=True), "features")
    s = F.col("iso_anomaly_score")
    return table.select(S.ID, S.SPLIT, S.LABEL, S.PERIOD, S.OPERATION, S.AMOUNT, F.lit(len(FT.feature_columns(table))).alias("n_features"), ((s > -1) & (s < 0)).alias("in_range"))


PREPARED_SQL = ("SELECT id, CASE WHEN period < 106 THEN 'train' ELSE 'test' END AS split, CASE WHEN period < 106 THEN fraud_flag END AS fraud_flag, period, operation, "
                "{amount}, 157 AS n_features, true AS in_range FROM tx")


def validated(spark, sf_dir) -> DataFrame:
    """Checks and models of the validation, APs in range, and the sum of the blend weights."""
    r = VA.validate_models(spark, TX.load_train_test(spark, sf_dir)[0])
    total = r.agg(F.sum("weight")).first()[0]
    model = F.when(F.col("model").startswith("ensemble:"), "ensemble").otherwise(F.col("model"))
    return r.select("check", model.alias("model"), _ok("ap").alias("in_range"), F.lit(total).alias("weights"))


VALIDATED_SQL = ("SELECT * FROM (VALUES " + ", ".join(f"('temporal', '{n}')" for n in (*VA.LEARNERS, "ensemble")) + ", ('group', 'gbt')) v(\"check\", model), "
                 "(SELECT true AS in_range, 1.0::DOUBLE AS weights)")


def blends(spark, sf_dir) -> dict:
    """Scored rows of the stacking and starter models, for :func:`ranges`."""
    sc = TX.scored_rows(TX.load_transactions(spark, sf_dir))
    tr, te = sc.filter(F.col(S.PERIOD) < S.TEST_PERIOD_START), sc.filter(F.col(S.PERIOD) >= S.TEST_PERIOD_START)
    cols = ["p_a", "p_b", "p_c"]
    return {"stack_logistic": MD.predict_stack_logistic(MD.fit_stack_logistic(tr, cols), te, cols).select(S.ID, "stack"),
            "stack_gbt": MD.predict_stack_gbt(MD.fit_stack_gbt(tr, cols), te, cols).select(S.ID, "stack"),
            "blend": FU.blend(te, dict.fromkeys(cols, 1 / 3)).select(S.ID, "blend")}
