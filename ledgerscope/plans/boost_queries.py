"""Queries of the boosted learner (J1, J3, K2, K3): histograms, splits, staged scores, fitted models.

The frame is the transactions with some balances and operations missing, and an operation in the holdout that training never
saw.  The SQL side repeats the definition round by round: bins, integer gradients, cumulative sums, best split, margins.
"""
from __future__ import annotations

import json
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import stable_hash
from ..operators import boosting as BO
from ..operators import fusion as FU
from ..operators import metrics as M
from ..operators import search as SE
from ..operators import splits as SP
from ..session import fits_at_once, materialize, together
from ..sources import transactions as TX
from . import features as FT
from . import oracle as O

NUMERIC = [S.AMOUNT, S.OB_BEFORE, S.OB_AFTER, S.DB_BEFORE, S.DB_AFTER]
CATEGORICAL = [S.OPERATION]
SPEC = BO.BoostSpec(rounds=3, depth=1, rate=0.3, bins=8, min_rows=5, patience=3, block=3, exact_bins=True)
NEW_OPERATION = "op_99"


def frame(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Train and holdout rows with missing values and an unseen category."""
    tx = TX.load_train_test(spark, sf_dir)[0]
    i = F.col(S.ID)
    gone = lambda c, k: F.when(i % k != 0, F.col(c)).alias(c)
    new = (i % 13 == 0) & (F.col(S.PERIOD) >= S.VAL_PERIOD_CUTOFF)
    x = tx.select(S.ID, S.PERIOD, S.LABEL, S.AMOUNT, gone(S.OB_BEFORE, 7), S.OB_AFTER, gone(S.DB_BEFORE, 5), S.DB_AFTER,
                  F.when(new, NEW_OPERATION).when(i % 11 != 0, F.col(S.OPERATION)).alias(S.OPERATION))
    early = F.col(S.PERIOD) < S.VAL_PERIOD_CUTOFF
    return x.where(early), x.where(~early)


_FRAME = f"""fr AS (
  SELECT id, fraud_flag AS y, period < {S.VAL_PERIOD_CUTOFF} AS early, amount AS f0, CASE WHEN id % 7 <> 0 THEN origin_balance_before END AS f1,
    origin_balance_after AS f2, CASE WHEN id % 5 <> 0 THEN destination_balance_before END AS f3, destination_balance_after AS f4,
    CASE WHEN id % 13 = 0 AND period >= {S.VAL_PERIOD_CUTOFF} THEN '{NEW_OPERATION}' WHEN id % 11 <> 0 THEN operation END AS f5
  FROM train)"""


def _bins_cte(bins: int) -> str:
    steps = ", ".join(repr(k / bins) for k in range(1, bins))
    edges = ", ".join(f"coalesce(list_distinct(quantile_cont(f{k}, [{steps}])), []) AS e{k}" for k in range(len(NUMERIC)))
    rows = " UNION ALL ".join(
        f"SELECT id, y, early, {k} AS feature, CASE WHEN f{k} IS NULL THEN -1 ELSE len(list_filter(e{k}, lambda e: e < f{k})) END AS bin FROM fr, edges"
        for k in range(len(NUMERIC)))
    return f"""edges AS (SELECT {edges} FROM fr WHERE early),
known AS (SELECT f5, row_number() OVER (ORDER BY f5) - 1 AS code FROM (SELECT DISTINCT f5 FROM fr WHERE early AND f5 IS NOT NULL)),
cell AS ({rows} UNION ALL
  SELECT id, y, early, {len(NUMERIC)} AS feature, CASE WHEN fr.f5 IS NULL THEN -1 ELSE coalesce(code, -2) END AS bin FROM fr LEFT JOIN known ON known.f5 = fr.f5)"""


def _round_ctes(r: int, spec: BO.BoostSpec, gamma: float = 2.0, alpha: float = 0.25) -> str:
    """Gradients at the margins of round ``r - 1``, histogram, candidates and best split of round ``r``, and its margins ``m{r}``."""
    unit = f"{float(BO.UNIT)!r}::DOUBLE"
    real = lambda e: f"(CAST({e} AS DOUBLE) / {unit})"
    part = lambda g, h: f"({real(g)} * {real(g)} / ({real(h)} + {spec.l2!r}::DOUBLE))"
    side = "PARTITION BY feature"
    order = f"({side} ORDER BY absent, key, bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cat = f"feature >= {len(NUMERIC)}"
    sums = ", ".join(f"sum({c}) OVER ({side}) AS {c}_all, coalesce(sum({c}) FILTER (absent) OVER ({side}), 0) AS {c}_absent, sum({c}) OVER {order} AS {c}_upto"
                     for c in "ngh")
    lefts = ", ".join(f"{c}_upto + CASE WHEN missing_left THEN {c}_absent ELSE 0 END AS {c}_left" for c in "ngh")
    return f"""
g{r} AS (
  SELECT id, CAST(floor(grad * {unit} + 0.5) AS BIGINT) AS g, CAST(floor(greatest(hess, 1e-6) * {unit} + 0.5) AS BIGINT) AS h FROM (
    SELECT id, a_t * sg * pow(1.0 - p_t, {gamma!r}) * ({gamma!r} * p_t * lp + p_t - 1.0) AS grad,
      a_t * p_t * pow(1.0 - p_t, {gamma!r}) * ((1.0 - p_t) * ({gamma!r} * lp + {2 * gamma + 1!r}) - {gamma * gamma!r} * p_t * lp) AS hess FROM (
      SELECT *, ln(least(greatest(p_t, 1e-9::DOUBLE), 1.0)) AS lp FROM (
        SELECT id, CASE WHEN y = 1 THEN {alpha!r}::DOUBLE ELSE {1 - alpha!r}::DOUBLE END AS a_t, CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg,
          CASE WHEN y = 1 THEN 1.0 / (1.0 + exp(-margin)) ELSE 1.0::DOUBLE - 1.0::DOUBLE / (1.0 + exp(-margin)) END AS p_t FROM m{r - 1} WHERE early)))),
h{r} AS (SELECT feature, bin, count(*) AS n, sum(g) AS g, sum(h) AS h FROM cell JOIN g{r} USING (id) WHERE early GROUP BY feature, bin),
k{r} AS (SELECT *, CASE WHEN {cat} THEN {real('g')} / ({real('h')} + {spec.l2!r}::DOUBLE) ELSE bin::DOUBLE END AS key, NOT ({cat}) AND bin = -1 AS absent FROM h{r}),
c{r} AS (SELECT feature, bin, absent, {sums}, row_number() OVER ({side} ORDER BY absent, key, bin) AS place,
    CASE WHEN {cat} THEN list(bin) OVER {order} ELSE [bin] END AS lefts FROM k{r}),
d{r} AS (SELECT *, {lefts} FROM c{r}, (VALUES (true), (false)) v(missing_left) WHERE NOT absent AND NOT (missing_left AND {cat})),
s{r} AS (
  SELECT feature, place, missing_left, lefts, {real('g_left')} AS g_left, {real('g_all - g_left')} AS g_right, {real('h_left')} AS h_left, {real('h_all - h_left')} AS h_right,
    n_left, n_all - n_left AS n_right, ({part('g_left', 'h_left')} + {part('(g_all - g_left)', '(h_all - h_left)')}) - {part('g_all', 'h_all')} AS gain
  FROM d{r} WHERE least(n_left, n_all - n_left) >= {spec.min_rows} AND {real('h_left')} >= {spec.min_hess!r} AND {real('h_all - h_left')} >= {spec.min_hess!r}),
b{r} AS (SELECT * FROM s{r} QUALIFY row_number() OVER (ORDER BY gain DESC, feature, place, missing_left DESC) = 1),
m{r} AS (
  SELECT m.id, m.y, m.early, m.margin + CASE WHEN
      CASE WHEN b.feature >= {len(NUMERIC)} THEN list_contains(b.lefts, bin) WHEN bin = -1 THEN b.missing_left ELSE bin <= b.lefts[1] END
    THEN {-spec.rate!r}::DOUBLE * b.g_left / (b.h_left + {spec.l2!r}::DOUBLE) ELSE {-spec.rate!r}::DOUBLE * b.g_right / (b.h_right + {spec.l2!r}::DOUBLE) END AS margin
  FROM m{r - 1} m JOIN cell USING (id) JOIN b{r} b ON b.feature = cell.feature)"""


def _ctes(rounds: int) -> list:
    start = "m0 AS (SELECT id, y, early, (SELECT ln(sum(y) / (count(*) - sum(y))) FROM fr WHERE early) AS margin FROM fr)"
    return [_FRAME, _bins_cte(SPEC.bins), start, *[_round_ctes(r, SPEC) for r in range(1, rounds + 1)]]


def _first_histogram(spark, sf_dir) -> tuple[DataFrame, BO.Binner]:
    train, _ = frame(spark, sf_dir)
    binner = BO.fit_bins(train, NUMERIC, CATEGORICAL, SPEC.bins, exact=True)
    start = BO.start_margin(train)
    rows = materialize(binner.transform(train, [S.LABEL]).withColumn("margin", F.lit(start)), "binned")
    return BO.histogram(rows, BO.focal(), [], BO.Tree(binner.width), [0], binner.width, list(range(len(binner.names)))), binner


def boost_histogram(spark, sf_dir):
    """Rows and integer focal gradient and hessian sums per (feature, bin) at the root."""
    hist, _ = _first_histogram(spark, sf_dir)
    return hist.select("feature", "bin", "n", F.col("g").cast("long").alias("g"), F.col("h").cast("long").alias("h"))


BOOST_HISTOGRAM_SQL = O.with_tx("SELECT feature, CAST(bin AS INTEGER) AS bin, n, CAST(g AS BIGINT) AS g, CAST(h AS BIGINT) AS h FROM h1", *_ctes(1))


def boost_splits(spark, sf_dir):
    """The best split of each feature at the root, both directions for missing values, categories by gradient ratio."""
    hist, binner = _first_histogram(spark, sf_dir)
    best = BO.best_splits(BO.split_candidates(hist, len(NUMERIC), SPEC.l2, SPEC.min_rows, SPEC.min_hess), "node", "feature")
    return best.select("feature", "place", "missing_left", F.array_join(F.transform("lefts", lambda b: b.cast("string")), ",").alias("lefts"), "gain",
                       "g_left", "g_right", "h_left", "h_right", "n_left", "n_right")


BOOST_SPLITS_SQL = O.with_tx(
    "SELECT feature, CAST(place AS INTEGER) AS place, missing_left, array_to_string(lefts, ',') AS lefts, "
    + ", ".join(O.r6(c, c) for c in ("gain", "g_left", "g_right", "h_left", "h_right")) + ", CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right "
    "FROM s1 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, place, missing_left DESC) = 1", *_ctes(1))


def boost_stages(spark, sf_dir):
    """Average precision of the holdout after each round of focal stumps, and the rounds kept."""
    train, held = frame(spark, sf_dir)
    model = BO.fit_boosted(train, NUMERIC, CATEGORICAL, SPEC, held)
    return model.report(spark).select("round", "train_loss", "ap", "kept")


def _stages_sql() -> str:
    stages = " UNION ALL ".join(f"SELECT {r} AS round, * FROM m{r}" for r in range(1, SPEC.rounds + 1))
    loss = ("CASE WHEN y = 1 THEN -0.25 * pow(1.0 - p, 2.0) * ln(least(greatest(p, 1e-9), 1.0)) "
            "ELSE -0.75 * pow(1.0 - (1.0 - p), 2.0) * ln(least(greatest(1.0 - p, 1e-9), 1.0)) END")
    return O.with_tx(
        f"SELECT CAST(round AS INTEGER) AS round, {O.r6('train_loss', 'train_loss')}, {O.r6('ap', 'ap')}, "
        "round <= (SELECT min(round) FROM aps WHERE ap = (SELECT max(ap) FROM aps)) AS kept FROM aps JOIN losses USING (round)",
        *_ctes(SPEC.rounds), f"st AS ({stages})",
        f"losses AS (SELECT round, avg({loss}) AS train_loss FROM (SELECT *, 1.0::DOUBLE / (1.0 + exp(-margin)) AS p FROM st WHERE early) GROUP BY round)",
        "sg AS (SELECT round, margin, sum(y) AS tp, count(*) AS n FROM st WHERE NOT early GROUP BY round, margin)",
        """sc AS (SELECT round, tp, sum(tp) OVER (PARTITION BY round) AS p, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn
  FROM sg WINDOW w AS (PARTITION BY round ORDER BY margin DESC))""",
        "aps AS (SELECT round, coalesce(sum(CASE WHEN p > 0 THEN (tp / CAST(p AS DOUBLE)) * (ctp / CAST(cn AS DOUBLE)) END), 0.0) AS ap FROM sc GROUP BY round)")


BOOST_STAGES_SQL = _stages_sql()


# ------------------------------------------------ the learner on all features

FOCAL = BO.BoostSpec(rounds=8, depth=4, rate=0.3, patience=4, block=4, columns=0.7)
LOGISTIC = BO.BoostSpec(rounds=8, depth=4, rate=0.3, patience=4, block=4, columns=0.7, objective="logistic")


def fit_on_features(spark, sf_dir, spec: BO.BoostSpec) -> DataFrame:
    """Rounds of the learner on the 157 features of the temporal holdout: loss, average precision, kept or not.  Missing
    values and operations go in as they are."""
    tr, va = SP.temporal_split(TX.load_train_test(spark, sf_dir)[0])
    table = materialize(FT.build_feature_table(tr, valid=va, unsupervised_ref="train", iso=True), "features")
    numeric = [c for c in FT.feature_columns(table) if c not in CATEGORICAL]
    parts = {s: table.where(F.col(S.SPLIT) == s) for s in ("train", "valid")}
    return BO.fit_boosted(parts["train"], numeric, CATEGORICAL, spec, parts["valid"]).report(spark)


def fit_focal(spark, sf_dir):
    """Boosting on the focal loss, stopped by average precision."""
    return fit_on_features(spark, sf_dir, FOCAL)


def fit_ap_stopped(spark, sf_dir):
    """Boosting on the weighted log loss, stopped by average precision."""
    return fit_on_features(spark, sf_dir, LOGISTIC)


# ------------------------------------------------ search of its settings

SPACE = {"depth": [1, 2, 3, 4], "rate": [0.05, 0.1, 0.3, 0.6], "l2": [0.5, 1.0, 5.0], "min_rows": [5, 20, 80], "columns": [0.5, 0.7, 1.0]}


def hyperband_search(train: DataFrame, held: DataFrame, numeric: list, categorical: list, space: dict = SPACE, most: int = 4, eta: int = 2,
                     seed: int = S.RANDOM_STATE) -> tuple[list, list]:
    """Brackets of boosting rounds on the holdout's average precision; a trial goes on from the trees it has.  The trials share
    the bins and the binned rows; those of a rung run side by side."""
    binned = BO.bin_rows(train, numeric, categorical, BO.BoostSpec(bins=16))
    known = binned.prepare(held)

    def trial(settings, model, budget):
        spec = BO.BoostSpec(**settings, rounds=budget, bins=16, block=max(1, budget))
        model = BO.fit_boosted(train, numeric, categorical, spec, resume=model, binned=binned)
        return M.average_precision_value(BO.add_trees(known, model.trees, [S.LABEL]), "margin"), model

    def evaluate(trials, budget, states):
        return together([partial(trial, s, m, budget) for s, m in zip(trials, states)], fits_at_once(binned.n))

    return SE.hyperband(space, evaluate, most, eta, seed)


def hyperband(spark, sf_dir):
    """Brackets over the boosted learner's settings, new trials drawn by what good and bad ones have in common."""
    record, settings = hyperband_search(*frame(spark, sf_dir), NUMERIC, CATEGORICAL)
    rows = [(r.bracket, r.trial, r.rung, r.budget, r.score, r.kept, json.dumps(settings[r.trial], sort_keys=True)) for r in record]
    return spark.createDataFrame(rows, "bracket int, trial int, rung int, budget int, ap double, kept boolean, settings string")


# ------------------------------------------------ the same halving over blends, with rows as the budget

_BLENDS = FU.simplex_grid(["p_a", "p_b", "p_c"], 0.25)
_SHARES = SE.rungs_of(len(_BLENDS), 1, 9, 3)


def halving_blend(spark, sf_dir):
    """Successive halving of blend weights; the budget is ninths of the rows, by the hash of their id."""
    rows = TX.scored_rows(TX.load_transactions(spark, sf_dir)).where(F.col(S.PERIOD) < S.TEST_PERIOD_START)
    part = stable_hash(S.ID, S.RANDOM_STATE) % 9

    def evaluate(weights, budget, states):
        aps = FU._exact_aps(rows.where(part < budget), ["p_a", "p_b", "p_c"], S.LABEL, weights)
        # equal to the last digit only up to the order of summation: compared and kept at twelve digits
        return [(round(ap, 12), None) for ap in aps]

    record = SE.halving(_BLENDS, _SHARES, evaluate)
    return spark.createDataFrame([(r.trial, r.rung, r.budget, r.score, r.kept) for r in record], "trial int, rung int, budget int, ap double, kept boolean")


def _halving_sql() -> tuple:
    ctes = ["cand(trial, a, b, c) AS (VALUES " + ", ".join(f"({k}, {w[0]!r}::DOUBLE, {w[1]!r}::DOUBLE, {w[2]!r}::DOUBLE)" for k, w in enumerate(_BLENDS)) + ")",
            f"part AS (SELECT *, {O.md5_hash('id', S.RANDOM_STATE)} % 9 AS ninth FROM scored WHERE period < {S.TEST_PERIOD_START})"]
    for r, (budget, go_on) in enumerate(_SHARES):
        alive = "cand" if r == 0 else f"(SELECT c.* FROM cand c JOIN r{r - 1} k ON k.trial = c.trial AND k.kept)"
        ctes += [f"s{r} AS (SELECT trial, least(greatest(a * p_a + b * p_b + c * p_c, 0.0), 1.0) AS s, sum(fraud_flag) AS tp, count(*) AS n FROM part, {alive} WHERE ninth < {budget} GROUP BY 1, 2)",
                 f"c{r} AS (SELECT trial, tp, sum(tp) OVER (PARTITION BY trial) AS p, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM s{r} WINDOW w AS (PARTITION BY trial ORDER BY s DESC))",
                 f"a{r} AS (SELECT trial, round(coalesce(sum(CASE WHEN p > 0 THEN (tp / CAST(p AS DOUBLE)) * (ctp / CAST(cn AS DOUBLE)) END), 0.0), 12) AS ap FROM c{r} GROUP BY trial)",
                 f"r{r} AS (SELECT trial, {r} AS rung, {budget} AS budget, ap, row_number() OVER (ORDER BY ap DESC, trial) <= {go_on} AS kept FROM a{r})"]
    body = " UNION ALL ".join(f"SELECT CAST(trial AS INTEGER) AS trial, rung, budget, {O.r6('ap', 'ap')}, kept FROM r{r}" for r in range(len(_SHARES)))
    return body, ctes
