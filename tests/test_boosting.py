"""The boosted learner: gradients, trees by brute force, missing values, unseen categories, stopping, partition independence."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.operators import boosting as BO
from ledgerscope.operators import metrics as M


@pytest.fixture(scope="module")
def frame(spark):
    draw, rows = random.Random(3), []
    for i in range(900):
        a = draw.choice([None, float("nan"), draw.gauss(0, 1), draw.gauss(0, 1), draw.gauss(0, 1), 1.0])
        b, c = draw.choice([None, draw.uniform(-5, 5)]), draw.choice(["x", "y", "z", None])
        strange = a is None or a != a or (a is not None and a > 0.7)
        y = int((strange and c != "x") or draw.random() < 0.05) if i % 50 else None
        rows.append((i, a, b, c, y))
    df = spark.createDataFrame(rows, f"id int, a double, b double, c string, {S.LABEL} int")
    return df.where("id < 600"), df.where("id >= 600").withColumn("c", F.when(F.col("id") % 9 == 0, "new").otherwise(F.col("c")))


@pytest.mark.parametrize("objective", [BO.focal(), BO.focal(1.5, 0.6), BO.logistic(7.0)])
def test_gradients_by_finite_differences(objective):
    x, y, e = np.linspace(-4, 4, 81).repeat(2), np.tile([0, 1], 81), 1e-4
    grad, hess, _ = objective(x, y)
    up, mid, down = (objective(x + d, y)[2] for d in (e, 0, -e))
    assert np.allclose(grad, (up - down) / (2 * e), atol=1e-6)
    second = (up - 2 * mid + down) / e ** 2
    assert np.allclose(hess[second > 1e-3], second[second > 1e-3], atol=1e-4)


def _cells(binner, rows):
    out = np.full((len(rows), 3), BO.MISSING)
    for i, r in enumerate(rows):
        for k, name in enumerate("ab"):
            if r[name] is not None and r[name] == r[name]:
                out[i, k] = sum(e < r[name] for e in binner.edges[k])
        if r["c"] is not None:
            out[i, 2] = binner.codes[0].get(r["c"], BO.UNSEEN)
    return out


def _best(cells, g, h, spec, rows):
    """Every cut of every feature, row by row: (gain, feature, goes-left cells)."""
    score = lambda some: g[some].sum() ** 2 / (h[some].sum() + spec.l2)
    found = []
    for f in range(3):
        seen = sorted(set(cells[rows, f]))
        if f < 2:
            lefts = [({b for b in seen if 0 <= b <= cut} | ({-1} if miss else set())) for cut in seen if cut >= 0 for miss in (True, False)]
        else:
            mine = lambda b: rows[cells[rows, f] == b]
            ordered = sorted(seen, key=lambda b: (g[mine(b)].sum() / (h[mine(b)].sum() + spec.l2), b))
            lefts = [set(ordered[:k]) for k in range(1, len(ordered) + 1)]
        for left in lefts:
            goes = np.isin(cells[rows, f], list(left))
            if min(goes.sum(), (~goes).sum()) >= spec.min_rows:
                found.append((score(rows[goes]) + score(rows[~goes]) - score(rows), f, goes))
    return max(found, key=lambda x: x[0], default=None)


def test_trees_by_brute_force(frame):
    train = frame[0].where(f"{S.LABEL} is not null")
    spec, objective = BO.BoostSpec(rounds=3, depth=2, rate=0.3, bins=6, min_rows=15, min_hess=0.0, block=2), BO.focal()
    model = BO.fit_boosted(frame[0], ["a", "b"], ["c"], spec)
    rows = train.collect()
    cells, y = _cells(model.binner, rows), np.array([r[S.LABEL] for r in rows])
    margin = np.full(len(rows), np.log(y.sum() / (len(y) - y.sum())))
    for _ in range(spec.rounds):
        g, h, _ = objective(margin, y)
        step = np.zeros(len(rows))
        nodes = [np.arange(len(rows))]
        for _ in range(spec.depth):
            below = []
            for some in nodes:
                step[some] = -spec.rate * g[some].sum() / (h[some].sum() + spec.l2)
                best = _best(cells, g, h, spec, some)
                if best and best[0] > 1e-9:
                    below += [some[best[2]], some[~best[2]]]
            nodes = below
        for some in nodes:
            step[some] = -spec.rate * g[some].sum() / (h[some].sum() + spec.l2)
        margin = margin + step
    got = {r["id"]: r["margin"] for r in model.margin(train, ["id"]).collect()}
    assert np.allclose([got[r["id"]] for r in rows], margin, atol=1e-5)


def test_loss_falls_and_trees_do_not_depend_on_partitions(frame):
    spec = BO.BoostSpec(rounds=6, depth=3, bins=8, block=3, min_rows=5)
    models = [BO.fit_boosted(df, ["a", "b"], ["c"], spec) for df in (frame[0].coalesce(1), frame[0].repartition(7))]
    losses = [x[1] for x in models[0].history]
    assert len(losses) == 6 and all(later < earlier for earlier, later in zip(losses, losses[1:]))
    for one, two in zip(*(m.trees for m in models)):
        assert one.feature == two.feature and one.value == two.value
        assert all((a is None and b is None) or (a == b).all() for a, b in zip(one.left, two.left))


def test_missing_values_have_a_side_and_unseen_categories_go_right(frame):
    model = BO.fit_boosted(frame[0], ["a"], ["c"], BO.BoostSpec(rounds=1, depth=1, bins=8, block=1, min_rows=5))
    tree = model.trees[0]
    assert tree.feature[0] == 0 and tree.left[0][BO.MISSING + 2] != tree.left[0][2]  # missing as the high ones, not as the low ones
    by_c = BO.fit_boosted(frame[0], [], ["c"], BO.BoostSpec(rounds=1, depth=1, bins=8, block=1, min_rows=5))
    x = by_c.margin(frame[1], ["id", "c"]).where("c = 'new'").select("margin").distinct().collect()
    assert [r["margin"] for r in x] == [by_c.start + by_c.trees[0].value[2]]


def test_kept_round_is_the_first_best_before_patience_ran_out():
    for seed in range(200):
        draw = random.Random(seed)
        scores, patience = [draw.choice([0.1, 0.2, 0.3, 0.4]) for _ in range(draw.randrange(1, 15))], draw.randrange(1, 5)
        seen = len(scores)
        for k in range(len(scores)):
            if k + 1 - (scores[:k + 1].index(max(scores[:k + 1])) + 1) >= patience:
                seen = k + 1
                break
        assert BO.kept_round(scores, patience)[0] == scores[:seen].index(max(scores[:seen])) + 1


def test_stopping_by_average_precision(frame, spark):
    spec = BO.BoostSpec(rounds=9, depth=2, rate=0.8, bins=8, block=2, patience=3, min_rows=5)
    held = frame[1].where(f"{S.LABEL} is not null")
    model = BO.fit_boosted(frame[0], ["a", "b"], ["c"], spec, frame[1])
    aps = []
    for k in range(1, len(model.history) + 1):
        full = BO.fit_boosted(frame[0], ["a", "b"], ["c"], BO.BoostSpec(**{**spec.__dict__, "rounds": k}))
        aps.append(M.average_precision_value(full.margin(held, [S.LABEL]), "margin"))
    assert np.allclose([x[2] for x in model.history], aps)
    assert len(model.trees) == BO.kept_round(aps, spec.patience)[0]
    report = model.report(spark).collect()
    assert [r["kept"] for r in report] == [k < len(model.trees) for k in range(len(report))]


def test_edges(frame, spark):
    empty = BO.fit_boosted(frame[0].where("false"), ["a"], ["c"], BO.BoostSpec(rounds=2))
    assert empty.trees == [] and {r["score"] for r in empty.predict(frame[1], ["id"]).collect()} == {0.5}
    one_class = BO.fit_boosted(frame[0].withColumn(S.LABEL, F.lit(0)), ["a"], ["c"], BO.BoostSpec(rounds=2, depth=2, block=1))
    assert one_class.predict(frame[1], ["id"]).where("score is null or isnan(score)").count() == 0
    nothing = frame[0].withColumn("a", F.lit(None).cast("double"))
    assert all(t.feature == [-1] for t in BO.fit_boosted(nothing, ["a"], [], BO.BoostSpec(rounds=2, block=2)).trees)
    many = spark.range(300).select(F.col("id").cast("string").alias("c"), F.lit(1).alias(S.LABEL))
    with pytest.raises(ValueError):
        BO.fit_bins(many, [], ["c"])


def test_quantiles_of_many_columns_are_merged_by_blocks(spark):
    columns = [f"c{k}" for k in range(2 * BO.SKETCHES + 1)]
    df = spark.range(200).select(*[((F.col("id") * (k + 1)) % 50).cast("double").alias(c) for k, c in enumerate(columns)])
    found = BO.fit_bins(df, columns, [], 4)
    want = [np.unique(df.agg(F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000)).first()[0]) for c in columns]
    assert all(np.array_equal(a, b) for a, b in zip(found.edges, want))


def test_bins_are_one_value_a_row(spark, frame):
    train, _ = frame
    binner = BO.fit_bins(train, ["a", "b"], ["c"], 4)
    rows = binner.transform(train, ["id"])
    assert dict(rows.dtypes)["bins"] == "binary"
    assert {len(r["bins"]) for r in rows.collect()} == {2 * 3}


def test_shared_bins_give_the_same_model(spark, frame):
    train, held = frame
    spec = BO.BoostSpec(rounds=3, depth=2, bins=8, min_rows=5, block=2)
    one = BO.fit_boosted(train, ["a", "b"], ["c"], spec, held)
    two = BO.fit_boosted(train, ["a", "b"], ["c"], spec, held, binned=BO.bin_rows(train, ["a", "b"], ["c"], spec))
    assert [t.value for t in one.trees] == [t.value for t in two.trees] and one.history == two.history
