"""Independent folds, learners and tables run side by side; the forest reads its rows once."""
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from ledgerscope import schema as S
from ledgerscope.operators import anomaly as AN
from ledgerscope.plans import features as FT
from ledgerscope.plans import validation as VA
from ledgerscope.session import fits_at_once, materialize, scratch, together
from ledgerscope.sources import transactions as TX


def test_results_keep_their_order_and_run_at_once(spark):
    both = threading.Barrier(2, timeout=30)

    def task(k):
        both.wait()
        return k, spark.range(k).count()

    assert together([lambda k=k: task(k) for k in range(4)], 2) == [(k, k) for k in range(4)]


def test_a_failure_is_raised_and_scratch_tables_are_owned(spark):
    def fails():
        raise ValueError("no rows")

    with pytest.raises(ValueError, match="no rows"):
        together([fails, lambda: 1, fails])
    with scratch(spark) as owned:
        together([lambda k=k: materialize(spark.range(k), "t") for k in range(3)])
        assert len(owned) == 3


def test_fits_at_once_follow_the_rows():
    assert [fits_at_once(n) for n in (0, 600_000, 2_000_000, 36_000_000)] == [5, 5, 3, 1]


def test_folds_run_side_by_side(spark, monkeypatch):
    train = TX.load_train_test(spark, SF001)[0]
    two = threading.Barrier(2, timeout=60)

    def fold(tr, va, **kw):
        two.wait()   # passes only while another fold is under way
        return tr, va, []

    monkeypatch.setattr(VA, "fold_frames", fold)
    monkeypatch.setattr(VA, "score_fold", lambda tr, va, **kw: ({"gbt": 0.5}, va, {}))
    rows = VA.cv_group(spark, train, 2).collect()
    assert [r["fold"] for r in rows] == [0, 1]
    assert sum(r["valid_rows"] for r in rows) == train.count()


def test_feature_steps_run_side_by_side(spark, monkeypatch):
    train, test = TX.load_train_test(spark, SF001)
    two = threading.Barrier(2, timeout=60)
    quartiles = FT.exact_quantiles

    def waits(*a, **kw):
        two.wait()   # the quartiles of both sides
        return quartiles(*a, **kw)

    monkeypatch.setattr(FT, "exact_quantiles", waits)
    assert FT.build_feature_table(train, test).count() == train.count() + test.count()


def test_forest_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(i):
        read.add(1)
        return i

    key = F.udf(seen, "long").asNondeterministic()
    rows = spark.range(2000).select(key("id").alias(S.ID), *[(F.col("id") * (k + 3) % 101).cast("double").alias(f"x{k}") for k in range(3)])
    model = AN.fit_isolation_forest(rows, features=("x0", "x1", "x2"), n_trees=10)
    assert model.nodes.query("depth == 0")["size"].tolist() == [256] * 10
    assert read.value <= 2 * 2000   # counted and dealt; before, the candidates were made three times


def test_scores_equal_a_walk_of_every_row():
    rng = np.random.default_rng(7)
    rows = []
    for t in range(5):
        rows += [(t, *r) for r in AN._build_tree(t, rng.normal(size=(64, 3)), 6, 42)]
    nodes = pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth", "is_leaf"])
    model = AN.IsolationForestModel(["a", "b", "c"], nodes, 64)
    x = np.vstack([rng.normal(size=(50, 3)), [[np.inf, -np.inf, 0.0], [np.nan, np.nan, np.nan]]])
    want = []
    for row in x:
        total = 0.0
        for feature, threshold, left, right, _, leaf_len in model.arrays():
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] < threshold[at] else right[at]
            total += leaf_len[at]
        want.append(total)
    want = -np.power(2.0, -np.array(want) / 5 / AN.average_path_length(np.array([64.0]))[0])
    assert np.array_equal(AN.score_arrays(model.arrays(), 64, x), want)
