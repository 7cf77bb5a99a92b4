"""Folds of the same rows share one feature build, and each fold's features are those of a build of its own."""
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import tx_frame
from ledgerscope import schema as S
from ledgerscope.operators import splits as SP
from ledgerscope.plans import features as FT
from ledgerscope.plans import validation as VA
from ledgerscope.session import fits_at_once


@pytest.fixture(scope="module")
def train(spark):
    """300 rows; some lack an account, an amount or an operation."""
    draw, rows = random.Random(5), []
    maybe = lambda v, p=0.05: None if draw.random() < p else v
    for i in range(300):
        money = lambda: float(draw.randrange(100, 90_000)) / 100
        rows.append((i, 70 + i % 40, maybe(f"op_0{draw.randrange(1, 6)}"), maybe(money()), maybe(draw.randrange(12)), money(), money(),
                     maybe(draw.randrange(100, 109)), money(), money(), int(draw.random() < 0.2)))
    return tx_frame(spark, rows).localCheckpoint()


def _same(own, shared):
    assert own.columns == shared.columns
    a, b = ({r[S.ID]: r for r in df.collect()} for df in (own, shared))
    assert a.keys() == b.keys()
    for key, row in a.items():
        for c, x, y in zip(own.columns, row, b[key]):
            near = isinstance(x, float) and isinstance(y, float) and (math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) or x != x and y != y)
            assert x == y or near, (key, c, x, y)


def test_a_shared_fold_equals_its_own_table(train):
    test = train.filter(F.col(S.PERIOD) >= 100).drop(S.LABEL)
    known = train.filter(F.col(S.PERIOD) < 100)
    shared = VA.shared_by_folds(known, test, 3)
    shared.frames(1)
    parts = list(VA.group_parts(known, 3))
    _same(FT.build_feature_table(parts[1][1], test, valid=parts[1][2], iso=True), FT.fold_table(shared._table, "__1"))
    _same(FT.build_feature_table(known, test, iso=True), FT.fold_table(shared._table, "__whole"))


@pytest.mark.parametrize("blocks, width", [((), 5), (("graph", "profile", "rolling"), None)])
def test_a_shared_fold_with_train_statistics_equals_its_own_table(train, blocks, width):
    shared = VA.SharedFeatures(train, {c: VA.split_at(c, width) for c in (80, 95)}, iso=False, unsupervised_ref="train", blocks=blocks)
    shared.frames(80)
    rows = [train.filter(VA.split_at(80, width) == s) for s in ("train", "valid")]
    _same(FT.build_feature_table(rows[0], valid=rows[1], unsupervised_ref="train", blocks=blocks), FT.fold_table(shared._table, "__80"))


def test_folds_are_built_once(train, monkeypatch):
    built = []
    real = FT.build_fold_features
    monkeypatch.setattr(FT, "build_fold_features", lambda *a, **kw: built.append(1) or real(*a, **kw))
    monkeypatch.setattr(FT, "build_feature_table", None)   # no table of a single fold
    monkeypatch.setattr(VA, "score_fold", lambda tr, va, **kw: ({"gbt": va.count() / 1000}, va, {}))
    spark = train.sparkSession
    rolling = VA.cv_rolling(spark, train, (80, 90, 200), 1, 1).collect()
    assert [(r["cutoff"], r["train_rows"] + r["valid_rows"]) for r in rolling] == [(80, 300), (90, 300)] and len(built) == 1
    group = VA.cv_group(spark, train, 3).collect()
    assert sum(r["valid_rows"] for r in group) == 300 and len(built) == 2
    sizes = {f: va.count() for f, _, va in VA.group_parts(train, 3)}
    assert {r["fold"]: r["valid_rows"] for r in group} == sizes == {r["fold"]: round(r["ap"] * 1000) for r in group}


def test_two_fits_of_some_million_rows_run_side_by_side():
    assert [fits_at_once(n) for n in (4_400_000, 6_000_000, 6_000_001)] == [2, 2, 1]


def test_group_roles_are_the_group_split(train):
    tr, va = SP.group_split(train)
    found = {r["role"]: r["count"] for r in SP.group_roles(train).groupBy("role").count().collect()}
    assert found == {"train": tr.count(), "valid": va.count()}
