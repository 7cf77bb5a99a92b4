"""Releases: all or nothing, the same content the same name, no table left behind."""
import os

import pytest

from ledgerscope import schema as S
from ledgerscope.plans import catalog
from ledgerscope.plans import validation as VA
from ledgerscope.session import ensure_checkpoint_dir, materialize, scratch
from ledgerscope.sources import publish as PB
from ledgerscope.sources import transactions as TX
from tests.conftest import SF001


@pytest.fixture
def parts(spark):
    sub, sample = catalog._submission(spark, SF001)
    return {"submission": sub, "scores": catalog._test_scored(spark, SF001).select(S.ID, "p_a")}, VA.submission_check(sample)


def _plain(root):
    return sorted(x for x in os.listdir(root) if not x.startswith(".")) if os.path.isdir(root) else []


def test_a_release_appears_whole_and_repeats_alike(spark, parts, tmp_path):
    root = str(tmp_path / "out")
    assert PB.current(spark, root) is None
    one = PB.publish(spark, root, *parts, {"note": 1})
    assert _plain(root) == sorted([PB.POINTER, one["release"]]) and PB.current(spark, root) == one
    again = PB.publish(spark, root, {k: df.repartition(3) for k, df in parts[0].items()}, parts[1], {"note": 1})
    assert again == one and _plain(root) == sorted([PB.POINTER, one["release"]])
    assert sorted(map(tuple, PB.read(spark, root, "submission").collect())) == sorted(map(tuple, parts[0]["submission"].collect()))
    other = PB.publish(spark, root, {"submission": parts[0]["submission"]}, parts[1])
    assert other["release"] != one["release"] and PB.current(spark, root) == other
    with pytest.raises(FileNotFoundError):
        PB.read(spark, root, "scores")


def test_a_failed_check_leaves_nothing_visible(spark, parts, tmp_path):
    root = str(tmp_path / "out")
    tables, check = parts
    broken = {"submission": tables["submission"].limit(5)}
    with pytest.raises(PB.PublishError):
        PB.publish(spark, root, broken, check)
    assert _plain(root) == [] and PB.current(spark, root) is None
    one = PB.publish(spark, root, tables, check)
    with pytest.raises(PB.PublishError):
        PB.publish(spark, root, broken, check)
    with pytest.raises(Exception):
        PB.publish(spark, root, {"submission": tables["submission"].selectExpr("raise_error('lost')")})
    assert PB.current(spark, root) == one and _plain(root) == sorted([PB.POINTER, one["release"]])


def test_scratch_tables_go_with_their_scope(spark):
    folder = f"{ensure_checkpoint_dir(spark).replace('file:', '').rstrip('/')}/tables"
    with scratch(spark) as outer:
        kept = materialize(spark.range(3), "outer")
        with pytest.raises(RuntimeError):
            with scratch(spark) as inner:
                materialize(spark.range(4), "inner")
                assert len(inner) == 1 and any(x.startswith("inner") for x in os.listdir(folder))
                raise RuntimeError
        assert not any(x.startswith("inner") for x in os.listdir(folder)) and kept.count() == 3
    assert len(outer) == 1 and not any(x.startswith("outer") for x in os.listdir(folder))
    assert materialize(spark.range(2), "free").count() == 2


def test_the_submission_pipeline_publishes(spark, tmp_path, monkeypatch):
    train, test = TX.load_train_test(spark, SF001)
    sub, _ = catalog._submission(spark, SF001)
    seen = []

    def fast(spark, train, test, sample, weights, predictions_path):  # the training itself is tested elsewhere
        seen.append(materialize(test.select(S.ID), "step").count())
        test.selectExpr("id", "0.5 as gbt").write.parquet(predictions_path)
        return sub
    monkeypatch.setattr(VA, "train_final_and_submit", fast)
    folder = f"{ensure_checkpoint_dir(spark).replace('file:', '').rstrip('/')}/tables"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    weights = {"gbt": 1.0}
    manifests = [VA.publish_submission(spark, train, test, TX.sample_ids(test), str(tmp_path / "r"), weights) for _ in range(2)]
    assert manifests[0] == manifests[1] and manifests[0]["reports"] == {"ensemble_weights": weights} and len(seen) == 2
    assert set(os.listdir(folder)) == before
