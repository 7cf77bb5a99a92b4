"""Rows without an account: encodings, folds, and the plan of the causal windows."""
import pytest
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.operators import causal as C
from ledgerscope.operators import encoding as EN
from ledgerscope.operators import splits as SP
from ledgerscope.plans import catalog
from ledgerscope.plans import features as FT
from ledgerscope.plans import validation as VA
from tests.conftest import SF001


@pytest.fixture(scope="module")
def frames(spark):
    return catalog._lacking_accounts(spark, SF001)


def test_every_row_is_in_one_fold(frames):
    train, _ = frames
    for parts in (VA.group_parts(train),):
        ids = [r[0] for _, _, va in parts for r in va.select(S.ID).collect()]
        assert sorted(ids) == sorted(r[0] for r in train.select(S.ID).collect())
    x = SP.with_folds(train, SP.stratified_group_folds(train), S.ORIGIN)
    assert x.columns == [*train.columns, "fold"] and x.where("fold is null or fold not between 0 and 4").count() == 0


def test_feature_table_encodes_like_the_operator(frames):
    train, test = frames
    table = FT.build_feature_table(train, test, blocks=())
    names = EN.encoded_names()
    full = {r[0]: r[1:] for r in EN.apply_target_encoding(test, *EN.fit_target_encoding(train)).select(S.ID, *names).collect()}
    oof = {r[0]: r[1:] for r in EN.oof_target_encoding(train, SP.stratified_group_folds(train), S.ORIGIN).select(S.ID, *names).collect()}
    for r in table.select(S.ID, S.SPLIT, *names).collect():
        assert r[2:] == pytest.approx((oof if r[1] == "train" else full)[r[0]], abs=1e-12)


def test_many_rows_without_account_take_the_chunked_plan(frames, monkeypatch):
    train, test = frames
    most = max(df.groupBy(c).count().where(f"{c} is not null").agg(F.max("count")).first()[0] for df in (train.drop(S.LABEL).union(test),) for c in (S.ORIGIN, S.DEST))
    limit = most + 1  # no account reaches it, the rows without one do
    assert max(train.drop(S.LABEL).union(test).where(f"{c} is null").count() for c in (S.ORIGIN, S.DEST)) > limit
    modes, add = [], C.add_causal_features
    monkeypatch.setattr(C, "add_causal_features", lambda *a, **kw: modes.append(kw["mode"]) or add(*a, **kw))
    kw = dict(causal_kw={"max_rows_per_task": limit, "block_rows": 40})
    auto = FT.build_feature_table(train, test, **kw)
    assert modes == ["chunked", "chunked"]
    plain = FT.build_feature_table(train, test, causal_mode="plain", **kw)
    one, two = ({r[S.ID]: r.asDict() for r in t.collect()} for t in (auto, plain))
    assert one.keys() == two.keys()
    for i, r in one.items():
        for c, v in r.items():
            assert v == two[i][c] or v == pytest.approx(two[i][c], rel=1e-9, abs=1e-9), (i, c)


def test_rows_without_account_are_cut_within_a_period(spark):
    rows = [(i, i // 400, "op_01", float(i % 17), None, 0.0, 0.0, 7, 0.0, 0.0, 0) for i in range(800)]
    from tests.conftest import tx_frame
    df = tx_frame(spark, rows)
    bounds = C._hot_group_bounds(df, S.ORIGIN, 50)
    assert bounds.count() == 2 and all(len(r["_bounds"]) >= 3 for r in bounds.collect())
    one, two = (sorted(map(tuple, C.add_causal_features(df, sides=("origin",), mode=m, max_rows_per_task=50, block_rows=40).collect())) for m in ("plain", "chunked"))
    assert [tuple(map(str, a)) for a in one] == [tuple(map(str, b)) for b in two]


def test_rows_without_account_do_not_meet_in_one_task(spark):
    rows = spark.range(4000).selectExpr("id", f"if(id % 2 = 0, null, id % 50) {S.ORIGIN}", f"if(id % 4 < 2, null, 3L) {S.DEST}")
    table = spark.range(50).selectExpr(f"id {S.ORIGIN}", f"3L {S.DEST}", "id * 10 pair_count")
    by_size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = FT._join_dealt(rows, table, [S.ORIGIN, S.DEST]).select("*", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", by_size)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(out) == 4000
    assert all(r["pair_count"] == (None if r[S.ORIGIN] is None or r[S.DEST] is None else 10 * r[S.ORIGIN]) for r in out)
    lone = [r["p"] for r in out if r[S.ORIGIN] is None and r[S.DEST] is None]
    assert max(lone.count(p) for p in set(lone)) < 0.5 * len(lone)


def test_the_chunked_plan_reads_wide_rows_once_and_counts_elsewhere(spark, frames):
    rows = frames[0].withColumn("wide", F.expr("uuid()"))
    plan = C.add_causal_features(rows, sides=("origin",), mode="chunked", max_rows_per_task=40, block_rows=30, counted=frames[0])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("uuid(") == 1
    assert C.DEFAULT_MAX_ROWS_PER_TASK <= 1_000_000 and C.DEFAULT_BLOCK_ROWS <= 500_000
