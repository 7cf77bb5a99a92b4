"""Physical-plan properties: push-down, pruning, number of row exchanges."""
from pyspark.sql import functions as F

from conftest import SF001
from ledgerscope import schema as S
from ledgerscope.operators import aggregates as A
from ledgerscope.operators import causal as C
from ledgerscope.operators import splits as SP
from ledgerscope.session import materialize
from ledgerscope.sources import transactions as TX


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _stored(spark):
    # transactions as a user would keep them: a parquet table with a period column
    return materialize(TX.load_transactions(spark, SF001), "tx")


def test_temporal_split_is_pushed_to_the_scan(spark):
    tr, _ = SP.temporal_split(_stored(spark), 96)
    plan = _plan(tr.select(S.ID))
    assert "PushedFilters: [IsNotNull(period), LessThan(period,96)]" in plan


def test_aggregate_reads_only_needed_columns(spark):
    plan = _plan(A.origin_stats(_stored(spark)))
    scan = [l for l in plan.split("\n") if "FileScan parquet" in l][0]
    assert "ReadSchema: struct<period:int,amount:double,origin_account:bigint,destination_account:bigint>" in scan
    assert "HashAggregate" in plan and "partial_" in plan   # map-side combine before the exchange


def test_causal_features_cost_one_row_exchange_per_side(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(C.add_causal_features(_stored(spark), mode="plain"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    exchanges = [l for l in plan.split("\n") if "Exchange hashpartitioning" in l]
    assert len(exchanges) == 2
