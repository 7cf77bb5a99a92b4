"""Positions in hash order by cells of the hash, and what is built on them."""
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.functions.columns import stable_hash
from ledgerscope.operators import splits as SP
from ledgerscope.operators.ordered import hash_positions


def md5(value, seed=None):
    return int(hashlib.md5(f"{value}{'' if seed is None else f'#{seed}'}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("cell_rows", [1, 40, 10_000])
def test_positions_by_brute_force(spark, cell_rows):
    rows = [(n if n % 50 else None, None if n % 7 == 0 else "hot" if n % 7 < 6 else "cold") for n in range(1000)] + [(5, "hot"), (5, None)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(7).withColumn("h", stable_hash("k"))
    order = lambda r: (-1, -1) if r[0] is None else (md5(r[0]), r[0])
    for by in ((), ("g",)):
        got = [(r["k"], r["g"], r["pos"]) for r in hash_positions(df, "h", "k", by=by, cell_rows=cell_rows).collect()]
        assert len(got) == len(rows)
        for group in {r[1] for r in rows} if by else {0}:
            mine = sorted((r for r in got if not by or r[1] == group), key=lambda r: r[2])
            assert [r[2] for r in mine] == list(range(len(mine)))
            assert [order(r) for r in mine] == sorted(order(r) for r in rows if not by or r[1] == group)
    assert hash_positions(df.limit(0), "h", "k").count() == 0


def test_positions_need_no_sample_and_no_copy(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g")).withColumn("h", stable_hash("k"))
    plan = hash_positions(df, "h", "k", by=("g",), n=1000)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan


def test_subsample_is_the_first_rows_in_hash_order(spark):
    df = spark.range(3000).select(F.col("id").alias(S.ID))
    want = sorted(range(3000), key=lambda n: (md5(n, S.RANDOM_STATE), n))
    for n_max in (1, 300, 2999, 3000):
        assert sorted(r[0] for r in SP.row_subsample(df, n_max).collect()) == sorted(want[:n_max])


def test_rolling_summary_counts_rows_once(spark):
    rows = [(p, int(p % 3 == 0)) for p in range(1, 40) for _ in range(p)]
    df = spark.createDataFrame(rows, f"{S.PERIOD} int, {S.LABEL} int")
    for width in (None, 4):
        rule = {"require_nonempty": True} if width else {"min_valid_rows": 100, "min_train_pos": 20}
        whole = SP.fold_summary(SP.fold_table(df, (5, 20, 39, 60), width), **rule)
        counted = SP.rolling_summary(df, (5, 20, 39, 60), width, **rule)
        assert sorted(counted.collect()) == sorted(whole.collect()) and counted.columns == whole.columns
