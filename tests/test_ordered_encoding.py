"""Ordered target statistics: a loop over the permutation, and a hot category cut into chunks."""
import random

import pytest

from ledgerscope import schema as S
from ledgerscope.functions.columns import stable_hash
from ledgerscope.operators import encoding as EN


def _frame(spark, hot):
    draw = random.Random(2)
    rows = [(i, "hot" if draw.random() < hot else draw.choice(["a", "b", None]), draw.choice([0, 0, 1, None])) for i in range(600)]
    return spark.createDataFrame(rows, f"{S.ID} long, c string, {S.LABEL} int")


@pytest.mark.parametrize("max_rows", [10_000, 60, 7])
def test_ordered_rates_by_loop(spark, max_rows):
    df = _frame(spark, 0.6)
    hashed = {r[0]: r[1] for r in df.select(S.ID, stable_hash(S.ID, S.RANDOM_STATE)).collect()}
    rows = sorted(df.collect(), key=lambda r: (hashed[r[S.ID]], r[S.ID]))
    known = [r[S.LABEL] for r in rows if r[S.LABEL] is not None]
    prior, seen, want = sum(known) / len(known), {}, {}
    for r in rows:
        s, n = seen.get(r["c"], (0, 0))
        want[r[S.ID]] = (s + prior) / (n + 1)
        if r[S.LABEL] is not None:
            seen[r["c"]] = (s + r[S.LABEL], n + 1)
    got = EN.ordered_target_statistics(df, ["c"], max_rows=max_rows).collect()
    assert len(got) == 600 and {r[S.ID]: r["c_ordered_rate"] for r in got} == pytest.approx(want, abs=1e-12)


def test_a_hot_category_is_spread(spark):
    df = _frame(spark, 1.0)
    plan = EN.ordered_target_statistics(df, ["c"], max_rows=50)
    assert plan.count() == 600
    from pyspark.sql import functions as F
    x = df.withColumn("p", F.floor(stable_hash(S.ID, S.RANDOM_STATE) * 12 / F.lit(float(1 << 32))))
    assert max(r["count"] for r in x.groupBy("c", "p").count().collect()) < 90


def test_empty(spark):
    assert EN.ordered_target_statistics(_frame(spark, 0.5).where("false"), ["c"]).count() == 0
