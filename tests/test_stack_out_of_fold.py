"""Stackers fitted on out-of-fold scores."""
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.plans import validation as VA


def scores(spark, first, n):
    """A third of the rows positive; ``good`` and ``fair`` know something of the label, ``noise`` nothing."""
    i = F.col("id") + first
    y = (F.xxhash64(i) % 3 == 0).cast("int")
    draw = lambda k: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(1000)) / 1000.0
    return spark.range(n).select(i.alias(S.ID), y.alias(S.TARGET), (0.6 * draw(1) + 0.4 * y).alias("good"), (0.8 * draw(2) + 0.2 * y).alias("fair"),
                                 draw(3).alias("noise"))


def test_stack_uses_all_base_scores(spark):
    oof, test = scores(spark, 0, 3000), scores(spark, 10_000, 1500)
    cols = ("good", "fair", "noise")
    stacked = VA.stack_scores(oof, test.drop(S.TARGET), cols)
    assert stacked.columns == [S.ID, "stack_logistic", "stack_gbt"]
    rows = stacked.join(test, S.ID).withColumnRenamed(S.TARGET, S.LABEL)
    found = {r["model"]: r["ap"] for r in VA.ap_by_model(rows, ["stack_logistic", "stack_gbt", *cols]).collect()}
    assert found["stack_logistic"] > found["good"] > found["fair"] > found["noise"]
    assert found["stack_gbt"] > found["fair"]
    n = stacked.agg(F.count("*"), F.countDistinct(S.ID), F.count_if(F.col("stack_logistic").between(0, 1) & F.col("stack_gbt").between(0, 1))).first()
    assert tuple(n) == (1500, 1500, 1500)
