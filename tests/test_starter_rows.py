"""The starter's rows are computed once for all the passes that need them."""
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.plans import models as MD


def test_starter_computes_its_rows_once(spark):
    n, seen = 120, spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(i, f"op_0{i % 3}", None if i % 7 == 0 else float(i % 11), int(i % 11 > 7)) for i in range(n)],
                                 f"{S.ID} long, {S.OPERATION} string, x double, {S.LABEL} int")
    train = rows.withColumn("x", F.udf(counted, "double").asNondeterministic()("x"))
    model, medians = MD.fit_starter(train, ["x"], [S.OPERATION], dict(MD.STARTER, maxIter=2, maxDepth=2))
    assert seen.value == n
    assert medians == {"x": rows.agg(F.percentile("x", F.lit(0.5))).first()[0]}
    ap = MD.predict(model, rows.fillna(medians), "p").groupBy(S.LABEL).agg(F.avg("p").alias("p")).orderBy(S.LABEL).collect()
    assert ap[0]["p"] < ap[1]["p"]


def test_starter_rows_are_dealt_over_the_cores(spark, monkeypatch):
    from ledgerscope.plans import models as MD
    from ledgerscope.session import materialize
    cores = spark.sparkContext.defaultParallelism
    rows = materialize(spark.range(400).selectExpr("id", "id % 7 as x").coalesce(1), "rows")
    assert MD.spread(rows).rdd.getNumPartitions() == 1   # few rows stay as they are
    monkeypatch.setattr(MD, "SPREAD_ROWS", 100)
    dealt = MD.spread(rows)
    sizes = dealt.rdd.glom().map(len).collect()
    assert sizes == [400 // cores] * cores
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.collect()))
    assert MD.spread(dealt) is dealt
