"""Order statistics over range cells: equal to plain windows, and no task beyond its bound."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.operators import metrics as M
from ledgerscope.operators import ordered as OD
from ledgerscope.sources import transactions as TX
from tests.conftest import SF001


@pytest.fixture(scope="module")
def tx(spark):
    return TX.load_transactions(spark, SF001)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("parts", [[], [S.OPERATION]])
def test_prefix_sums_equal_a_window(tx, descending, inclusive, parts):
    per = tx.groupBy(*parts, S.AMOUNT).agg(F.count(F.lit(1)).alias("n"))
    order = F.col(S.AMOUNT).desc() if descending else F.col(S.AMOUNT)
    plain = per.withColumn("c", F.coalesce(F.sum("n").over(Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)), F.lit(0)))
    got = OD.ordered_prefix(per, S.AMOUNT, {"c": F.col("n")}, parts, descending, inclusive, cell_rows=11)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select(*got.columns).collect()))


def test_ranks_quantiles_and_precision_over_cells(tx, monkeypatch):
    scored = TX.scored_rows(tx)
    x = tx.select(F.lit(-1).cast("long").alias("g"), S.AMOUNT).unionByName(tx.select(F.col(S.ORIGIN).alias("g"), S.AMOUNT))
    ask = lambda: (sorted(map(tuple, OD.rank_pct(tx.select(S.ID, S.AMOUNT), S.AMOUNT, "r").collect())),
                   sorted(map(tuple, OD.exact_quantiles(x, S.AMOUNT, [0, 0.25, 0.5, 1], ["g"]).collect())),
                   M.average_precision_value(scored, "p_a"))
    few = ask()
    monkeypatch.setattr(OD, "CELL_ROWS", 2)
    calls, cells = [], OD.range_cells
    monkeypatch.setattr(OD, "range_cells", lambda *a: calls.append(a) or cells(*a))
    many = ask()
    assert len(calls) == 3 and many[:2] == few[:2] and many[2] == pytest.approx(few[2], abs=1e-12)


def test_a_hot_group_in_a_narrow_range_is_cut(spark):
    hot = spark.range(40_000).select(F.lit("hot").alias("g"), (F.col("id") * 1e-12 + 1).alias("v"))
    rest = spark.range(2000).select(F.concat(F.lit("g"), F.col("id") % 50).alias("g"), (F.col("id") * 1e6 - 1e9).alias("v"))
    x = hot.union(rest).withColumn("n", F.lit(1))
    cells = OD.range_cells(x, ["g", "v"], 500)
    sizes = [r["count"] for r in cells.groupBy(F.shiftright("_at", 33)).count().collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 42_000
    got = OD.ordered_prefix(x, "v", {"c": F.col("n")}, ["g"], cell_rows=500)
    assert got.where("g = 'hot'").where("c <> round((v - 1) * 1e12) + 1").count() == 0
    assert OD.exact_quantiles(x, "v", [0.5], ["g"], cell_rows=500).where("g = 'hot'").first()["q0"] == pytest.approx(1 + 19_999.5e-12, abs=1e-15)


def test_empty(spark):
    none = spark.createDataFrame([], "v double, n long")
    assert OD.ordered_prefix(none, "v", {"c": F.col("n")}, cell_rows=1).count() == 0
    assert OD.range_cells(none, ["v"], 1).count() == 0
