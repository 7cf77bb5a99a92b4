"""The bounded weight search: bounds hold, the result is never worse than the grid, few rows are shuffled."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.operators import fusion as FU
from ledgerscope.operators import metrics as M


@pytest.fixture(scope="module")
def frame(spark):
    draw, rows = random.Random(6), []
    for i in range(3000):
        y = int(draw.random() < 0.1)
        clean = lambda x: min(1.0, max(0.0, x))
        rows.append((i, y, clean(draw.gauss(0.35 + 0.2 * y, 0.15)), round(clean(draw.gauss(0.4 + 0.15 * y, 0.2)), 1), clean(draw.random() * 0.8 + 0.1 * y) if i % 90 else None))
    return spark.createDataFrame(rows, f"id int, {S.LABEL} int, a double, b double, c double").cache()


def _ap(values, y):
    """Step-wise AP with tied values in one step."""
    total, out, tp, n = sum(y), 0.0, 0, 0
    for v in sorted(set(values), reverse=True):
        hits = [t for x, t in zip(values, y) if x == v]
        tp, n = tp + sum(hits), n + len(hits)
        out += sum(hits) / total * tp / n
    return out


@pytest.mark.parametrize("levels", [2, 8, 48])
def test_bounds_hold_the_exact_precision(frame, levels):
    cells = FU.score_cells(frame, ["a", "b", "c"], levels=levels)
    assert len(cells[0]) <= levels ** 3
    rows = frame.where("c is not null").collect()
    for w in [(1, 0, 0), (0, 1, 0), (0.2, 0.5, 0.3), (0.35, 0.35, 0.3), (0.05, 0.05, 0.9)]:
        low, high = FU.ap_bounds(cells, w)
        exact = _ap([w[0] * r["a"] + w[1] * r["b"] + w[2] * r["c"] for r in rows], [r[S.LABEL] for r in rows])
        assert low - 1e-9 <= exact <= high + 1e-9
    if levels == 48:
        assert high - low < 0.1


def test_harmonic_and_ranked_precision():
    assert FU._harmonic(np.array([0, 1, 2, 10_000, 30_000.0])) == pytest.approx([0, 1, 1.5, sum(1 / k for k in range(1, 10_001)), sum(1 / k for k in range(1, 30_001))], abs=1e-12)
    draw = random.Random(7)
    for _ in range(50):
        value = [draw.choice([0.1, 0.4, 0.7]) + draw.choice([0, 1e-3]) * k for k in range(30)]
        y = [draw.randrange(2) for _ in value]
        for first in (True, False):
            order = sorted(range(30), key=lambda k: (-value[k], (1 - y[k]) if first else y[k]))
            hits = np.cumsum([y[k] for k in order])
            want = sum(hits[i] / (i + 1) for i, k in enumerate(order) if y[k]) / max(1, sum(y))
            got = FU.ranked_precision(np.array(value), np.array(y, float), 1.0 - np.array(y), first)
            assert got == pytest.approx(want, abs=1e-12)


def test_never_worse_than_the_grid_and_few_exact_passes(frame):
    names = ["a", "b", "c"]
    grid = FU.blend_weight_search(frame, names).agg(F.max("ap")).first()[0]
    plain = FU.search_weights(frame, names, refinements=0)
    assert plain.count() == 66 and plain.agg(F.max("ap")).first()[0] == pytest.approx(grid, abs=1e-12)
    fine = FU.search_weights(frame, names)
    w = FU.best_weights(fine, names)
    best = M.average_precision_value(FU.blend(frame, w, "_b"), "_b")
    assert best >= grid - 1e-12 and sum(w.values()) == pytest.approx(1) and min(w.values()) >= 0
    assert best == pytest.approx(fine.agg(F.max("ap")).first()[0], abs=1e-12)
    rows = fine.collect()
    assert all(r["lower"] - 1e-9 <= r["ap"] <= r["upper"] + 1e-9 for r in rows if r["ap"] is not None)
    assert all(r["upper"] < best for r in rows if r["ap"] is None)


def test_edges(frame):
    assert FU.search_weights(frame.where("false"), ["a", "b"]).agg(F.max("ap")).first()[0] == 0.0
    assert FU.best_weights(FU.search_weights(frame, ["a"]), ["a"]) == {"a": 1.0}
    with pytest.raises(ValueError):
        FU.score_cells(frame, ["a", "b", "c", "id"])


def test_aps_of_blends_from_cells_of_sorted_scores(spark):
    """Cells of few rows, ties within and across tasks, null labels and scores, NaN: like one sort of all rows."""
    draw, rows = random.Random(8), []
    for i in range(2000):
        y = draw.choice([0, 0, 0, 1, None])
        rows.append((y, round(draw.random(), draw.choice([1, 5])), draw.random() if i % 50 else float("nan"), 0.5 if i % 3 else round(draw.random(), 2), ))
    rows += [(1, None, 0.5, 0.5), (0, 0.1, None, 0.2)]
    df = spark.createDataFrame(rows, f"{S.LABEL} int, a double, b double, c double").repartition(3)
    names, weights = ["a", "b", "c"], [(1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.2, 0.5, 0.3), (0.9, 0.9, 0.9), (-1.0, -1.0, 0.0)]
    known = FU.known_scores(df, names)
    for cell_rows in (97, 1000, 10_000):
        found = {r["cand"]: r["ap"] for r in FU.blend_aps(known, names, weights, cell_rows=cell_rows).collect()}
        for k, w in enumerate(weights):
            want = M.average_precision_value(FU.blend(df, dict(zip(names, w)), "_b"), "_b")
            assert found[k] == pytest.approx(want, abs=1e-12), (cell_rows, w)
    assert FU.exact_aps(known.where("false"), names, S.LABEL, weights) == [0.0] * 5
    assert FU.exact_aps(known.where(f"{S.LABEL} = 0"), names, S.LABEL, weights) == [0.0] * 5


def test_the_search_needs_few_passes_and_keeps_its_stopping_rule(frame, monkeypatch):
    passes, real = [], FU.exact_aps
    monkeypatch.setattr(FU, "exact_aps", lambda known, models, label, weights: passes.append(len(weights)) or real(known, models, label, weights))
    rows = FU.search_weights(frame, ["a", "b", "c"]).orderBy(F.col("upper").desc(), "cand").collect()
    done = [r for r in rows if r["ap"] is not None]
    assert len(done) > 4 and len(passes) < len(done) / 4
    top, at = -1.0, 0   # four at a time until no bound reaches the best
    while at < len(rows) and rows[at]["upper"] >= top - 1e-9:
        top, at = max(top, *[r["ap"] for r in rows[at:at + 4]]), at + 4
    assert {r["cand"] for r in done} == {r["cand"] for r in rows[:at]}
