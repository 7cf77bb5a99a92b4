"""Greedy group folds: equal to dealing one group after the other, balanced, every group once."""
import random

import pytest

from ledgerscope import schema as S
from ledgerscope.operators import splits as SP


def _one_by_one(loads, size, n, totals):
    """The greedy rule literally, in exact integers."""
    (t0, t1), taken = (max(t, 1) for t in totals), [0] * len(loads)
    now = [list(x) for x in loads]
    for _ in range(n):
        f = min(range(len(now)), key=lambda f: (now[f][0] * size[0] * t1 ** 2 + now[f][1] * size[1] * t0 ** 2, sum(now[f]), f))
        taken[f] += 1
        now[f][0] += size[0]
        now[f][1] += size[1]
    return taken


def test_runs_of_equal_groups_are_dealt_like_one_by_one():
    draw = random.Random(4)
    for _ in range(400):
        k = draw.randrange(1, 7)
        loads = [(draw.randrange(60), draw.randrange(20)) for _ in range(k)]
        size = draw.choice([(1, 0), (0, 1), (3, 2), (5, 0), (draw.randrange(1, 9), draw.randrange(4))])
        totals = (sum(x[0] for x in loads) + draw.randrange(100), sum(x[1] for x in loads) + draw.randrange(30))
        n = draw.randrange(80)
        assert SP._dealt(loads, size, n, totals) == _one_by_one(loads, size, n, totals)


def test_many_equal_groups_cost_no_steps():
    taken = SP._dealt([(10 ** 11, 0), (0, 0), (5, 3), (0, 0), (0, 0)], (1, 0), 10 ** 12, (10 ** 13, 10 ** 6))
    assert sum(taken) == 10 ** 12 and max(taken) - min(taken) == 10 ** 11


def test_folds_of_accounts(spark):
    draw = random.Random(5)
    rows, i = [], 0
    for account in range(300):
        for _ in range(draw.choice([1, 1, 1, 2, 3, 400 if account == 7 else 5])):
            rows.append((i, account if account % 40 else None, draw.choice([0, 0, 0, 1, None])))
            i += 1
    df = spark.createDataFrame(rows, f"{S.ID} long, {S.ORIGIN} long, {S.LABEL} int")
    folds = SP.greedy_group_folds(df)
    got = {r[S.ORIGIN]: r["fold"] for r in folds.collect()}
    assert folds.count() == len(got) and set(got) == {r[1] for r in rows if r[1] is not None}
    counts = {}
    for _, a, y in rows:
        if a is not None:
            c = counts.setdefault(a, [0, 0])
            c[y or 0] += 1
    totals = [sum(c[j] for c in counts.values()) for j in (0, 1)]
    loads = [[0, 0] for _ in range(5)]
    for size in sorted(counts.values(), key=lambda c: (-abs(c[0] - c[1]), -sum(c), -c[1])):
        f = _one_by_one(loads, size, 1, totals).index(1)
        loads[f][0] += size[0]
        loads[f][1] += size[1]
    mine = [[sum(counts[a][j] for a in got if got[a] == f) for j in (0, 1)] for f in range(5)]
    assert mine == loads
    assert SP.greedy_group_folds(df.where("false")).count() == 0
