"""Halving brackets, the density sampler, resumable fits, and the whole search against an even draw."""
import random
import statistics

import pytest

from ledgerscope import schema as S
from ledgerscope.operators import boosting as BO
from ledgerscope.operators import search as SE
from ledgerscope.plans import boost_queries as BQ
from tests.conftest import SF001


def test_brackets_of_81():
    found = [(n, [(b, k) for b, k in rungs]) for n, rungs in SE.brackets(81, 3)]
    assert [n for n, _ in found] == [81, 34, 15, 8, 5]
    assert found[0][1] == [(1, 27), (3, 9), (9, 3), (27, 1), (81, 1)] and found[-1][1] == [(81, 1)]


def test_halving_keeps_the_best_and_hands_states_on():
    scores, seen = {"a": 3, "b": 5, "c": 5, "d": 1}, []

    def evaluate(trials, budget, states):
        seen.append((budget, list(zip(trials, states))))
        return [(scores[t], (t, budget)) for t in trials]
    record = SE.halving(list("abcd"), SE.rungs_of(4, 1, 4, 2), evaluate, 2, 10)
    assert [(r.bracket, r.trial, r.rung, r.budget, r.kept) for r in record] == [
        (2, 10, 0, 1, False), (2, 11, 0, 1, True), (2, 12, 0, 1, True), (2, 13, 0, 1, False), (2, 11, 1, 2, True), (2, 12, 1, 2, False), (2, 11, 2, 4, True)]
    assert seen[1] == (2, [("b", ("b", 1)), ("c", ("c", 1))]) and seen[2] == (4, [("b", ("b", 2))])


SPACE = {k: list(range(6)) for k in "pqrs"}


def _score(settings, budget, noise):
    """A planted optimum at 4, 4, 4, 4; little budget blurs it."""
    return -sum((v - 4) ** 2 for v in settings.values()) + noise.gauss(0, 3 / budget)


def test_the_search_beats_an_even_draw_at_equal_budget():
    gains = []
    for seed in range(60):
        noise = random.Random(1000 + seed)
        record, settings = SE.hyperband(SPACE, lambda ts, b, _: [(_score(t, b, noise), None) for t in ts], 27, 3, seed)
        spent, reached = 0, {}
        for r in record:
            spent += r.budget - reached.get(r.trial, 0)  # a trial goes on from where it was
            reached[r.trial] = r.budget
        best = max((r for r in record if r.budget == 27), key=lambda r: r.score).trial
        rng = random.Random(seed)
        even = max(({k: rng.choice(v) for k, v in SPACE.items()} for _ in range(spent // 27)), key=lambda s: _score(s, 27, noise))
        true = lambda s: -sum((v - 4) ** 2 for v in s.values())
        gains.append(true(settings[best]) - true(even))
    assert statistics.mean(gains) > 1 and sum(g >= 0 for g in gains) >= 40


def test_draws_lean_to_good_choices():
    rng = random.Random(1)
    finished = [({"p": v, "q": rng.randrange(3)}, 1.0 if v == 2 else 0.0) for v in (0, 1, 2) * 5]
    drawn = [SE.draw({"p": [0, 1, 2], "q": [0, 1, 2]}, finished, rng)["p"] for _ in range(50)]
    assert drawn.count(2) > 40
    assert len({SE.draw({"p": [0, 1, 2]}, finished[:3], rng)["p"] for _ in range(50)}) == 3


def test_a_resumed_fit_equals_one_in_one_go(spark):
    train, held = BQ.frame(spark, SF001)
    fit = lambda rounds, resume=None: BO.fit_boosted(train, BQ.NUMERIC, BQ.CATEGORICAL, BO.BoostSpec(rounds=rounds, depth=2, bins=8, block=2, min_rows=5, columns=0.6), resume=resume)
    whole, part = fit(4), fit(4, fit(2))
    assert len(part.trees) == 4 and [t.feature for t in whole.trees] == [t.feature for t in part.trees] and [t.value for t in whole.trees] == [t.value for t in part.trees]
    assert [h[1] for h in whole.history] == pytest.approx([h[1] for h in part.history])
    rows = [m.margin(held, [S.ID]).collect() for m in (whole, part)]
    assert sorted(rows[0]) == sorted(rows[1])
