"""Search over settings (J17): successive-halving brackets over resumable evaluations, and a density-guided sampler.

The driver holds a few numbers per trial.  What a trial costs, a fit or a pass over rows, is the evaluation's job.
"""
from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Rung:
    """One row of a bracket's record."""
    bracket: int
    trial: int
    rung: int
    budget: int
    score: float
    kept: bool


def rungs_of(trials: int, least: int, most: int, eta: int) -> list[tuple[int, int]]:
    """``(budget, trials that go on)`` from budget ``least`` to ``most``, ``eta`` times the budget for an ``eta``-th of the trials."""
    out, budget = [], least
    while True:
        trials = max(1, trials // eta) if budget < most else min(1, trials)
        out.append((budget, trials))
        if budget >= most:
            return out
        budget = min(most, budget * eta)


def halving(trials: list, rungs: list[tuple[int, int]], evaluate: Callable, bracket: int = 0, first: int = 0) -> list[Rung]:
    """Runs the trials through the rungs: the best go on with more budget, of equal scores the earlier trials.

    ``evaluate(trials, budget, states)`` scores trials at a budget and gives ``[(score, state)]``; a state is what it needs to go on
    from there (None at first).  Trials are numbered from ``first``.
    """
    alive, states, out = list(range(len(trials))), {}, []
    for r, (budget, go_on) in enumerate(rungs):
        scored = evaluate([trials[t] for t in alive], budget, [states.get(t) for t in alive])
        states = {t: state for t, (_, state) in zip(alive, scored)}
        order = sorted(zip(alive, scored), key=lambda x: (-x[1][0], x[0]))
        kept = {t for t, _ in order[:go_on]}
        out += [Rung(bracket, first + t, r, budget, float(score), t in kept) for t, (score, _) in zip(alive, scored)]
        alive = sorted(kept)
    return out


def brackets(most: int, eta: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Hyperband's brackets ``(trials, rungs)``: from many trials with little budget to few with all of it."""
    depth = int(math.log(most, eta) + 1e-9)
    out = []
    for s in range(depth, -1, -1):
        trials = math.ceil((depth + 1) / (s + 1) * eta ** s)
        out.append((trials, rungs_of(trials, max(1, most // eta ** s), most, eta)))
    return out


def draw(space: dict, finished: list[tuple[dict, float]], rng: random.Random, least: int = 4, share: float = 0.3, tries: int = 24) -> dict:
    """Settings whose choices are frequent among the best ``share`` of the finished trials and rare among the others.

    Each setting has a smoothed density over its choices for either part; ``tries`` candidates come from the good one, and the one with the
    highest ratio of the two is taken.  With fewer than ``least`` finished trials the draw is even.
    """
    if len(finished) < least:
        return {k: rng.choice(v) for k, v in space.items()}
    ordered = sorted(finished, key=lambda x: -x[1])
    cut = max(1, math.ceil(share * len(ordered)))
    parts = [[s for s, _ in some] for some in (ordered[:cut], ordered[cut:])]

    def density(k, part):
        return [(1 + sum(s[k] == v for s in part)) / (len(space[k]) + len(part)) for v in space[k]]

    good, bad = ({k: density(k, part) for k in space} for part in parts)
    best = None
    for _ in range(tries):
        at = {k: rng.choices(range(len(v)), good[k])[0] for k, v in space.items()}
        ratio = sum(math.log(good[k][i] / bad[k][i]) for k, i in at.items())
        if best is None or ratio > best[0]:
            best = ratio, at
    return {k: space[k][i] for k, i in best[1].items()}


def hyperband(space: dict, evaluate: Callable, most: int, eta: int = 3, seed: int = 0) -> tuple[list[Rung], list[dict]]:
    """All brackets, each with settings drawn from what the earlier ones found; the record and the settings by trial number.

    A trial counts as finished with its score at the highest budget it reached, if that is at least ``most / eta``.
    """
    rng, record, settings = random.Random(seed), [], []
    for b, (n, rungs) in enumerate(brackets(most, eta)):
        last = {}
        for r in record:
            if r.budget * eta >= most:
                last[r.trial] = r.score
        drawn = [draw(space, [(settings[t], s) for t, s in last.items()], rng) for _ in range(n)]
        record += halving(drawn, rungs, evaluate, b, len(settings))
        settings += drawn
    return record, settings
