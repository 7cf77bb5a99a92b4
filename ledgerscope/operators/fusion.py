"""Score fusion and post-processing."""
from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import clip
from ..session import materialize
from .ordered import rank_pct


def ensemble_weights(scores: DataFrame, model: str = "model", score: str = "ap") -> DataFrame:
    """K4: weights proportional to the scores; equal weights if the total <= 0.
    ``scores`` has one row per model (a handful), so the total is a scalar."""
    agg = scores.agg(F.sum(score).alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, n = float(agg["t"] or 0.0), int(agg["n"])
    w = F.lit(1.0 / n) if total <= 0 else F.col(score) / F.lit(total)
    return scores.select(model, w.alias("weight"))


def blend(df: DataFrame, weights: dict, out: str = "blend") -> DataFrame:
    """K5: ``clip(sum_m w_m * score_m, 0, 1)`` (weights are a small dict)."""
    expr = None
    for m, w in weights.items():
        term = F.lit(float(w)) * F.col(m)
        expr = term if expr is None else expr + term
    return df.withColumn(out, clip(expr, 0.0, 1.0))


def simplex_grid(models: list, step: float = 0.1) -> list:
    """All weight vectors on the simplex with the given step (66 for 3 models at 0.1)."""
    k = int(round(1.0 / step))
    out = []
    for combo in product(range(k + 1), repeat=len(models) - 1):
        if sum(combo) <= k:
            out.append(tuple(c / k for c in combo) + ((k - sum(combo)) / k,))
    return out


def blend_weight_search(df: DataFrame, models: list, label: str = S.LABEL, step: float = 0.1) -> DataFrame:
    """K6: exact AP of every simplex grid candidate (:func:`blend_aps`).

    The candidate list is bounded by the grid (not by the data).  Returns one
    row per candidate: ``cand, w_<model>..., ap``.
    """
    grid = simplex_grid(models, step)
    ap = blend_aps(known_scores(df, models, label), models, grid, label)
    cands = df.sparkSession.createDataFrame(
        [(i, *[float(v) for v in w]) for i, w in enumerate(grid)],
        ["cand", *[f"w_{m}" for m in models]])
    return cands.join(ap, "cand", "left").fillna(0.0, ["ap"])


# ------------------------------------------------- exact APs of many blends (K6)

BLEND_ROWS = 500_000   # rows that a task sorts at once; of a blend's scores a cell holds about as many
CUT_SAMPLE = 256       # sampled rows per cell, from which its cut points come


def known_scores(df: DataFrame, models: list, label: str = S.LABEL) -> DataFrame:
    """Label (null: 0) and scores of the rows that have a blend, written: the passes over them read nothing else."""
    rows = df.select(F.coalesce(F.col(label).cast("long"), F.lit(0)).alias(label), *[F.col(m).cast("double").alias(m) for m in models])
    return materialize(rows.where(" and ".join(f"`{m}` is not null" for m in models)), "blend_scores")


def blended(scores: list, weights: tuple) -> np.ndarray:
    """:func:`blend` of whole columns; like there NaN is above every number."""
    out = float(weights[0]) * scores[0]
    for w, x in zip(weights[1:], scores[1:]):
        out = out + float(w) * x
    return np.where(np.isnan(out), 1.0, np.clip(out, 0.0, 1.0))


def _stacks(batches, rows: int):
    """``(label, scores)`` of at least ``rows`` rows each (the last one: what is left)."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table) -> tuple[np.ndarray, list]:
    y, *scores = (c.to_numpy() for c in table.columns)
    return y, scores


def _cell_ap(score: np.ndarray, n: np.ndarray, tp: np.ndarray, above: tuple, total: int) -> float:
    """AP share of a cell of scores; ``above``: rows and positives of the cells above it.  Equal scores are one threshold."""
    at = np.argsort(-score, kind="stable")
    ends = np.flatnonzero(np.r_[np.diff(score[at]) != 0, True])
    seen, hits = above[0] + np.cumsum(n[at])[ends], above[1] + np.cumsum(tp[at])[ends]
    return float((np.diff(hits, prepend=above[1]) / total * (hits / seen)).sum())


def blend_aps(known: DataFrame, models: list, weights: list, label: str = S.LABEL, cell_rows: int = BLEND_ROWS) -> DataFrame:
    """Exact AP of the blend by each of ``weights``: ``cand, ap`` (``cand``: place in the list; no rows of :func:`known_scores`, no AP).

    The scores of a blend are cut into cells, from the top one down.  A first pass counts rows and positives per blend and cell, a
    second one sends every different score of a task with its counts as arrays, one row per blend and cell; a cell's
    scores are then ordered in one task, from the counts of the cells above it.  The cut points come from a sample; they only
    balance the cells, any would give the same APs.  The driver holds the cut points and counts: (blends x cells) numbers.
    """
    spark, rows = known.sparkSession, known.select(label, *models)
    cells = -(-rows.count() // cell_rows)
    if not cells or not weights:
        return spark.createDataFrame([], "cand int, ap double")
    cuts = [np.zeros(0)] * len(weights)
    if cells > 1:
        _, drawn = _columns(rows.sample(min(1.0, CUT_SAMPLE / cell_rows), seed=S.RANDOM_STATE).toArrow())
        if len(drawn[0]):
            cuts = [np.unique(np.quantile(blended(drawn, w), np.arange(1, cells) / cells)) for w in weights]
    shape = (len(weights), cells)   # the last cell is the topmost

    def count(batches):
        total = np.zeros((2, *shape), np.int64)
        for table in _stacks(batches, cell_rows):
            y, scores = _columns(table)
            for k, w in enumerate(weights):
                cell = np.searchsorted(cuts[k], blended(scores, w), "right")
                total[0, k] += np.bincount(cell, minlength=cells)
                np.add.at(total[1, k], cell[y != 0], y[y != 0])
        k, cell = np.nonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k.astype(np.int32), cell.astype(np.int32), total[0, k, cell], total[1, k, cell])], ["cand", "cell", "n", "tp"])

    sizes = np.zeros((2, *shape), np.int64)
    for r in rows.mapInArrow(count, "cand int, cell int, n long, tp long").groupBy("cand", "cell").agg(F.sum("n"), F.sum("tp")).collect():
        sizes[:, r[0], r[1]] = r[2], r[3]
    above = sizes[:, :, ::-1].cumsum(axis=2)[:, :, ::-1] - sizes
    total = int(sizes[1, 0].sum())
    if total <= 0:
        return spark.createDataFrame([(k, 0.0) for k in range(len(weights))], "cand int, ap double")

    def pieces(batches):
        for table in _stacks(batches, cell_rows):
            y, scores = _columns(table)
            for k, w in enumerate(weights):
                x = blended(scores, w)
                at = np.argsort(x)
                x, hits = x[at], np.r_[0, np.cumsum(y[at])]
                first = np.flatnonzero(np.r_[True, np.diff(x) != 0])
                x, ends = x[first], np.r_[first[1:], len(x)]
                n, tp = (ends - first).astype("<u4"), hits[ends] - hits[first]
                bounds = np.r_[0, np.searchsorted(x, cuts[k], "left"), len(x)]
                out = []
                for c, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    if a < b:
                        some = np.flatnonzero(tp[a:b])
                        out.append((k, c, x[a:b].tobytes(), n[a:b].tobytes(), some.astype("<u4").tobytes(), tp[a:b][some].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.binary()] * 4))],
                                                 ["cand", "cell", "score", "n", "at", "tp"])

    def share(key, table):
        k, c = (v.as_py() for v in key)
        score, n, at, tp = ([np.frombuffer(v, kind) for v in table.column(name).to_pylist()]
                            for name, kind in (("score", "<f8"), ("n", "<u4"), ("at", "<u4"), ("tp", "<i8")))
        dense = np.zeros(sum(map(len, score)), np.int64)
        starts = np.cumsum([0, *map(len, score)])
        for start, places, hits in zip(starts, at, tp):
            dense[start + places] = hits
        ap = _cell_ap(np.concatenate(score), np.concatenate(n).astype(np.int64), dense, tuple(above[:, k, c].tolist()), total)
        return pa.table({"cand": pa.array([k], pa.int32()), "ap": [ap]})

    sent = rows.mapInArrow(pieces, "cand int, cell int, score binary, n binary, at binary, tp binary")
    return sent.groupBy("cand", "cell").applyInArrow(share, "cand int, ap double").groupBy("cand").agg(F.sum("ap").alias("ap"))


# ---------------------------------------------------------------- bounded search (K6)

CELL_LEVELS = 48   # levels of each score: at most CELL_LEVELS ** models cells reach the driver
MOST_MODELS = 3    # beyond, the cells would not fit


def score_cells(df: DataFrame, models: list, label: str = S.LABEL, levels: int = CELL_LEVELS) -> list:
    """``(negatives, positives, lowest and highest score of each model)`` of the cells of a grid over the scores.

    One aggregate with map-side sums; rows with a null score have no blend and are left out, like in the AP.
    """
    if len(models) > MOST_MODELS:
        raise ValueError(f"cells of more than {MOST_MODELS} scores do not fit the driver")
    level = lambda m: F.least(F.greatest(F.floor(F.col(m) * levels), F.lit(0)), F.lit(levels - 1)).alias(f"_l_{m}")
    known = df.where(" and ".join(f"`{m}` is not null" for m in models))
    ends = [f(m).alias(f"{f.__name__}_{m}") for m in models for f in (F.min, F.max)]
    cells = known.select(label, *models, *[level(m) for m in models]).groupBy(*[f"_l_{m}" for m in models]).agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("_p"), *ends)
    rows = cells.select((F.col("_n") - F.col("_p")).alias("neg"), F.col("_p").alias("pos"), *[e for m in models for e in (f"min_{m}", f"max_{m}")]).collect()
    return [np.array(x, float) for x in zip(*rows)] if rows else [np.zeros(0)] * (2 + 2 * len(models))


def _harmonic(n: np.ndarray) -> np.ndarray:
    """``1 + 1/2 + ... + 1/n``: summed up to a bound, from its series beyond."""
    table = np.r_[0.0, np.cumsum(1.0 / np.arange(1, 10_001))]
    small, x = np.minimum(n, 10_000).astype(np.int64), np.maximum(n, 1.0)
    return np.where(n <= 10_000, table[small], np.log(x) + np.euler_gamma + 1 / (2 * x) - 1 / (12 * x * x))


def ranked_precision(value: np.ndarray, pos: np.ndarray, neg: np.ndarray, positives_first: bool) -> float:
    """Average precision of groups of rows at their values; in a tie all positives come first, or all negatives."""
    total = pos.sum()
    if not total:
        return 0.0
    at = np.lexsort(((pos > 0) == (not positives_first), -value))
    pos, neg = pos[at], neg[at]
    p0, n0 = np.cumsum(pos) - pos, np.cumsum(neg) - neg
    above = p0 + n0
    # of p positives in a row after n0 negatives, the i-th has precision (p0 + i) / (p0 + n0 + i)
    return float(((pos - n0 * (_harmonic(above + pos) - _harmonic(above)))[pos > 0]).sum() / total)


def ap_bounds(cells: list, weights: tuple) -> tuple[float, float]:
    """Lower and upper bound of the AP of a blend from the cells alone.

    Raising a positive or lowering a negative never lowers the AP.  So it is highest with all positives at the top and all
    negatives at the bottom of their cells' blends, and lowest the other way round.
    """
    neg, pos = cells[0], cells[1]
    ends = [np.clip(sum(w * cells[2 + 2 * k + e] for k, w in enumerate(weights)), 0.0, 1.0) for e in (0, 1)]
    widest = 1e-12  # the blend's own rounding
    out = []
    for top in (False, True):
        p, n = (ends[1] + widest, ends[0] - widest) if top else (ends[0] - widest, ends[1] + widest)
        has_p, has_n = pos > 0, neg > 0
        value = np.r_[p[has_p], n[has_n]]
        out.append(ranked_precision(value, np.r_[pos[has_p], np.zeros(has_n.sum())], np.r_[np.zeros(has_p.sum()), neg[has_n]], top))
    return out[0], out[1]


def search_weights(df: DataFrame, models: list, label: str = S.LABEL, step: float = 0.1, refinements: int = 3, starts: int = 4,
                   levels: int = CELL_LEVELS, batch: int = 4) -> DataFrame:
    """K6, continuous: the simplex grid, refined around its best points, with exact APs only where they can still win.

    The driver bounds every candidate's AP from the cells.  After the grid each refinement halves the step and tries
    the neighbours of the ``starts`` best points.  Then the candidates are evaluated exactly, ``batch`` at a time (a
    pass evaluates several batches ahead), the highest upper bound first, until no bound of the others reaches the best AP found.  Returns a row per candidate: ``cand,
    w_<model>..., lower, upper, ap``; ``ap`` is null where the bound ruled the candidate out.  Candidates are numbered
    in the order in which they came up, the grid first.
    """
    cells = score_cells(df, models, label, levels)
    found = {w: ap_bounds(cells, w) for w in simplex_grid(models, step)}
    for _ in range(refinements if len(models) > 1 else 0):
        step /= 2
        best = sorted(found, key=lambda w: (-sum(found[w]), w))[:starts]
        for w in best:
            for i in range(len(w)):
                for j in range(len(w)):
                    moved = list(w)
                    moved[i], moved[j] = round(w[i] + step, 12), round(w[j] - step, 12)
                    near = tuple(moved)
                    if i != j and moved[j] >= 0 and near not in found:
                        found[near] = ap_bounds(cells, near)
    order, exact, top = list(found), {}, -1.0
    rest = sorted(order, key=lambda w: (-found[w][1], order.index(w)))
    known, tried, ahead = known_scores(df, models, label), {}, 4 * batch
    while rest and found[rest[0]][1] >= top - 1e-9:
        if any(w not in tried for w in rest[:batch]):   # a pass takes the batches that may come next along, so there are few passes
            now = [w for w in rest[:ahead] if w not in tried and (found[w][1] >= top - 1e-9 or w in rest[:batch])]
            tried |= dict(zip(now, exact_aps(known, models, label, now)))
            ahead = min(2 * ahead, 16 * batch)
        now, rest = rest[:batch], rest[batch:]
        exact |= {w: tried[w] for w in now}
        top = max(top, *[tried[w] for w in now])
    rows = [(k, *map(float, w), *found[w], exact.get(w)) for k, w in enumerate(order)]
    kinds = ", ".join(["cand int", *[f"w_{m} double" for m in models], "lower double, upper double, ap double"])
    return df.sparkSession.createDataFrame(rows, kinds)


def _exact_aps(df: DataFrame, models: list, label: str, weights: list) -> list:
    """AP of a few blends."""
    return exact_aps(known_scores(df, models, label), models, label, weights)


def exact_aps(known: DataFrame, models: list, label: str, weights: list) -> list:
    """AP of a few blends of :func:`known_scores`; 0 without rows."""
    found = {r["cand"]: float(r["ap"]) for r in blend_aps(known, models, weights, label).collect()}   # one row per blend
    return [found.get(k, 0.0) for k in range(len(weights))]


def best_weights(search: DataFrame, models: list) -> dict:
    """Highest AP; ties go to the lowest candidate number (deterministic)."""
    row = search.orderBy(F.col("ap").desc_nulls_last(), F.col("cand")).first()
    return {m: float(row[f"w_{m}"]) for m in models}


def rank_blend(df: DataFrame, a: str, b: str, w_a: float = S.RANK_BLEND_WEIGHT, out: str = "rank_blend",
               partition_cols: list | None = None) -> DataFrame:
    """K8: ``w * rankpct(a) + (1 - w) * rankpct(b)`` (ties averaged)."""
    x = rank_pct(df, a, "_ra", partition_cols)
    x = rank_pct(x, b, "_rb", partition_cols)
    return (x.withColumn(out, F.lit(w_a) * F.col("_ra") + F.lit(1.0 - w_a) * F.col("_rb"))
             .drop("_ra", "_rb"))


def operation_prior(df: DataFrame, score: str, operation: str = S.POSITIVE_OPERATION,
                    shrink: float = S.OPERATION_PRIOR_SHRINK, out: str = "adjusted") -> DataFrame:
    """K9: scores of other operations times ``shrink`` when both kinds exist; clip."""
    row = df.agg(F.count_if(F.col(S.OPERATION) == operation).alias("pos"),
                 F.count_if(~(F.col(S.OPERATION) == operation) | F.col(S.OPERATION).isNull()).alias("neg")).first()
    both = row["pos"] > 0 and row["neg"] > 0
    s = F.col(score)
    if both:
        is_pos = F.coalesce(F.col(S.OPERATION) == operation, F.lit(False))
        s = F.when(is_pos, s).otherwise(s * F.lit(shrink))
    return df.withColumn(out, clip(s, 0.0, 1.0))


def two_stage_scores(df: DataFrame, global_score: str, specialist_score: str,
                     operation: str = S.POSITIVE_OPERATION, rank_weight: float = S.TWO_STAGE_RANK_WEIGHT,
                     floor_ratio: float = S.TWO_STAGE_FLOOR_RATIO, min_score: float = S.TWO_STAGE_MIN_SCORE,
                     out: str = "fused") -> DataFrame:
    """Rank blend inside the positive operation; every other row gets
    ``max(floor_ratio * min(fused), min_score)`` (``min_score`` when the
    operation is absent); clip to [0, 1]."""
    is_pos = F.coalesce(F.col(S.OPERATION) == operation, F.lit(False))
    pos = df.filter(is_pos)
    rest = df.filter(~is_pos)
    fused = rank_blend(pos, global_score, specialist_score, rank_weight, "_f")
    mn = fused.agg(F.min("_f")).first()[0]
    floor = min_score if mn is None else max(float(mn) * floor_ratio, min_score)
    res = (fused.withColumn(out, clip(F.col("_f"), 0.0, 1.0)).drop("_f")
           .unionByName(rest.withColumn(out, clip(F.lit(floor), 0.0, 1.0))))
    return res
