"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy from confirmed toxic texts (P) and unlabelled ones (U).  With the class prior
``pi`` the risk of the negatives is estimated as ``R_u(-) - pi R_p(-)``; where that estimate falls below zero, which
only over-fitting can cause, the step goes against it (Kiryo et al., 2017).  Features are hashed words and
their first four and five letters, each different word of a text counting once.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerscope.llm import hashed
from ledgerscope.llm.common import read

THRESHOLD = 0.3
_WORD = re.compile(r"\w+")
_FEATURES: dict[str, tuple[int, ...]] = {}


def word_features(w: str) -> tuple[int, ...]:
    found = _FEATURES.get(w)
    if found is None:
        if len(_FEATURES) > 100_000:
            _FEATURES.clear()
        found = _FEATURES[w] = tuple(x for p in _WORD.findall(w.lower()) for x in
                                     (hashed.bucket("w" + p), hashed.bucket("4" + p[:4]), hashed.bucket("5" + p[:5])))
    return found


def _once(at, bounds, n_words):
    """Each different word of each text once: ``(text, word)``."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.divmod(np.unique(text * max(1, n_words) + at), max(1, n_words))


def extract(words, at, bounds):
    features = [word_features(w) for w in words]
    text, word = _once(at, bounds, len(words))
    cuts = np.searchsorted(text, np.arange(len(bounds)))
    for a, b in zip(cuts, cuts[1:]):
        yield np.unique(np.array([f for k in word[a:b] for f in features[k]], np.int64)), None


def fit(rows: list[tuple], prior: float, epochs: int = 15, rate: float = 0.1, l1: float = 2e-3, batch: int = 500,
        least_texts: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias from ``(id, positive?, buckets, ...)``: proximal AdaGrad on the non-negative PU risk.

    Buckets seen in fewer than ``least_texts`` sampled texts get no weight.
    """
    weights, bias = np.zeros(hashed.DIMS, np.float32), np.log(prior / (1 - prior)) if 0 < prior < 1 else -35.0
    pos = [r[2] for r in rows if r[1]]
    unl = [r[2] for r in rows if not r[1]]
    if not pos or not unl:
        return weights, float(bias)
    texts = np.zeros(hashed.DIMS, np.int64)
    for x in (*pos, *unl):
        texts[x] += 1  # the buckets of a text are different
    used = np.flatnonzero(texts >= least_texts)
    place = np.full(hashed.DIMS, -1, np.int32)
    place[used] = np.arange(len(used))
    pos, unl = ([k[k >= 0] for k in (place[x] for x in part)] for part in (pos, unl))
    w, n = np.r_[np.zeros(len(used)), bias], np.full(len(used) + 1, 1e-6)
    rng = np.random.default_rng(7)

    def risk(part):
        """Mean logistic losses of calling a batch positive or negative, with their gradients."""
        ends = np.cumsum([len(x) for x in part])
        idx, size = np.concatenate(part), np.diff(np.r_[0, ends])
        z = hashed.sums(w[idx], np.r_[0, ends]) + w[-1]
        out = []
        for sign in (1, -1):
            slope = -sign * hashed.sigmoid(-sign * z) / len(part)
            g = np.bincount(idx, np.repeat(slope, size), len(w))
            g[-1] = slope.sum()
            out.append((np.logaddexp(0, -sign * z).mean(), g))
        return out

    steps = max(1, -(-len(unl) // batch))
    per = max(1, -(-len(pos) // steps))
    for _ in range(epochs):
        up, pp = rng.permutation(len(unl)), rng.permutation(len(pos))
        for k in range(steps):
            (_, gp), (rn, gn) = risk([pos[i] for i in np.take(pp, range(k * per, (k + 1) * per), mode="wrap")])
            _, (ru, gu) = risk([unl[i] for i in up[k * batch:(k + 1) * batch]])
            g = prior * gp + gu - prior * gn if ru - prior * rn >= 0 else prior * gn - gu
            n += g * g
            step = rate / np.sqrt(n)
            w -= step * g
            w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - step[:-1] * l1)
    weights[used] = w[:-1]
    return weights, float(w[-1])


def scorer(weights: np.ndarray, bias: float):
    def score(words, at, bounds):
        if not len(at):
            return np.full(len(bounds) - 1, float(hashed.sigmoid(bias)))
        weight = np.array([weights[list(f)].sum() if f else 0.0 for f in map(word_features, words)])
        text, word = _once(at, bounds, len(words))
        return hashed.sigmoid(np.bincount(text, weight[word], len(bounds) - 1) + bias)
    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", most_positive: int = 4000, most_unlabelled: int = 12000) -> DataFrame:
    """``(doc_id, score)`` per row of ``docs``; label 1 is likelier the higher the score.

    Fitted on at most ``most_positive`` confirmed toxic rows that ``train(id)`` allows and at most
    ``most_unlabelled`` texts of the corpus taken without their labels, both chosen by the hash of the id; the class
    prior is the share of label 1 among the allowed labelled rows.  Every text is scored whole.  Rows without id
    are scored but not learned from; without a confirmed toxic row all scores are near 0.  Null and empty
    texts get the score of the bias; repeated rows are scored alike; other columns are not read.
    """
    known = hashed.one_label(labels, id_col, label_col, train)
    prior = known.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0] or 0.0
    pos = hashed.first_by_hash(known.where("label > 0").select("id"), most_positive).withColumn("positive", F.lit(1))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    unl = hashed.first_by_hash(ids, most_unlabelled).withColumn("positive", F.lit(0))
    rows = [r for part in (pos, unl) for r in hashed.collect_features(docs, part, extract, id_col, text_col)]
    weights, bias = fit(rows, prior)
    return hashed.score_texts(docs, scorer(weights, bias), id_col, text_col)


def in_training(ids):
    return hashed.id_remainder(ids, 4) != 2


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), in_training)
    return scored.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
