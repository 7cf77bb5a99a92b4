"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader (FTRL-proximal).

The n-grams of a text are its words, its word pairs, and its word pairs with words written as shapes (``Xx``,
``x$``, ``9`` ...), the second of two equal neighbours being ``=``.  A value is the n-gram's count over the
square root of the number of words, and a score is one sparse dot product.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerscope.llm import hashed
from ledgerscope.llm.common import read

THRESHOLD = 0.3
_RUNS = re.compile(r"([a-zß-öø-ÿ]+)|([A-ZÀ-ÖØ-Þ]+)|([0-9]+)|(.)\4*", re.S)


def shape(word: str) -> str:
    return _RUNS.sub(lambda m: "x" if m[1] else "X" if m[2] else "9" if m[3] else m[4], word)


_WORDS: dict[str, tuple[int, int]] = {}


def _word(w: str) -> tuple[int, int]:
    found = _WORDS.get(w)
    if found is None:
        if len(_WORDS) > 100_000:
            _WORDS.clear()
        found = _WORDS[w] = hashed.bucket("w" + w), hashed.bucket("s" + shape(w))
    return found


def _grams(words, at, bounds):
    """Buckets of the three kinds of n-grams in reading order; a pair belongs to its second word, -1 at a text's first."""
    both = np.array([_word(w) for w in words], np.int64).reshape(-1, 2)
    w, s = both[at, 0], both[at, 1]
    same = np.r_[False, at[1:] == at[:-1]][:len(at)]
    s2 = np.where(same, hashed.bucket("="), s)
    mask = hashed.DIMS - 1
    mix = lambda a, b, k: ((a * 0x9E3779B1 ^ b * 0x85EBCA77) + k >> 7) & mask
    prev = lambda x: np.r_[0, x[:-1]][:len(x)]
    pairs, shapes = mix(prev(w), w, 1), mix(prev(s), s2, 2)
    firsts = bounds[:-1][bounds[1:] > bounds[:-1]]
    pairs[firsts] = shapes[firsts] = -1
    return w, pairs, shapes


def extract(words, at, bounds):
    """``(buckets, values)`` of each text of a group."""
    kinds = _grams(words, at, bounds)
    for a, b in zip(bounds, bounds[1:]):
        idx = np.concatenate([k[a:b] for k in kinds])
        idx, n = np.unique(idx[idx >= 0], return_counts=True)
        yield idx, n / np.sqrt(max(1, b - a))


def fit(rows: list[tuple], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes over ``(id, label, buckets, values)``, in an order fixed by the seed."""
    z, n = np.zeros(hashed.DIMS + 1), np.zeros(hashed.DIMS + 1)
    free = np.ones(hashed.DIMS + 1) * l1
    free[-1] = 0  # the bias is not pulled to zero

    def weights(i):
        return np.where(np.abs(z[i]) <= free[i], 0.0, -(z[i] - np.sign(z[i]) * free[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(8)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            _, label, idx, val = rows[k]
            i, x = np.r_[idx.astype(np.int64), hashed.DIMS], np.r_[val.astype(float), 1.0]
            w = weights(i)
            g = (hashed.sigmoid(x @ w) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(hashed.DIMS + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def scorer(weights: np.ndarray, bias: float):
    def score(words, at, bounds):
        w, pairs, shapes = _grams(words, at, bounds)
        one = weights[w] + np.where(pairs >= 0, weights[pairs], 0) + np.where(shapes >= 0, weights[shapes], 0)
        return hashed.sigmoid(hashed.sums(one, bounds) / np.sqrt(np.maximum(1, np.diff(bounds))) + bias)
    return score


def quality_scores(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", most_labelled: int = 8000) -> DataFrame:
    """``(doc_id, score)`` per row of ``docs``; label 1 is likelier the higher the score.

    The model is fitted on at most ``most_labelled`` of the labelled rows that ``train(id)`` allows, chosen by the hash
    of the id, so that the fit stays small whatever the corpus; every text is scored whole.  Rows without id or
    label are not learned from; without any labelled row all scores are 0.5.  Null and empty texts get the score
    of the bias; repeated rows are scored alike; other columns are not read.
    """
    wanted = hashed.first_by_hash(hashed.one_label(labels, id_col, label_col, train), most_labelled)
    weights, bias = fit(hashed.collect_features(docs, wanted, extract, id_col, text_col))
    return hashed.score_texts(docs, scorer(weights, bias), id_col, text_col)


def without_rejected(docs: DataFrame, labels: DataFrame, train, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                     label_col: str = "quality", most_labelled: int = 8000) -> DataFrame:
    """The rows of ``docs`` whose quality score reaches ``threshold``; fitted as in :func:`quality_scores`."""
    wanted = hashed.first_by_hash(hashed.one_label(labels, id_col, label_col, train), most_labelled)
    weights, bias = fit(hashed.collect_features(docs, wanted, extract, id_col, text_col))
    return hashed.keep_scored(docs, scorer(weights, bias), text_col, threshold)


def in_training(ids):
    return hashed.id_remainder(ids, 5) != 0


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), in_training)
    return scored.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
