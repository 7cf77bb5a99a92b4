"""Null-safe column helpers that reproduce pandas/NumPy semantics under ANSI mode.

pandas propagates NaN through ``clip``/``np.maximum`` while Spark's
``least``/``greatest`` skip nulls; the helpers below keep nulls null.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """``Series.clip(lo, hi)``: null stays null."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def pos_part(c: str | Column) -> Column:
    """``np.maximum(x, 0)`` with NaN/null propagation."""
    return clip(c, lo=0.0)


def flag(cond: Column) -> Column:
    """``(cond).astype(int8)``: a null comparison gives 0, as NaN does in NumPy."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def ratio(num: str | Column, den: str | Column, eps: float) -> Column:
    """``num / (abs(den) + eps)``; the denominator is never 0 for eps > 0."""
    return col(num) / (F.abs(col(den)) + F.lit(eps))


def digits_as_double(c: str | Column) -> Column:
    """``str.extract(r"(\\d+)").astype(float).fillna(0)`` under ANSI casts."""
    extracted = F.regexp_extract(col(c), r"(\d+)", 1)
    return F.coalesce(F.nullif(extracted, F.lit("")).try_cast("double"), F.lit(0.0))


def smooth_rate(count: Column, rate: Column, prior: Column | float, m: float) -> Column:
    """Bayesian smoothing ``(rate*n + prior*m) / (n + m)``."""
    p = prior if isinstance(prior, Column) else F.lit(float(prior))
    return (rate * count + p * F.lit(float(m))) / (count + F.lit(float(m)))


def sigmoid(x: str | Column, bound: float = 50.0) -> Column:
    """Logistic function of the input clipped to +-bound."""
    z = clip(x, -bound, bound)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: str | Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def stable_hash(c: str | Column, seed: int | None = None) -> Column:
    """Portable 32-bit hash: first 8 hex digits of md5 of the string form.

    The same number is obtained in SQL engines that have md5 (the oracle uses
    ``cast('0x' || substr(md5(...), 1, 8) as bigint)``).
    """
    s = col(c).cast("string")
    if seed is not None:
        s = F.concat(s, F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def round_half_up(c: str | Column, digits: int = 6) -> Column:
    """``sign(x) * (floor(|x| * 10^d + 0.5) / 10^d)`` in plain IEEE steps, so any
    engine evaluating the same steps gets the same bits (``round`` differs
    between engines for values one ulp below a tie).  Values of magnitude
    >= 1e12 are returned unchanged; -0.0 becomes 0.0."""
    x = col(c).cast("double")
    scale = F.lit(float(10 ** digits))
    r = F.signum(x) * (F.floor(F.abs(x) * scale + F.lit(0.5)).cast("double") / scale)
    return F.when(F.abs(x) < F.lit(1e12), r).otherwise(x) + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (result comparison form)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_half_up(f.name, digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


TWO_PI = 2.0 * math.pi


def units(c: str | Column, scale: int | None) -> Column:
    """Amount as exact integer units of 10**-scale (or the double itself).  Amounts
    finer than that fail the job; they are never rounded."""
    if scale is None:
        return col(c)
    x = col(c) * F.lit(float(10 ** scale))
    whole = F.round(x)
    # a product of an exact decimal is off by a few units in the last place only
    exact = F.abs(x - whole) <= F.lit(1e-6) + F.abs(x) * F.lit(1e-15)
    finer = F.raise_error(F.lit(f"amounts finer than 10**-{scale}: pass a larger scale, or None for double sums"))
    return F.when(x.isNull() | exact, whole.cast("long")).otherwise(finer.cast("long"))


def from_units(total: Column, scale: int | None) -> Column:
    """Back from a sum of :func:`units` to a double amount."""
    if scale is None:
        return total
    return total.cast("double") / F.lit(float(10 ** scale))


def money_sum(c: str | Column, scale: int | None, window=None) -> Column:
    agg = F.sum(units(c, scale))
    if window is not None:
        agg = agg.over(window)
    return from_units(agg, scale)


def money_mean(c: str | Column, scale: int | None, window=None) -> Column:
    if scale is None:
        agg = F.avg(col(c))
        return agg.over(window) if window is not None else agg
    n = F.count(col(c))
    if window is not None:
        n = n.over(window)
    return money_sum(c, scale, window) / F.nullif(n, F.lit(0)).cast("double")
