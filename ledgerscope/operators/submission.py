"""Output contract (K11, K12): one probability per sample id."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import clip


class SubmissionError(AssertionError):
    pass


def build_submission(preds: DataFrame, sample: DataFrame, fill_value: float | None,
                     score: str = S.TARGET) -> DataFrame:
    """Right join of the predictions to the sample id list: exactly the
    sample's ids; missing predictions get ``fill_value`` (train label mean);
    clip to [0, 1]."""
    p = preds.select(S.ID, F.col(score).alias("_p"))
    j = p.join(sample.select(S.ID), S.ID, "right")
    t = F.col("_p") if fill_value is None else F.coalesce(F.col("_p"), F.lit(float(fill_value)))
    return j.select(S.ID, clip(t, 0.0, 1.0).alias(S.TARGET))


def submission_violations(sub: DataFrame, sample: DataFrame) -> DataFrame:
    """One row of violation counts (all must be 0)."""
    ids = sub.select(S.ID)
    smp = sample.select(S.ID).distinct()
    dup = ids.groupBy(S.ID).count().filter(F.col("count") > 1).agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_ids"))
    rng = sub.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(S.TARGET).isNull() | (F.col(S.TARGET) < 0) | (F.col(S.TARGET) > 1))
        .alias("out_of_range"))
    missing = smp.join(ids, S.ID, "left_anti").agg(F.count(F.lit(1)).alias("missing_ids"))
    extra = ids.join(smp, S.ID, "left_anti").agg(F.count(F.lit(1)).alias("extra_ids"))
    n_sample = sample.agg(F.count(F.lit(1)).alias("sample_rows"))
    k = F.lit(1).alias("_k")
    out = rng.select("*", k)
    for t in (dup, missing, extra, n_sample):
        out = out.join(t.select("*", k), "_k")
    bad_cols = 0 if sub.columns == [S.ID, S.TARGET] else 1
    return out.select(
        (F.col("rows") - F.col("sample_rows")).alias("row_count_diff"),
        F.lit(bad_cols).alias("column_mismatch"),
        "duplicate_ids", "out_of_range", "missing_ids", "extra_ids")


def check_submission(sub: DataFrame, sample: DataFrame) -> None:
    row = submission_violations(sub, sample).first().asDict()
    bad = {k: v for k, v in row.items() if v}
    if bad:
        raise SubmissionError(f"submission violates the contract: {bad}")
