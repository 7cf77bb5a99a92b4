"""Causal per-account window features (expanding and rolling).

Order is ``(period, id)``; every "prior" value excludes the current row.

Two physical plans give identical results:

* **plain**: one window spec partitioned by the account; one shuffle per side.
  Used when no account holds more than ``max_rows_per_task`` rows.
* **chunked** (skew-safe): a hot account is cut into chunks
  ``(account, period, sub)`` (``sub`` splits a hot (account, period) group by
  id boundaries taken from a bounded sample).  Chunk totals give exact offsets
  (row number, prior sum / count / max).  Rolling frames then run over blocks of
  ``block_rows`` consecutive rows, each block carrying the last ``halo`` rows of
  the previous block, so no task ever holds more than about
  ``max_rows_per_task + block_rows`` rows.

``mode='auto'`` counts rows per account (a partial aggregate) and picks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import clip, from_units, units

DEFAULT_MAX_ROWS_PER_TASK = 1_000_000   # wide rows take about 1 kB each, sorted and held by the window
DEFAULT_BLOCK_ROWS = 500_000

SIDES = {"origin": (S.ORIGIN, "origin", "o_roll"), "dest": (S.DEST, "dest", "d_roll")}

EXPANDING_SUFFIXES = ["txn_rank", "amount_cumsum_prior", "amount_cummean_prior",
                      "amount_cummax_prior", "period_since_last", "period_since_first"]


def rolling_suffixes(windows=S.ROLLING_WINDOWS) -> list:
    out = ["dt_prev", "dt_prev2"]
    for w in windows:
        out += [f"amt_mean_w{w}", f"amt_std_w{w}", f"amt_max_w{w}", f"amt_min_w{w}", f"amt_sum_w{w}"]
    out += ["amt_zscore_w20", "amt_ratio_max20", "burst2", "is_first", "rank"]
    return out


def expanding_names(sides=("origin", "dest")) -> list:
    return [f"{SIDES[s][1]}_{x}" for s in sides for x in EXPANDING_SUFFIXES]


def rolling_names(sides=("origin", "dest"), windows=S.ROLLING_WINDOWS) -> list:
    return [f"{SIDES[s][2]}_{x}" for s in sides for x in rolling_suffixes(windows)]


# --------------------------------------------------------------------------
# primitives computed by either plan
# --------------------------------------------------------------------------
# _r      : 0-based row number within the account
# _sp/_cp : sum / count of non-null amounts before the row
# _mp     : max amount before the row
# _first  : first period of the account
# _lp1/_lp2 : period 1 and 2 rows back;  _la1 : amount 1 row back
# _m{w}.. : rolling stats over rows [-w, -1]


def _rolling_aggs(amount: Column, w_spec, windows, scale) -> list:
    out = []
    for w in windows:
        fr = w_spec.rowsBetween(-w, -1)
        total = from_units(F.sum("_u").over(fr), scale)
        out += [(total / F.nullif(F.count(amount).over(fr), F.lit(0)).cast("double")).alias(f"_mean{w}"),
                F.stddev_samp(amount).over(fr).alias(f"_std{w}"),
                F.max(amount).over(fr).alias(f"_max{w}"),
                F.min(amount).over(fr).alias(f"_min{w}"),
                total.alias(f"_sum{w}")]
    return out


def _plain_primitives(df: DataFrame, acct: str, windows, scale) -> DataFrame:
    w = Window.partitionBy(acct).orderBy(S.PERIOD, S.ID)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(acct)
    a = F.col(S.AMOUNT)
    return df.select("*", units(a, scale).alias("_u")).select(
        "*",
        (F.row_number().over(w) - 1).alias("_r"),
        F.sum("_u").over(prior).alias("_sp"),
        F.count(a).over(prior).alias("_cp"),
        F.max(a).over(prior).alias("_mp"),
        F.min(S.PERIOD).over(whole).alias("_first"),
        F.lag(S.PERIOD, 1).over(w).alias("_lp1"),
        F.lag(S.PERIOD, 2).over(w).alias("_lp2"),
        F.lag(S.AMOUNT, 1).over(w).alias("_la1"),
        *_rolling_aggs(a, w, windows, scale),
    )


def _hot_group_bounds(df: DataFrame, acct: str, max_rows: int) -> DataFrame | None:
    """Id boundaries for (account, period) groups above ``max_rows`` rows.

    There are at most N / max_rows hot groups with N_group / max_rows boundaries
    each.  That grows with the data, so no join here is forced to broadcast:
    Spark does it where the measured size allows.
    """
    counts = df.groupBy(acct, S.PERIOD).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > max_rows)
    n_hot = hot.count()
    if n_hot == 0:
        return None
    # deterministic sample of about 64 ids per wanted boundary
    hot = hot.select(acct, S.PERIOD, "_n",
                     F.ceil(F.col("_n") / F.lit(max_rows)).alias("_parts"))
    rate = F.least(F.lit(1.0), F.col("_parts") * 64.0 / F.col("_n"))
    u = (F.abs(F.xxhash64(F.col(S.ID))) % 1_000_003) / F.lit(1_000_003.0)
    # null-safe: the rows without an account are a group like any other here
    hot = hot.select(F.col(acct).alias("_ka"), F.col(S.PERIOD).alias("_kp"), "_n", "_parts")
    same = F.col(acct).eqNullSafe(F.col("_ka")) & F.col(S.PERIOD).eqNullSafe(F.col("_kp"))
    sampled = df.select(acct, S.PERIOD, S.ID).join(hot, same, "inner").filter(u < rate)
    bounds = sampled.groupBy(acct, S.PERIOD, "_parts").agg(
        F.sort_array(F.collect_list(S.ID)).alias("_ids"))
    # pick parts-1 evenly spaced sampled ids as boundaries
    return bounds.select(
        acct, S.PERIOD,
        F.expr("filter(transform(sequence(1, greatest(_parts - 1, 1)), "
               "i -> try_element_at(_ids, cast(floor(i * size(_ids) / _parts) as int) + 1)), "
               "b -> b is not null)").alias("_bounds"),
    )


def _with_sub(df: DataFrame, acct: str, bounds: DataFrame | None) -> DataFrame:
    """``df`` with the number ``_sub`` of the row's part of its (account, period) group."""
    if bounds is None:
        return df.select("*", F.lit(0).alias("_sub"))
    bounds = bounds.select(F.col(acct).alias("_ka"), F.col(S.PERIOD).alias("_kp"), "_bounds")
    x = df.join(bounds, F.col(acct).eqNullSafe(F.col("_ka")) & F.col(S.PERIOD).eqNullSafe(F.col("_kp")), "left")
    sub = F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(
        F.size(F.filter(F.col("_bounds"), lambda b: b <= F.col(S.ID))))
    return x.select(*df.columns, sub.alias("_sub"))


def _chunked_primitives(df: DataFrame, acct: str, windows, max_rows: int,
                        block_rows: int, scale, counted: DataFrame | None = None) -> DataFrame:
    halo = max(max(windows), 2)
    if block_rows <= halo:
        raise ValueError("block_rows must exceed the largest window")
    # totals need only these columns; from ``counted`` they do not repeat the joins and windows that made ``df``
    counted = (df if counted is None else counted).select(acct, S.PERIOD, S.ID, S.AMOUNT)
    bounds = _hot_group_bounds(counted, acct, max_rows)
    cols = list(df.columns) + ["_u"]
    a = F.col(S.AMOUNT)
    # a struct of nulls equals another, so rows without account or period have their chunk too, and
    # one exchange serves the join and the window
    ck = F.struct(acct, S.PERIOD, "_sub").alias("_ck")
    x = _with_sub(df, acct, bounds).select("*", units(S.AMOUNT, scale).alias("_u"), ck)
    # stage 0: chunk totals (partial aggregation, one row per chunk)
    chunks = _with_sub(counted, acct, bounds).withColumn("_u", units(S.AMOUNT, scale)).groupBy(ck).agg(
        F.count(F.lit(1)).alias("_cn"), F.sum("_u").alias("_cs"),
        F.count(a).alias("_cc"), F.max(a).alias("_cm"))
    account = Window.partitionBy(f"_ck.{acct}")
    wc = account.orderBy(f"_ck.{S.PERIOD}", "_ck._sub").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        "_ck",
        F.coalesce(F.sum("_cn").over(wc), F.lit(0)).alias("_off_n"),
        F.sum("_cs").over(wc).alias("_off_s"),
        F.coalesce(F.sum("_cc").over(wc), F.lit(0)).alias("_off_c"),
        F.max("_cm").over(wc).alias("_off_m"),
        F.min(f"_ck.{S.PERIOD}").over(account).alias("_first"),
    )
    # stage 1: exact row number and expanding prior values inside each chunk
    w1 = Window.partitionBy("_ck").orderBy(S.PERIOD, S.ID)
    p1 = w1.rowsBetween(Window.unboundedPreceding, -1)
    s_in = F.sum("_u").over(p1)
    c_in = F.count(a).over(p1)
    zero = F.lit(0) if scale is not None else F.lit(0.0)
    y = x.join(chunks, "_ck").select(
        *cols,
        (F.col("_off_n") + F.row_number().over(w1) - 1).alias("_r"),
        F.when(F.col("_off_c") + c_in > 0,
               F.coalesce(F.col("_off_s"), zero) + F.coalesce(s_in, zero)).alias("_sp"),
        (F.col("_off_c") + c_in).alias("_cp"),
        F.greatest(F.col("_off_m"), F.max(a).over(p1)).alias("_mp"),
        F.col("_first"),
    )
    # stage 2: blocks of consecutive rows, each with a halo of the previous rows
    blk = F.floor(F.col("_r") / F.lit(block_rows))
    own, next_too = F.struct(blk.alias("_blk"), F.lit(False).alias("_halo")), F.struct((blk + 1).alias("_blk"), F.lit(True).alias("_halo"))
    ends = F.col("_r") % F.lit(block_rows) >= F.lit(block_rows - halo)
    z = y.select("*", F.explode(F.when(ends, F.array(own, next_too)).otherwise(F.array(own))).alias("_b")).select(*y.columns, "_b.*")
    w2 = Window.partitionBy(acct, "_blk").orderBy("_r")
    out = z.select(
        "*",
        F.lag(S.PERIOD, 1).over(w2).alias("_lp1"),
        F.lag(S.PERIOD, 2).over(w2).alias("_lp2"),
        F.lag(S.AMOUNT, 1).over(w2).alias("_la1"),
        *_rolling_aggs(a, w2, windows, scale),
    )
    return out.filter(~F.col("_halo")).drop("_blk", "_halo")


def _max_rows_per_account(df: DataFrame, accts: list) -> int:
    parts = [df.select(F.col(c).alias("_a"), F.lit(i).alias("_s")) for i, c in enumerate(accts)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    row = u.groupBy("_s", "_a").count().agg(F.max("count")).first()
    return int(row[0] or 0)


def _primitives(df: DataFrame, acct: str, windows, mode: str, max_rows: int,
                block_rows: int, scale, counted: DataFrame | None = None) -> DataFrame:
    if mode == "plain":
        return _plain_primitives(df, acct, windows, scale)
    return _chunked_primitives(df, acct, windows, max_rows, block_rows, scale, counted)


def _choose_mode(df: DataFrame, accts: list, mode: str, max_rows: int) -> str:
    if mode in ("plain", "chunked"):
        return mode
    return "chunked" if _max_rows_per_account(df, accts) > max_rows else "plain"


def _finish_side(prims: DataFrame, keep: list, side: str, windows, expanding: bool,
                 rolling: bool, scale) -> DataFrame:
    _, eprefix, rprefix = SIDES[side]
    p = F.col(S.PERIOD)
    cols = []
    if expanding:
        # cumsum().shift(1): null when the previous amount is null
        sp = from_units(F.col("_sp"), scale)
        cumsum_prior = F.when(F.col("_la1").isNotNull(), sp)
        cols += [
            F.col("_r").cast("long").alias(f"{eprefix}_txn_rank"),
            F.coalesce(cumsum_prior, F.lit(0.0)).alias(f"{eprefix}_amount_cumsum_prior"),
            F.coalesce(sp / F.nullif(F.col("_cp"), F.lit(0)).cast("double"), F.lit(0.0))
            .alias(f"{eprefix}_amount_cummean_prior"),
            F.coalesce(F.col("_mp"), F.lit(0.0)).alias(f"{eprefix}_amount_cummax_prior"),
            F.coalesce(p - F.col("_lp1"), F.lit(0)).cast("long").alias(f"{eprefix}_period_since_last"),
            (p - F.col("_first")).cast("long").alias(f"{eprefix}_period_since_first"),
        ]
    if rolling:
        neg1 = F.lit(-1.0)
        cols += [
            F.coalesce((p - F.col("_lp1")).cast("double"), neg1).alias(f"{rprefix}_dt_prev"),
            F.coalesce((p - F.col("_lp2")).cast("double"), neg1).alias(f"{rprefix}_dt_prev2"),
        ]
        for w in windows:
            cols += [
                F.coalesce(F.col(f"_mean{w}"), neg1).alias(f"{rprefix}_amt_mean_w{w}"),
                F.coalesce(F.col(f"_std{w}"), F.lit(0.0)).alias(f"{rprefix}_amt_std_w{w}"),
                F.coalesce(F.col(f"_max{w}"), neg1).alias(f"{rprefix}_amt_max_w{w}"),
                F.coalesce(F.col(f"_min{w}"), neg1).alias(f"{rprefix}_amt_min_w{w}"),
                F.coalesce(F.col(f"_sum{w}"), neg1).alias(f"{rprefix}_amt_sum_w{w}"),
            ]
        a = F.col(S.AMOUNT)
        z = (a - F.col("_mean20")) / (F.coalesce(F.col("_std20"), F.lit(0.0)) + F.lit(1.0))
        esc = a / clip(F.col("_max20"), lo=1.0)
        cols += [
            F.coalesce(clip(z, -50.0, 50.0), neg1).alias(f"{rprefix}_amt_zscore_w20"),
            F.coalesce(clip(esc, 0.0, 1e4), neg1).alias(f"{rprefix}_amt_ratio_max20"),
            F.coalesce(((p - F.col("_lp1")) <= 2).cast("int"), F.lit(0)).cast("double")
            .alias(f"{rprefix}_burst2"),
            (F.col("_r") == 0).cast("int").cast("double").alias(f"{rprefix}_is_first"),
            F.col("_r").cast("double").alias(f"{rprefix}_rank"),
        ]
    return prims.select(*keep, *cols)


def add_causal_features(
    df: DataFrame,
    sides=("origin", "dest"),
    expanding: bool = True,
    rolling: bool = True,
    windows=S.ROLLING_WINDOWS,
    mode: str = "auto",
    max_rows_per_task: int = DEFAULT_MAX_ROWS_PER_TASK,
    block_rows: int = DEFAULT_BLOCK_ROWS,
    amount_scale: int | None = S.AMOUNT_SCALE,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add expanding (F1/F2) and/or rolling (F3-F9) features for the given sides.

    The sides are chained on one DataFrame (no join by id): each side costs one
    shuffle in the plain plan.  ``20`` must be among ``windows`` for the z-score
    and escalation columns when ``rolling``.  ``counted`` holds the same rows in a
    cheaper form (without columns joined since); the chunked plan counts there.
    """
    windows = tuple(windows)
    if rolling and 20 not in windows:
        raise ValueError("rolling features need the 20-row window")
    accts = [SIDES[s][0] for s in sides]
    chosen = _choose_mode(df, accts, mode, max_rows_per_task)
    out = df
    for s in sides:
        keep = list(out.columns)
        prims = _primitives(out, SIDES[s][0], windows, chosen, max_rows_per_task, block_rows,
                            amount_scale, counted)
        out = _finish_side(prims, keep, s, windows, expanding, rolling, amount_scale)
    return out


def add_expanding_features(df: DataFrame, **kw) -> DataFrame:
    return add_causal_features(df, expanding=True, rolling=False, **kw)


def add_rolling_features(df: DataFrame, **kw) -> DataFrame:
    return add_causal_features(df, expanding=False, rolling=True, **kw)
