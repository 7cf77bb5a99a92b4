"""Registered queries: one Spark job per operator of the inventory, each with
its DuckDB reference statement when the operator is expressible in SQL.

Every query reads the driver tables (``events``) through the transaction
adapter, so its work grows with the data.  Outputs round doubles to 6 digits
(the comparison form); the library functions themselves do not round.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.columns import round_doubles
from ..session import ensure_checkpoint_dir, fits_at_once, materialize, scratch, together
from ..sources import publish as PB
from ..operators import balance as B
from ..operators import causal as C
from ..sources import transactions as TX
from . import boost_queries as BQ
from . import oracle as O
from . import oracle_causal as OC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return deco


def _tx(spark, sf_dir):
    return TX.load_transactions(spark, sf_dir)


def _train(spark, sf_dir):
    return TX.load_train_test(spark, sf_dir)[0]


TX_COLS = [S.ID, S.PERIOD, S.OPERATION, S.AMOUNT, S.ORIGIN, S.OB_BEFORE, S.OB_AFTER,
           S.DEST, S.DB_BEFORE, S.DB_AFTER, S.LABEL]

# ---------------------------------------------------------------- sources (A1)


@register("load_transactions", O.with_tx(
    "SELECT id, period, operation, " + O.r6("amount", "amount") + ", origin_account, "
    + O.r6("origin_balance_before", "origin_balance_before") + ", "
    + O.r6("origin_balance_after", "origin_balance_after") + ", destination_account, "
    + O.r6("destination_balance_before", "destination_balance_before") + ", "
    + O.r6("destination_balance_after", "destination_balance_after") + ", fraud_flag FROM train"))
def q_load_transactions(spark, sf_dir):
    """A1: labelled train transactions with the fixed schema."""
    return _train(spark, sf_dir).select(*TX_COLS)


# ------------------------------------------------------- projections (B1, B2)

_BAL_SQL = [
    ("amount_log1p", "ln(1 + CASE WHEN amount IS NULL THEN NULL ELSE greatest(amount, 0.0) END)", True),
    ("amount_sqrt", "sqrt(CASE WHEN amount IS NULL THEN NULL ELSE greatest(amount, 0.0) END)", True),
    ("origin_balance_change", "origin_balance_after - origin_balance_before", True),
    ("destination_balance_change", "destination_balance_after - destination_balance_before", True),
    ("origin_expected_debit", "origin_balance_before - origin_balance_after", True),
    ("dest_expected_credit", "destination_balance_after - destination_balance_before", True),
    ("origin_balance_mismatch", "abs(origin_balance_before - origin_balance_after - amount)", True),
    ("dest_balance_mismatch", "abs(destination_balance_after - destination_balance_before - amount)", True),
    ("amount_to_origin_before", "amount / (abs(origin_balance_before) + 1e-6)", True),
    ("amount_to_destination_before", "amount / (abs(destination_balance_before) + 1e-6)", True),
    ("amount_to_origin_after", "amount / (abs(origin_balance_after) + 1e-6)", True),
    ("amount_to_destination_after", "amount / (abs(destination_balance_after) + 1e-6)", True),
    ("origin_negative_before", "coalesce(CAST(origin_balance_before < 0 AS INTEGER), 0)", False),
    ("origin_negative_after", "coalesce(CAST(origin_balance_after < 0 AS INTEGER), 0)", False),
    ("dest_negative_before", "coalesce(CAST(destination_balance_before < 0 AS INTEGER), 0)", False),
    ("dest_negative_after", "coalesce(CAST(destination_balance_after < 0 AS INTEGER), 0)", False),
    ("origin_unchanged", "coalesce(CAST(origin_balance_after - origin_balance_before = 0 AS INTEGER), 0)", False),
    ("dest_unchanged", "coalesce(CAST(destination_balance_after - destination_balance_before = 0 AS INTEGER), 0)", False),
    ("origin_wiped", "coalesce(CAST(origin_balance_after <= 0 AS INTEGER), 0)", False),
    ("dest_empty_before", "coalesce(CAST(destination_balance_before = 0 AS INTEGER), 0)", False),
    ("dest_empty_after", "coalesce(CAST(destination_balance_after = 0 AS INTEGER), 0)", False),
    ("origin_balance_ratio", "origin_balance_after / (abs(origin_balance_before) + 1e-6)", True),
    ("dest_balance_ratio", "destination_balance_after / (abs(destination_balance_before) + 1e-6)", True),
    ("total_balance_before", "origin_balance_before + destination_balance_before", True),
    ("total_balance_after", "origin_balance_after + destination_balance_after", True),
    ("balance_sum_change", "(origin_balance_after + destination_balance_after) - (origin_balance_before + destination_balance_before)", True),
    ("same_account", "coalesce(CAST(origin_account = destination_account AS INTEGER), 0)", False),
]
_ENC_SQL = [
    ("operation_code", "coalesce(TRY_CAST(nullif(regexp_extract(operation, '(\\d+)', 1), '') AS DOUBLE), 0.0)", True),
    ("period_sin", "sin(2 * pi() * period / 144.0)", True),
    ("period_cos", "cos(2 * pi() * period / 144.0)", True),
]


@register("balance_features", O.with_tx(
    "SELECT id,\n  " + OC.select_list(_BAL_SQL) + "\nFROM tx"))
def q_balance_features(spark, sf_dir):
    """B1: the 27 balance columns per transaction."""
    return B.add_balance_features(_tx(spark, sf_dir)).select(S.ID, *B.BALANCE_COLUMNS)


@register("operation_encoding", O.with_tx(
    "SELECT id,\n  " + OC.select_list(_ENC_SQL) + "\nFROM tx"))
def q_operation_encoding(spark, sf_dir):
    """B2: operation digits and the cyclic period encoding."""
    return B.encode_operation(_tx(spark, sf_dir)).select(S.ID, *B.ENCODING_COLUMNS)


# ------------------------------------------------------ causal windows

def _causal_sql(names: list[str], expanding: bool, rolling: bool) -> str:
    exprs = []
    for side in ("origin", "dest"):
        if expanding:
            exprs += OC.expanding_exprs(side)
        if rolling:
            exprs += OC.rolling_exprs(side)
    chosen = [e for e in exprs if e[0] in set(names)]
    return O.with_tx("SELECT id,\n  " + OC.select_list(chosen) + "\nFROM tx")


def _causal_query(name: str, suffixes: list[str] | None, expanding: bool, rolling: bool, **plan):
    if expanding:
        names = C.expanding_names()
    else:
        names = [n for n in C.rolling_names() if suffixes is None or n.split("_roll_", 1)[1] in suffixes]

    @register(name, _causal_sql(names, expanding, rolling))
    def q(spark, sf_dir):
        out = C.add_causal_features(_tx(spark, sf_dir), expanding=expanding, rolling=rolling, **plan)
        return out.select(S.ID, *names)
    q.__doc__ = f"{name}: causal per-account window features ({', '.join(names[:3])}...)"
    return q


_causal_query("expanding_features", None, True, False)
_causal_query("inter_event_time", ["dt_prev", "dt_prev2"], False, True)
_causal_query("rolling_features", [s for s in C.rolling_suffixes() if s.startswith("amt_")
                                   and s[4:].split("_w")[0] in ("mean", "std", "max", "min", "sum")],
              False, True)
_causal_query("rolling_zscore", ["amt_zscore_w20"], False, True)
_causal_query("rolling_escalation", ["amt_ratio_max20"], False, True)
_causal_query("burst_flag", ["burst2"], False, True)
_causal_query("first_seen", ["is_first", "rank"], False, True)
_causal_query("rolling_all", None, False, True)
# the same results by the plan for hot accounts, cut small enough to be used on every table
_HOT_PLAN = {"mode": "chunked", "max_rows_per_task": 40, "block_rows": 64}
_causal_query("expanding_features_chunked", None, True, False, **_HOT_PLAN)
_causal_query("rolling_all_chunked", None, False, True, **_HOT_PLAN)


# ------------------------------------------------------------ aggregates (E*)
from ..operators import aggregates as A  # noqa: E402
from ..operators import profiles as PR  # noqa: E402
from ..operators import splits as SP  # noqa: E402

_MS = OC.msum("")
_MM = OC.mmean("")


def _side_stats_sql(acct: str, other: str, p: str) -> str:
    return O.with_tx(f"""
SELECT {acct}, count(amount) AS {p}_txn_count,
  {O.r6(_MS, f'{p}_amount_sum')}, {O.r6(_MM, f'{p}_amount_mean')},
  {O.r6('stddev_samp(amount)', f'{p}_amount_std')},
  min(period) AS {p}_period_min, max(period) AS {p}_period_max,
  count(DISTINCT {other}) AS {p}_{'dest_nunique' if p == 'origin' else 'origin_nunique'}
FROM tx WHERE {acct} IS NOT NULL GROUP BY {acct}""")


@register("origin_stats", _side_stats_sql("origin_account", "destination_account", "origin"))
def q_origin_stats(spark, sf_dir):
    """Per-origin count, sum, mean, std, period range, distinct counterparties."""
    return A.origin_stats(_tx(spark, sf_dir))


@register("destination_stats", _side_stats_sql("destination_account", "origin_account", "dest"))
def q_destination_stats(spark, sf_dir):
    """Per-destination mirror of E1."""
    return A.destination_stats(_tx(spark, sf_dir))


@register("operation_stats", O.with_tx(f"""
SELECT operation, count(amount) AS op_count, {O.r6(_MM, 'op_amount_mean')},
  {O.r6('stddev_samp(amount)', 'op_amount_std')}, {O.r6('median(amount)', 'op_amount_median')}
FROM tx WHERE operation IS NOT NULL GROUP BY operation"""))
def q_operation_stats(spark, sf_dir):
    """Per-operation count, mean, std, exact median."""
    return A.operation_stats(_tx(spark, sf_dir))


@register("pair_counts", O.with_tx("""
SELECT origin_account, destination_account, count(*) AS pair_count FROM tx
WHERE origin_account IS NOT NULL AND destination_account IS NOT NULL GROUP BY 1, 2"""))
def q_pair_counts(spark, sf_dir):
    """Rows per (origin, destination)."""
    return A.pair_counts(_tx(spark, sf_dir))


AGG_STATS_CTES = [
    f"""os AS (SELECT origin_account, count(amount) AS n, {_MS} AS s, {_MM} AS m,
  stddev_samp(amount) AS sd, min(period) AS pmin, max(period) AS pmax,
  count(DISTINCT destination_account) AS nu FROM tx WHERE origin_account IS NOT NULL GROUP BY 1)""",
    f"""ds AS (SELECT destination_account, count(amount) AS n, {_MS} AS s, {_MM} AS m,
  stddev_samp(amount) AS sd, min(period) AS pmin, max(period) AS pmax,
  count(DISTINCT origin_account) AS nu FROM tx WHERE destination_account IS NOT NULL GROUP BY 1)""",
    f"""ops AS (SELECT operation, count(amount) AS n, {_MM} AS m, stddev_samp(amount) AS sd,
  median(amount) AS med FROM tx WHERE operation IS NOT NULL GROUP BY 1)""",
    """pc AS (SELECT origin_account, destination_account, count(*) AS n FROM tx
  WHERE origin_account IS NOT NULL AND destination_account IS NOT NULL GROUP BY 1, 2)""",
]
AGG_JOINS = """
LEFT JOIN os ON t.origin_account = os.origin_account
LEFT JOIN ds ON t.destination_account = ds.destination_account
LEFT JOIN ops ON t.operation = ops.operation
LEFT JOIN pc ON t.origin_account = pc.origin_account AND t.destination_account = pc.destination_account"""
AGG_SELECT = [
    ("origin_txn_count", "coalesce(os.n, 0)", False),
    ("origin_amount_sum", "os.s", True), ("origin_amount_mean", "os.m", True),
    ("origin_amount_std", "coalesce(os.sd, 0.0)", True),
    ("origin_period_min", "os.pmin", False), ("origin_period_max", "os.pmax", False),
    ("origin_dest_nunique", "os.nu", False),
    ("dest_txn_count", "coalesce(ds.n, 0)", False),
    ("dest_amount_sum", "ds.s", True), ("dest_amount_mean", "ds.m", True),
    ("dest_amount_std", "coalesce(ds.sd, 0.0)", True),
    ("dest_period_min", "ds.pmin", False), ("dest_period_max", "ds.pmax", False),
    ("dest_origin_nunique", "ds.nu", False),
    ("op_count", "ops.n", False), ("op_amount_mean", "ops.m", True),
    ("op_amount_std", "coalesce(ops.sd, 0.0)", True), ("op_amount_median", "ops.med", True),
    ("pair_count", "coalesce(pc.n, 0)", False),
    ("origin_dest_ratio", "coalesce(os.n, 0) / (coalesce(ds.n, 0) + 1.0)", True),
    ("amount_vs_origin_mean", "t.amount / (coalesce(os.m, 0.0) + 1e-6)", True),
    ("amount_vs_dest_mean", "t.amount / (coalesce(ds.m, 0.0) + 1e-6)", True),
    ("amount_vs_op_mean", "t.amount / (coalesce(ops.m, 0.0) + 1e-6)", True),
    ("origin_period_span", "os.pmax - os.pmin", False),
    ("dest_period_span", "ds.pmax - ds.pmin", False),
]


@register("aggregate_features", O.with_tx(
    "SELECT t.id,\n  " + OC.select_list(AGG_SELECT) + "\nFROM tx t" + AGG_JOINS, *AGG_STATS_CTES))
def q_aggregate_features(spark, sf_dir):
    """E5 (+D1-D3): unsupervised aggregates fitted on all transactions, joined back."""
    tx = _tx(spark, sf_dir)
    return A.add_unsupervised_aggregations(tx, tx).select(S.ID, *A.AGGREGATE_COLUMNS)


# ------------------------------------------------------------ profiles

def _profile_cte(name: str, acct: str) -> str:
    shares = ",\n  ".join(
        f"count_if(operation = '{op}') / greatest(count(operation), 1)::DOUBLE AS share_{op}"
        for op in S.OPERATIONS)
    return f"""{name} AS (SELECT {acct} AS account,
  coalesce(quantile_cont(amount, 0.25), 0.0) AS q25, coalesce(quantile_cont(amount, 0.5), 0.0) AS q50,
  coalesce(quantile_cont(amount, 0.75), 0.0) AS q75, CAST(count(*) AS DOUBLE) AS freq,
  CAST(count(DISTINCT operation) AS DOUBLE) AS nops,
  coalesce(CASE WHEN quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25) IS NULL THEN NULL
           ELSE greatest(quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25), 0.0) END, 0.0) AS iqr,
  {shares}
  FROM tx WHERE {acct} IS NOT NULL GROUP BY {acct})"""


def _profile_cols_sql(alias: str, prefix: str) -> list:
    out = [(f"{prefix}_amt_q25", f"{alias}.q25", True), (f"{prefix}_amt_q50", f"{alias}.q50", True),
           (f"{prefix}_amt_q75", f"{alias}.q75", True), (f"{prefix}_amt_freq", f"{alias}.freq", True),
           (f"{prefix}_op_nunique", f"{alias}.nops", True), (f"{prefix}_amt_iqr", f"{alias}.iqr", True)]
    out += [(f"{prefix}_share_{op}", f"{alias}.share_{op}", True) for op in S.OPERATIONS]
    return out


@register("account_profile", O.with_tx(
    "SELECT account,\n  " + OC.select_list(_profile_cols_sql("p", "op_orig")) + "\nFROM po p",
    _profile_cte("po", "origin_account")))
def q_account_profile(spark, sf_dir):
    """Origin-account amount quartiles, frequency, operations, IQR, shares."""
    return PR.fit_account_profile(_tx(spark, sf_dir), "origin")


@register("operation_share", O.with_tx(
    "SELECT account,\n  " + OC.select_list(
        [(f"op_dest_share_{op}", f"p.share_{op}", True) for op in S.OPERATIONS]) + "\nFROM pd p",
    _profile_cte("pd", "destination_account")))
def q_operation_share(spark, sf_dir):
    """Destination-side operation-share pivot (explicit operation list)."""
    prof = PR.fit_account_profile(_tx(spark, sf_dir), "dest")
    return prof.select("account", *[f"op_dest_share_{op}" for op in S.OPERATIONS])


def _profile_apply_select() -> list:
    o, d = "coalesce(po.q50, 0.0)", "coalesce(pd.q50, 0.0)"
    oi, di = "coalesce(po.iqr, 0.0)", "coalesce(pd.iqr, 0.0)"
    cols = []
    for alias, prefix in (("po", "op_orig"), ("pd", "op_dest")):
        cols += [(n, f"coalesce({e}, 0.0)", t) for n, e, t in _profile_cols_sql(alias, prefix)]
    cols += [
        ("amt_vs_orig_q50", OC.clip_sql(f"t.amount / ({o} + 1.0)", 0.0, 10000.0), True),
        ("amt_vs_dest_q50", OC.clip_sql(f"t.amount / ({d} + 1.0)", 0.0, 10000.0), True),
        ("amt_orig_iqr_z", OC.clip_sql(f"(t.amount - {o}) / ({oi} + 1.0)", -100.0, 100.0), True),
        ("amt_dest_iqr_z", OC.clip_sql(f"(t.amount - {d}) / ({di} + 1.0)", -100.0, 100.0), True),
        ("op_orig_amt_freq_log1p", "ln(1 + coalesce(po.freq, 0.0))", True),
        ("op_dest_amt_freq_log1p", "ln(1 + coalesce(pd.freq, 0.0))", True),
    ]
    return cols


PROFILE_CTES = [_profile_cte("po", "origin_account"), _profile_cte("pd", "destination_account")]
PROFILE_JOINS = """
LEFT JOIN po ON t.origin_account = po.account
LEFT JOIN pd ON t.destination_account = pd.account"""


@register("account_profile_apply", O.with_tx(
    "SELECT t.id,\n  " + OC.select_list(_profile_apply_select()) + "\nFROM tx t" + PROFILE_JOINS,
    *PROFILE_CTES))
def q_account_profile_apply(spark, sf_dir):
    """E8 (+D5): profile joins and deviation features per transaction."""
    tx = _tx(spark, sf_dir)
    po, pd_ = PR.fit_account_profile(tx, "origin"), PR.fit_account_profile(tx, "dest")
    out = PR.apply_account_profiles(tx, po, pd_)
    return out.select(S.ID, *PR.profile_columns("op_orig"), *PR.profile_columns("op_dest"),
                      *PR.PROFILE_DERIVED)


# ------------------------------------------------------- EDA, weights, describe

@register("edge_list", O.with_tx(f"""
SELECT origin_account, destination_account, {O.r6(_MS, 'weight')}, count(amount) AS count
FROM tx WHERE origin_account IS NOT NULL AND destination_account IS NOT NULL GROUP BY 1, 2"""))
def q_edge_list(spark, sf_dir):
    """Amount-weighted directed edge list."""
    return A.edge_list(_tx(spark, sf_dir))


@register("eda_summary", O.with_tx(f"""
SELECT
  (SELECT count(*) FROM train) AS train_rows,
  (SELECT min(period) FROM train) AS train_period_min,
  (SELECT max(period) FROM train) AS train_period_max,
  (SELECT {O.r6('avg(fraud_flag)')} FROM train) AS fraud_rate,
  (SELECT CAST(sum((id IS NULL)::INT + (period IS NULL)::INT + (operation IS NULL)::INT + (amount IS NULL)::INT
     + (origin_account IS NULL)::INT + (origin_balance_before IS NULL)::INT + (origin_balance_after IS NULL)::INT
     + (destination_account IS NULL)::INT + (destination_balance_before IS NULL)::INT
     + (destination_balance_after IS NULL)::INT + (fraud_flag IS NULL)::INT) AS BIGINT) FROM train) AS train_missing,
  (SELECT string_agg(operation, ',' ORDER BY operation) FROM (SELECT DISTINCT operation FROM train WHERE operation IS NOT NULL)) AS train_operations,
  (SELECT count(DISTINCT origin_account) FROM train) AS origin_accounts_train,
  (SELECT count(DISTINCT destination_account) FROM train) AS dest_accounts_train,
  (SELECT count(*) FROM test) AS test_rows,
  (SELECT min(period) FROM test) AS test_period_min,
  (SELECT max(period) FROM test) AS test_period_max,
  (SELECT CAST(sum((id IS NULL)::INT + (period IS NULL)::INT + (operation IS NULL)::INT + (amount IS NULL)::INT
     + (origin_account IS NULL)::INT + (origin_balance_before IS NULL)::INT + (origin_balance_after IS NULL)::INT
     + (destination_account IS NULL)::INT + (destination_balance_before IS NULL)::INT
     + (destination_balance_after IS NULL)::INT) AS BIGINT) FROM test) AS test_missing,
  (SELECT count(DISTINCT origin_account) FROM test) AS origin_accounts_test,
  (SELECT count(DISTINCT destination_account) FROM test) AS dest_accounts_test,
  (SELECT count(*) FROM (SELECT DISTINCT origin_account FROM train WHERE origin_account IS NOT NULL
     INTERSECT SELECT DISTINCT origin_account FROM test WHERE origin_account IS NOT NULL)) AS accounts_overlap_origin,
  (SELECT count(*) FROM (SELECT DISTINCT destination_account FROM train WHERE destination_account IS NOT NULL
     INTERSECT SELECT DISTINCT destination_account FROM test WHERE destination_account IS NOT NULL)) AS accounts_overlap_dest
"""))
def q_eda_summary(spark, sf_dir):
    """The 16-field EDA report."""
    train, test = TX.load_train_test(spark, sf_dir)
    return A.eda_summary(train, test)


@register("account_overlap", O.with_tx("""
SELECT
  (SELECT count(*) FROM (SELECT DISTINCT origin_account FROM train WHERE origin_account IS NOT NULL
     INTERSECT SELECT DISTINCT origin_account FROM test WHERE origin_account IS NOT NULL)) AS accounts_overlap_origin,
  (SELECT count(*) FROM (SELECT DISTINCT destination_account FROM train WHERE destination_account IS NOT NULL
     INTERSECT SELECT DISTINCT destination_account FROM test WHERE destination_account IS NOT NULL)) AS accounts_overlap_dest
"""))
def q_account_overlap(spark, sf_dir):
    """Accounts present in both train and test, per side."""
    train, test = TX.load_train_test(spark, sf_dir)
    return A.account_overlap(train, test)


@register("class_weight", O.with_tx(f"""
SELECT CAST(sum(fraud_flag) AS BIGINT) AS pos, CAST(count(*) - sum(fraud_flag) AS BIGINT) AS neg,
  {O.r6('(count(*) - sum(fraud_flag)) / greatest(sum(fraud_flag), 1)::DOUBLE', 'scale_pos_weight')}
FROM train"""))
def q_class_weight(spark, sf_dir):
    """Negative / positive ratio of the training labels."""
    return A.class_balance(_train(spark, sf_dir))


SCORED_CTE = """scored AS (
  SELECT id, period, operation, fraud_flag,
    ((id * 7919) % 997) / 2000.0 + 0.3 * fraud_flag AS p_a,
    ((id * 104729) % 991) / 2000.0 + 0.2 * fraud_flag AS p_b,
    CASE WHEN amount IS NULL THEN NULL ELSE least(amount, 500.0) END / 1000.0 AS p_c,
    8 * (((id * 7919) % 997) / 2000.0 + 0.3 * fraud_flag) - 4 AS x
  FROM tx)"""


def _scored(spark, sf_dir):
    return TX.scored_rows(_tx(spark, sf_dir))


@register("score_describe", O.with_tx(f"""
SELECT count(p_a) AS count, {O.r6('avg(p_a)', 'mean')}, {O.r6('stddev_samp(p_a)', 'std')},
  {O.r6('min(p_a)', 'min')}, {O.r6('quantile_cont(p_a, 0.25)', 'q25')},
  {O.r6('quantile_cont(p_a, 0.5)', 'q50')}, {O.r6('quantile_cont(p_a, 0.75)', 'q75')},
  {O.r6('max(p_a)', 'max')}
FROM scored""", SCORED_CTE))
def q_score_describe(spark, sf_dir):
    """describe() of a score column with exact quartiles."""
    return A.describe_column(_scored(spark, sf_dir), "p_a")


# ------------------------------------------------------------ splits

@register("temporal_split", O.with_tx(
    "SELECT id, CASE WHEN period < 96 THEN 'train' ELSE 'valid' END AS role FROM train"))
def q_temporal_split(spark, sf_dir):
    """Temporal holdout roles at cutoff 96."""
    return SP.temporal_roles(_train(spark, sf_dir)).select(S.ID, "role")


def _fold_sql(bounded: bool) -> str:
    valid = "period >= c.cutoff AND period < c.cutoff + 6" if bounded else "period >= c.cutoff"
    kept = ("train_rows > 0 AND valid_rows > 0" if bounded
            else "valid_rows >= 1000 AND train_pos >= 10")
    return O.with_tx(f"""
SELECT cutoff, train_rows, valid_rows, train_pos, valid_pos, ({kept}) AS kept FROM (
  SELECT c.cutoff,
    CAST(count_if(period < c.cutoff) AS BIGINT) AS train_rows,
    CAST(count_if({valid}) AS BIGINT) AS valid_rows,
    CAST(coalesce(sum(CASE WHEN period < c.cutoff THEN fraud_flag END), 0) AS BIGINT) AS train_pos,
    CAST(coalesce(sum(CASE WHEN {valid} THEN fraud_flag END), 0) AS BIGINT) AS valid_pos
  FROM train, (SELECT unnest([75, 81, 87, 93, 99]) AS cutoff) c
  GROUP BY c.cutoff)""")


@register("rolling_folds_open", _fold_sql(False))
def q_rolling_folds_open(spark, sf_dir):
    """Open-ended rolling folds with the size / positives skip rule."""
    return SP.rolling_summary(_train(spark, sf_dir))


@register("rolling_folds_bounded", _fold_sql(True))
def q_rolling_folds_bounded(spark, sf_dir):
    """Rolling folds whose valid part is [cutoff, cutoff + 6)."""
    return SP.rolling_summary(_train(spark, sf_dir), width=S.BOUNDED_FOLD_WIDTH, require_nonempty=True)


def _hash_rank_cte(name: str, key_sql: str, src: str, seed: int = S.RANDOM_STATE) -> str:
    return f"""{name} AS (SELECT acct, row_number() OVER (ORDER BY h, acct) - 1 AS pos, count(*) OVER () AS n
  FROM (SELECT acct, {O.md5_hash('acct', seed)} AS h FROM
        (SELECT DISTINCT {key_sql} AS acct FROM {src} WHERE {key_sql} IS NOT NULL)))"""


@register("group_split", O.with_tx("""
SELECT t.id, CASE WHEN g.pos < ceil(0.15 * g.n) THEN 'valid' ELSE 'train' END AS role
FROM train t JOIN g ON t.origin_account = g.acct""", _hash_rank_cte("g", "origin_account", "train")))
def q_group_split(spark, sf_dir):
    """C4: about 15% of origin accounts (hash order) held out."""
    return SP.group_roles(_train(spark, sf_dir)).select(S.ID, "role")


@register("stratified_group_folds", O.with_tx(f"""
SELECT origin_account, CAST(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS INTEGER) AS fold
FROM (SELECT origin_account, row_number() OVER (ORDER BY pos DESC, n DESC, h, origin_account) - 1 AS i
      FROM (SELECT origin_account, count(*) AS n, sum(fraud_flag) AS pos,
                   {O.md5_hash('origin_account', S.RANDOM_STATE)} AS h
            FROM train WHERE origin_account IS NOT NULL GROUP BY origin_account))"""))
def q_stratified_group_folds(spark, sf_dir):
    """Stratified group 5-fold over origin accounts (snake dealing)."""
    return SP.stratified_group_folds(_train(spark, sf_dir))


@register("stratified_folds", O.with_tx(f"""
SELECT id, CAST((row_number() OVER (PARTITION BY fraud_flag ORDER BY h, id) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT id, fraud_flag, {O.md5_hash('id', S.RANDOM_STATE)} AS h FROM train)"""))
def q_stratified_folds(spark, sf_dir):
    """Stratified 5-fold over rows (no groups)."""
    return SP.stratified_folds(_train(spark, sf_dir))


@register("account_sample", O.with_tx("""
SELECT id, split FROM (SELECT id, origin_account, 'train' AS split FROM train
                       UNION ALL SELECT id, origin_account, 'test' AS split FROM test) t
JOIN s ON t.origin_account = s.acct WHERE s.pos < greatest(CAST(floor(s.n * 0.25) AS BIGINT), 1)""",
    _hash_rank_cte("s", "origin_account",
                   "(SELECT origin_account FROM train UNION ALL SELECT origin_account FROM test)")))
def q_account_sample(spark, sf_dir):
    """25% of origin accounts of train and test, all their rows."""
    train, test = TX.load_train_test(spark, sf_dir)
    tr, te = SP.account_sample(train, test)
    return (tr.select(S.ID, F.lit("train").alias("split"))
            .unionByName(te.select(S.ID, F.lit("test").alias("split"))))


SUBSAMPLE_ROWS = 500


@register("row_subsample", O.with_tx(f"""
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {O.md5_hash('id', S.RANDOM_STATE)}, id) AS r FROM tx)
WHERE r <= {SUBSAMPLE_ROWS}"""))
def q_row_subsample(spark, sf_dir):
    """The first rows in hash order, fewer than the table has."""
    return SP.row_subsample(_tx(spark, sf_dir), SUBSAMPLE_ROWS).select(S.ID)


@register("operation_filter", O.with_tx(
    f"SELECT id, period, {O.r6('amount', 'amount')}, fraud_flag FROM train WHERE operation = 'op_03'"))
def q_operation_filter(spark, sf_dir):
    """The op_03 rows of train (fails if too few rows / positives)."""
    return SP.operation_filter(_train(spark, sf_dir)).select(S.ID, S.PERIOD, S.AMOUNT, S.LABEL)


@register("combine_splits", O.with_tx("""
SELECT id, period, 'train' AS split, fraud_flag FROM train
UNION ALL SELECT id, period, 'test' AS split, CAST(NULL AS INTEGER) AS fraud_flag FROM test"""))
def q_combine_splits(spark, sf_dir):
    """Union by name with a split tag; the test label is null."""
    train, test = TX.load_train_test(spark, sf_dir)
    return SP.combine_splits(train, ("test", test)).select(S.ID, S.PERIOD, S.SPLIT, S.LABEL)


@register("ordered_transactions", O.with_tx(
    "SELECT id, row_number() OVER (ORDER BY period, id) - 1 AS pos FROM tx"))
def q_ordered_transactions(spark, sf_dir):
    """Position of every transaction in the (period, id) order (parallel sort)."""
    from ..operators.ordered import global_positions
    return global_positions(_tx(spark, sf_dir).select(S.ID, S.PERIOD), [S.PERIOD, S.ID]).select(S.ID, "pos")


@register("preview", O.with_tx(
    "SELECT id, period, operation, " + O.r6("amount", "amount") + ", origin_account, destination_account, fraud_flag "
    "FROM train ORDER BY id LIMIT 5"))
def q_preview(spark, sf_dir):
    """S3: first rows of train in id order (limit is the feature)."""
    return (_train(spark, sf_dir).orderBy(S.ID).limit(5)
            .select(S.ID, S.PERIOD, S.OPERATION, S.AMOUNT, S.ORIGIN, S.DEST, S.LABEL))


# ------------------------------------------------------ target encoding (H1-H4)
from ..functions.columns import logit, stable_hash  # noqa: E402,F401
from ..operators import encoding as EN  # noqa: E402
from ..operators import fusion as FU  # noqa: E402
from ..operators import graph as G  # noqa: E402
from ..operators import metrics as M  # noqa: E402
from ..operators import folds as FO  # noqa: E402
from ..operators import submission as SU  # noqa: E402
from ..operators.ordered import rank_pct as _rank_pct  # noqa: E402
from . import oracle_graph as OG  # noqa: E402

_TE_KEYS = [("operation", "operation"), ("origin_account", "origin_account"),
            ("destination_account", "destination_account")]


def _te_fit_ctes(src: str = "train") -> list:
    ctes = [f"tprior AS (SELECT avg(fraud_flag) AS prior FROM {src})"]
    for c, _ in _TE_KEYS:
        ctes.append(f"""te_{c} AS (SELECT {c} AS k, (s / n * n + (SELECT prior FROM tprior) * 50.0) / (n + 50.0) AS rate
  FROM (SELECT {c}, CAST(sum(fraud_flag) AS DOUBLE) AS s, CAST(count(fraud_flag) AS DOUBLE) AS n
        FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}))""")
    return ctes


@register("target_encoding_fit", O.with_tx(
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(k AS VARCHAR) AS key, {O.r6('rate', 'rate')} FROM te_{c}"
                       for c, _ in _TE_KEYS)
    + " UNION ALL SELECT '__global__' AS column_name, CAST(NULL AS VARCHAR) AS key, "
    + O.r6("prior", "rate") + " FROM tprior", *_te_fit_ctes()))
def q_target_encoding_fit(spark, sf_dir):
    """H1/H2: smoothed (m = 50) label rate per operation / origin / destination, plus the prior."""
    maps, prior = EN.fit_target_encoding(_train(spark, sf_dir))
    parts = [mp.select(F.lit(c).alias("column_name"), F.col("key").cast("string").alias("key"), "rate")
             for c, mp in maps.items()]
    glob = _train(spark, sf_dir).agg(F.avg(S.LABEL).alias("rate")).select(
        F.lit("__global__").alias("column_name"), F.lit(None).cast("string").alias("key"), "rate")
    out = parts[0]
    for p in parts[1:] + [glob]:
        out = out.unionByName(p)
    return out


def _sgkf_cte(src: str = "train") -> str:
    return f"""tf AS (SELECT origin_account, CAST(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS INTEGER) AS fold
FROM (SELECT origin_account, row_number() OVER (ORDER BY pos DESC, n DESC, h, origin_account) - 1 AS i
      FROM (SELECT origin_account, count(*) AS n, sum(fraud_flag) AS pos,
                   {O.md5_hash('origin_account', S.RANDOM_STATE)} AS h
            FROM {src} WHERE origin_account IS NOT NULL GROUP BY origin_account)))"""


def _oof_ctes(src: str = "train") -> list:
    ctes = [_sgkf_cte(src),
            f"tx_f AS (SELECT t.*, coalesce(tf.fold, CAST({O.md5_hash('id', S.RANDOM_STATE)} % 5 AS INTEGER)) AS fold "
            f"FROM {src} t LEFT JOIN tf ON t.origin_account = tf.origin_account)",
            """tfp AS (SELECT fold, (tot.s - CAST(sum(fraud_flag) AS DOUBLE)) / (tot.n - CAST(count(fraud_flag) AS DOUBLE)) AS fprior
  FROM tx_f, (SELECT CAST(sum(fraud_flag) AS DOUBLE) AS s, CAST(count(fraud_flag) AS DOUBLE) AS n FROM tx_f) tot
  GROUP BY fold, tot.s, tot.n)"""]
    for c, _ in _TE_KEYS:
        ctes.append(f"""kf_{c} AS (SELECT {c} AS k, fold, CAST(sum(fraud_flag) AS DOUBLE) AS s, CAST(count(fraud_flag) AS DOUBLE) AS n
  FROM tx_f WHERE {c} IS NOT NULL GROUP BY 1, 2)""")
        ctes.append(f"""oe_{c} AS (SELECT kf.k, kf.fold, kt.s - kf.s AS s, kt.n - kf.n AS n FROM kf_{c} kf
  JOIN (SELECT k, sum(s) AS s, sum(n) AS n FROM kf_{c} GROUP BY k) kt ON kf.k = kt.k)""")
    return ctes


def _oof_select() -> str:
    cols = []
    joins = ""
    for c, _ in _TE_KEYS:
        e = (f"CASE WHEN coalesce(oe_{c}.n, 0.0) > 0 THEN (oe_{c}.s / oe_{c}.n * oe_{c}.n + tfp.fprior * 50.0) "
             f"/ (oe_{c}.n + 50.0) ELSE tfp.fprior END")
        cols.append(O.r6(e, f"{c}_fraud_rate"))
        joins += f"\nLEFT JOIN oe_{c} ON x.{c} = oe_{c}.k AND x.fold = oe_{c}.fold"
    return ("SELECT x.id, x.fold, " + ", ".join(cols) + "\nFROM tx_f x JOIN tfp ON x.fold = tfp.fold" + joins)


@register("target_encoding_oof", O.with_tx(_oof_select(), *_oof_ctes()))
def q_target_encoding_oof(spark, sf_dir):
    """H3: out-of-fold encodings over stratified group folds (leave-fold-out by subtraction)."""
    train = _train(spark, sf_dir)
    folds = SP.stratified_group_folds(train)
    out = EN.oof_target_encoding(train, folds, S.ORIGIN)
    return out.select(S.ID, "fold", *EN.encoded_names())


@register("target_encoding_apply", O.with_tx(
    "SELECT t.id, " + ", ".join(O.r6(f"coalesce(te_{c}.rate, (SELECT prior FROM tprior))", f"{c}_fraud_rate")
                                for c, _ in _TE_KEYS)
    + "\nFROM test t" + "".join(f"\nLEFT JOIN te_{c} ON t.{c} = te_{c}.k" for c, _ in _TE_KEYS),
    *_te_fit_ctes()))
def q_target_encoding_apply(spark, sf_dir):
    """Full-fit maps applied to test rows; unseen keys get the prior."""
    train, test = TX.load_train_test(spark, sf_dir)
    maps, prior = EN.fit_target_encoding(train)
    return EN.apply_target_encoding(test, maps, prior).select(S.ID, *EN.encoded_names())


# ---------------------------------------------------- frequency / starter

_FREQ_CTES = [
    """fo AS (SELECT origin_account AS account, count(*) / (SELECT count(*) FROM train WHERE origin_account IS NOT NULL)::DOUBLE AS freq
  FROM train WHERE origin_account IS NOT NULL GROUP BY 1)""",
    """fd AS (SELECT destination_account AS account, count(*) / (SELECT count(*) FROM train WHERE destination_account IS NOT NULL)::DOUBLE AS freq
  FROM train WHERE destination_account IS NOT NULL GROUP BY 1)""",
]


@register("frequency_encoding", O.with_tx(
    "SELECT t.id, " + O.r6("coalesce(fo.freq, 0.0)", "origin_account_freq") + ", "
    + O.r6("coalesce(fd.freq, 0.0)", "destination_account_freq")
    + "\nFROM test t LEFT JOIN fo ON t.origin_account = fo.account LEFT JOIN fd ON t.destination_account = fd.account",
    *_FREQ_CTES))
def q_frequency_encoding(spark, sf_dir):
    """Share of train rows per account, applied to test (unseen = 0)."""
    train, test = TX.load_train_test(spark, sf_dir)
    fo, fd = A.frequency_table(train, S.ORIGIN), A.frequency_table(train, S.DEST)
    out = B.starter_features(test, fo, fd)
    return out.select(S.ID, "origin_account_freq", "destination_account_freq")


_STARTER_SELECT = [
    ("period", "t.period", False), ("operation", "t.operation", False), ("amount", "t.amount", True),
    ("origin_balance_before", "t.origin_balance_before", True), ("origin_balance_after", "t.origin_balance_after", True),
    ("destination_balance_before", "t.destination_balance_before", True),
    ("destination_balance_after", "t.destination_balance_after", True),
    ("amount_log1p", "ln(1 + CASE WHEN t.amount IS NULL THEN NULL ELSE greatest(t.amount, 0.0) END)", True),
    ("origin_balance_change", "t.origin_balance_after - t.origin_balance_before", True),
    ("destination_balance_change", "t.destination_balance_after - t.destination_balance_before", True),
    ("amount_to_origin_before", "t.amount / (abs(t.origin_balance_before) + 1e-6)", True),
    ("amount_to_destination_before", "t.amount / (abs(t.destination_balance_before) + 1e-6)", True),
    ("origin_account_freq", "coalesce(fo.freq, 0.0)", True),
    ("destination_account_freq", "coalesce(fd.freq, 0.0)", True),
]


@register("starter_features", O.with_tx(
    "SELECT t.id, " + OC.select_list(_STARTER_SELECT)
    + "\nFROM test t LEFT JOIN fo ON t.origin_account = fo.account LEFT JOIN fd ON t.destination_account = fd.account",
    *_FREQ_CTES))
def q_starter_features(spark, sf_dir):
    """The starter projection on test with train-fitted frequencies; accounts dropped."""
    train, test = TX.load_train_test(spark, sf_dir)
    fo, fd = A.frequency_table(train, S.ORIGIN), A.frequency_table(train, S.DEST)
    return B.starter_features(test, fo, fd).select(S.ID, *[n for n, _, _ in _STARTER_SELECT])


# ------------------------------------------------------------- graph

def _graph_side_select(alias: str, p: str, kind: str) -> str:
    rate = "fan_out_rate" if kind == "out" else "fan_in_rate"
    return (f"{alias}.account, {alias}.deg AS {p}_{kind}_degree, {alias}.cnt AS {p}_{kind}_count, "
            f"{O.r6(f'{alias}.s', f'{p}_{kind}_amount_sum')}, {O.r6(f'{alias}.m', f'{p}_{kind}_amount_mean')}, "
            f"{alias}.span AS {p}_period_span, {O.r6(f'{alias}.rate', f'{p}_{rate}')}")


@register("graph_out_stats", O.with_tx("SELECT " + _graph_side_select("go", "o", "out") + " FROM go",
                                       OG.side_stats_cte("go", "origin_account", "destination_account")))
def q_graph_out_stats(spark, sf_dir):
    """G1: out-degree, count, sum, mean, period span, fan-out rate per origin."""
    return G._side_stats(_tx(spark, sf_dir), S.ORIGIN, S.DEST, "o", "out", S.AMOUNT_SCALE)


@register("graph_in_stats", O.with_tx("SELECT " + _graph_side_select("gi", "d", "in") + " FROM gi",
                                      OG.side_stats_cte("gi", "destination_account", "origin_account")))
def q_graph_in_stats(spark, sf_dir):
    """In-degree, count, sum, mean, period span, fan-in rate per destination."""
    return G._side_stats(_tx(spark, sf_dir), S.DEST, S.ORIGIN, "d", "in", S.AMOUNT_SCALE)


@register("reciprocal_pairs", O.with_tx(
    "SELECT 'o' AS side, account, c2 AS cycle2_count FROM gco UNION ALL SELECT 'd' AS side, account, c2 FROM gcd",
    *OG.CYCLE_CTES))
def q_reciprocal_pairs(spark, sf_dir):
    """2-cycle score per origin and per destination (pairs with origin < destination)."""
    o, d = G.reciprocal_pairs(_tx(spark, sf_dir))
    return (o.select(F.lit("o").alias("side"), "account", F.col("o_cycle2_count").alias("cycle2_count"))
            .unionByName(d.select(F.lit("d").alias("side"), "account",
                                  F.col("d_cycle2_count").alias("cycle2_count"))))


PAGERANK_FIXED_ITERS = 20


@register("pagerank_fixed", O.with_tx(f"SELECT node, {O.r6('pagerank', 'pagerank')} FROM gpr",
                                      *OG.pagerank_ctes(PAGERANK_FIXED_ITERS, convergent=False)))
def q_pagerank_fixed(spark, sf_dir):
    """Weighted PageRank, exactly 20 power iterations."""
    ranks, _, _ = G.pagerank(G.edge_weights(_tx(spark, sf_dir)), max_iter=PAGERANK_FIXED_ITERS, tol=None)
    return ranks


@register("pagerank", O.with_tx(f"SELECT node, {O.r6('pagerank', 'pagerank')} FROM gpr",
                                *OG.pagerank_ctes(S.PAGERANK_MAX_ITER, convergent=True)))
def q_pagerank(spark, sf_dir):
    """Weighted PageRank to L1 tolerance N * 1e-6 within 50 iterations (else all 0)."""
    ranks, _, _ = G.pagerank(G.edge_weights(_tx(spark, sf_dir)))
    return ranks


def _graph_apply_ctes() -> list:
    return (OG.pagerank_ctes(S.PAGERANK_MAX_ITER, convergent=True) + OG.CYCLE_CTES + [
        OG.side_stats_cte("go", "origin_account", "destination_account"),
        OG.side_stats_cte("gi", "destination_account", "origin_account"),
        """gfa AS (SELECT t.id,
  coalesce(go.deg, 0) AS o_out_degree, coalesce(go.cnt, 0) AS o_out_count, coalesce(go.s, 0.0) AS o_out_amount_sum,
  coalesce(go.m, 0.0) AS o_out_amount_mean, coalesce(go.span, 0) AS o_period_span, coalesce(go.rate, 0.0) AS o_fan_out_rate,
  coalesce(gco.c2, 0) AS o_cycle2_count, coalesce(po.pagerank, 0.0) AS o_pagerank,
  coalesce(gi.deg, 0) AS d_in_degree, coalesce(gi.cnt, 0) AS d_in_count, coalesce(gi.s, 0.0) AS d_in_amount_sum,
  coalesce(gi.m, 0.0) AS d_in_amount_mean, coalesce(gi.span, 0) AS d_period_span, coalesce(gi.rate, 0.0) AS d_fan_in_rate,
  coalesce(gcd.c2, 0) AS d_cycle2_count, coalesce(pd.pagerank, 0.0) AS d_pagerank
  FROM tx t
  LEFT JOIN go ON t.origin_account = go.account LEFT JOIN gco ON t.origin_account = gco.account
  LEFT JOIN gpr po ON t.origin_account = po.node
  LEFT JOIN gi ON t.destination_account = gi.account LEFT JOIN gcd ON t.destination_account = gcd.account
  LEFT JOIN gpr pd ON t.destination_account = pd.node)""",
        """gfr AS (SELECT *,
  abs((rank() OVER (ORDER BY o_pagerank) - 1 + (count(*) OVER (PARTITION BY o_pagerank) + 1) / 2.0) / count(*) OVER ()
    - (rank() OVER (ORDER BY d_pagerank) - 1 + (count(*) OVER (PARTITION BY d_pagerank) + 1) / 2.0) / count(*) OVER ()) AS graph_pagerank_gap
  FROM gfa)"""])


_GRAPH_DOUBLE = {"o_out_amount_sum", "o_out_amount_mean", "o_fan_out_rate", "o_pagerank", "d_in_amount_sum",
                 "d_in_amount_mean", "d_fan_in_rate", "d_pagerank", "graph_pagerank_gap"}


@register("graph_features_apply", O.with_tx(
    "SELECT id, " + ", ".join(O.r6(c, c) if c in _GRAPH_DOUBLE else c for c in G.GRAPH_COLUMNS) + " FROM gfr",
    *_graph_apply_ctes()))
def q_graph_features_apply(spark, sf_dir):
    """Graph statistics joined per transaction and the PageRank rank gap."""
    tx = _tx(spark, sf_dir)
    o, d = G.fit_graph_features(tx)
    return G.apply_graph_features(tx, o, d).select(S.ID, *G.GRAPH_COLUMNS)


# ------------------------------------------------- metrics and fusion

@register("rank_pct", O.with_tx(
    "SELECT id, " + O.r6("(rank() OVER (ORDER BY p_a) - 1 + (count(*) OVER (PARTITION BY p_a) + 1) / 2.0) "
                         "/ count(*) OVER ()", "rank_pct") + " FROM scored WHERE p_a IS NOT NULL", SCORED_CTE))
def q_rank_pct(spark, sf_dir):
    """rank(pct=True) with averaged ties, distributed."""
    return _rank_pct(_scored(spark, sf_dir), "p_a", "rank_pct").select(S.ID, "rank_pct")


_MODELS = ["p_a", "p_b", "p_c"]
_AP_CTES = [
    SCORED_CTE,
    "apu AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, {m} AS s, fraud_flag AS y FROM scored" for m in _MODELS) + ")",
    "apg AS (SELECT model, s, sum(y) AS tp, count(*) AS n FROM apu WHERE s IS NOT NULL GROUP BY 1, 2)",
    """apc AS (SELECT model, tp, sum(tp) OVER (PARTITION BY model ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS ctp,
  sum(n) OVER (PARTITION BY model ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn,
  sum(tp) OVER (PARTITION BY model) AS P FROM apg)""",
    "apr AS (SELECT model, coalesce(sum(CASE WHEN P > 0 THEN (tp / P) * (ctp / cn) END), 0.0) AS ap FROM apc GROUP BY model)",
]


def _model_scores(spark, sf_dir):
    sc = _scored(spark, sf_dir)
    parts = [sc.select(F.lit(m).alias("model"), F.col(m).alias("score"), S.LABEL) for m in _MODELS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("average_precision", O.with_tx(f"SELECT model, {O.r6('ap', 'ap')} FROM apr", *_AP_CTES))
def q_average_precision(spark, sf_dir):
    """K1: exact step-wise Average Precision per model, ties grouped."""
    return M.average_precision(_model_scores(spark, sf_dir), "score", S.LABEL, ["model"])


_FOCAL_P = "(1.0 / (1.0 + exp(-(CASE WHEN x IS NULL THEN NULL ELSE greatest(least(x, 50.0), -50.0) END))))"
_FOCAL_CTE = f"""fl AS (SELECT id, fraud_flag AS y,
  CASE WHEN fraud_flag = 1 THEN 0.25 ELSE 0.75 END AS a_t,
  CASE WHEN fraud_flag = 1 THEN {_FOCAL_P} ELSE 1.0 - {_FOCAL_P} END AS p_t,
  CASE WHEN fraud_flag = 1 THEN 1.0 ELSE -1.0 END AS sgn FROM scored)"""
_FOCAL_LOG = "ln(greatest(least(p_t, 1.0), 1e-9))"


@register("focal_loss", O.with_tx(
    "SELECT " + O.r6(f"avg(-a_t * pow(1.0 - p_t, 2.0) * {_FOCAL_LOG})", "focal_loss") + " FROM fl",
    SCORED_CTE, _FOCAL_CTE))
def q_focal_loss(spark, sf_dir):
    """K2: mean focal loss (gamma 2, alpha 0.25) of raw scores."""
    return M.focal_loss(_scored(spark, sf_dir), "x")


@register("focal_gradient", O.with_tx(
    "SELECT id, " + O.r6(f"a_t * sgn * pow(1.0 - p_t, 2.0) * (2.0 * p_t * {_FOCAL_LOG} + p_t - 1.0)", "grad")
    + ", " + O.r6(f"greatest(a_t * p_t * pow(1.0 - p_t, 2.0) * ((1.0 - p_t) * (2.0 * {_FOCAL_LOG} + 5.0) "
                  f"- 4.0 * p_t * {_FOCAL_LOG}), 1e-6)", "hess") + " FROM fl", SCORED_CTE, _FOCAL_CTE))
def q_focal_gradient(spark, sf_dir):
    """K3: exact focal-loss gradient and floored hessian per row."""
    g, h = M.focal_gradient("x", S.LABEL)
    return _scored(spark, sf_dir).select(S.ID, g.alias("grad"), h.alias("hess"))


def _logit_sql(c: str) -> str:
    q = f"(CASE WHEN {c} IS NULL THEN NULL ELSE greatest(least({c}, 1.0 - 1e-6), 1e-6) END)"
    return f"ln({q} / (1.0 - {q}))"


@register("logit_scores", O.with_tx(
    "SELECT id, " + ", ".join(O.r6(_logit_sql(m), f"logit_{m}") for m in _MODELS) + " FROM scored", SCORED_CTE))
def q_logit_scores(spark, sf_dir):
    """Logit of clipped probabilities (the stacking inputs)."""
    return _scored(spark, sf_dir).select(S.ID, *[logit(m).alias(f"logit_{m}") for m in _MODELS])


def _ap_table(spark, sf_dir):
    return M.average_precision(_model_scores(spark, sf_dir), "score", S.LABEL, ["model"])


@register("ensemble_weights", O.with_tx(
    "SELECT model, " + O.r6("CASE WHEN sum(ap) OVER () <= 0 THEN 1.0 / count(*) OVER () ELSE ap / sum(ap) OVER () END",
                            "weight") + " FROM apr", *_AP_CTES))
def q_ensemble_weights(spark, sf_dir):
    """K4: blend weights proportional to each model's AP."""
    return FU.ensemble_weights(_ap_table(spark, sf_dir))


def _score_weights(spark, sf_dir) -> dict:
    w = FU.ensemble_weights(_ap_table(spark, sf_dir)).collect()   # one row per model
    return {r["model"]: float(r["weight"]) for r in w}


_W_CTE = "ew AS (SELECT model, CASE WHEN sum(ap) OVER () <= 0 THEN 1.0 / count(*) OVER () ELSE ap / sum(ap) OVER () END AS w FROM apr)"
_BLEND_EXPR = ("(SELECT w FROM ew WHERE model = 'p_a') * p_a + (SELECT w FROM ew WHERE model = 'p_b') * p_b "
               "+ (SELECT w FROM ew WHERE model = 'p_c') * p_c")


@register("blend", O.with_tx(
    "SELECT id, " + O.r6(OC.clip_sql(_BLEND_EXPR, 0.0, 1.0), "blend") + " FROM scored", *_AP_CTES, _W_CTE))
def q_blend(spark, sf_dir):
    """K5: score-weighted linear blend clipped to [0, 1]."""
    return FU.blend(_scored(spark, sf_dir), _score_weights(spark, sf_dir)).select(S.ID, "blend")


_GRID_CTES = [
    SCORED_CTE,
    """cg AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS cand, CAST(a AS DOUBLE) / 10.0 AS w_p_a,
  CAST(b AS DOUBLE) / 10.0 AS w_p_b, CAST(10 - a - b AS DOUBLE) / 10.0 AS w_p_c
  FROM range(0, 11) ra(a), range(0, 11) rb(b) WHERE a + b <= 10)""",
    f"""cs AS (SELECT cand, fraud_flag AS y, {OC.clip_sql('w_p_a * p_a + w_p_b * p_b + w_p_c * p_c', 0.0, 1.0)} AS s
  FROM scored, cg)""",
    "csg AS (SELECT cand, s, sum(y) AS tp, count(*) AS n FROM cs WHERE s IS NOT NULL GROUP BY 1, 2)",
    """csc AS (SELECT cand, tp, sum(tp) OVER (PARTITION BY cand ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS ctp,
  sum(n) OVER (PARTITION BY cand ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn,
  sum(tp) OVER (PARTITION BY cand) AS P FROM csg)""",
    "cap AS (SELECT cand, coalesce(sum(CASE WHEN P > 0 THEN (tp / P) * (ctp / cn) END), 0.0) AS ap FROM csc GROUP BY cand)",
]


@register("blend_weight_search", O.with_tx(
    "SELECT cg.cand, " + ", ".join(O.r6(f"cg.w_{m}", f"w_{m}") for m in _MODELS) + ", "
    + O.r6("coalesce(cap.ap, 0.0)", "ap") + " FROM cg LEFT JOIN cap ON cg.cand = cap.cand", *_GRID_CTES))
def q_blend_weight_search(spark, sf_dir):
    """K6: AP of every simplex-grid weight vector (step 0.1) in one pass."""
    return FU.blend_weight_search(_scored(spark, sf_dir), _MODELS)


@register("blend_best", O.with_tx(
    "SELECT CAST(cand AS INTEGER) AS cand, " + ", ".join(O.r6(f"w_{m}", f"w_{m}") for m in _MODELS) + ", " + O.r6("ap", "ap")
    + " FROM cg JOIN cap USING (cand) QUALIFY row_number() OVER (ORDER BY ap DESC, cand) = 1", *_GRID_CTES))
def q_blend_best(spark, sf_dir):
    """K6: the grid's best weights, with exact APs only for candidates whose bounds can win."""
    search = FU.search_weights(_scored(spark, sf_dir), _MODELS, refinements=0)
    return search.orderBy(F.col("ap").desc_nulls_last(), "cand").limit(1).select("cand", *[f"w_{m}" for m in _MODELS], "ap")


@register("blend_refined")
def q_blend_refined(spark, sf_dir):
    """K6: the continuous search; every candidate with its bounds, exact APs of those that could win."""
    return FU.search_weights(_scored(spark, sf_dir), _MODELS)


@register("ensemble_choice", O.with_tx(
    """SELECT """ + O.r6("o.ap", "ap_optimized") + ", " + O.r6("v.ap", "ap_score_weighted") + """,
  CASE WHEN o.ap >= v.ap THEN 'optimized' ELSE 'score-weighted' END AS chosen
FROM (SELECT max(ap) AS ap FROM cap) o,
     (SELECT coalesce(sum(CASE WHEN P > 0 THEN (tp / P) * (ctp / cn) END), 0.0) AS ap FROM (
        SELECT tp, sum(tp) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS ctp,
               sum(n) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn, sum(tp) OVER () AS P
        FROM (SELECT s, sum(y) AS tp, count(*) AS n FROM (
          SELECT fraud_flag AS y, """ + OC.clip_sql(_BLEND_EXPR, 0.0, 1.0) + """ AS s FROM scored) WHERE s IS NOT NULL GROUP BY s))) v""",
    *_GRID_CTES, *_AP_CTES[1:], _W_CTE))
def q_ensemble_choice(spark, sf_dir):
    """K7: grid-optimised weights unless the score-weighted blend has a higher AP."""
    sc = FU.known_scores(_scored(spark, sf_dir), _MODELS)
    search = FU.blend_weight_search(sc, _MODELS)
    ap_opt = search.agg(F.max("ap").alias("ap_optimized"))
    weights = _score_weights(spark, sf_dir)
    ap_avg = spark.createDataFrame([(FU.exact_aps(sc, _MODELS, S.LABEL, [tuple(weights[m] for m in _MODELS)])[0],)], "ap_score_weighted double")
    k = F.lit(1).alias("_k")
    return (ap_opt.select("*", k).join(ap_avg.select("*", k), "_k").drop("_k")
            .select("*", F.when(F.col("ap_optimized") >= F.col("ap_score_weighted"), "optimized")
                    .otherwise("score-weighted").alias("chosen")))


def _rank_sql(c: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    pp = f"PARTITION BY {part}, {c}" if part else f"PARTITION BY {c}"
    return (f"((rank() OVER ({p}ORDER BY {c}) - 1 + (count(*) OVER ({pp}) + 1) / 2.0) "
            f"/ count(*) OVER ({p.strip()}))")


@register("rank_blend", O.with_tx(
    "SELECT id, " + O.r6(f"0.45::DOUBLE * {_rank_sql('p_a')} + (1.0::DOUBLE - 0.45::DOUBLE) * {_rank_sql('p_b')}",
                         "rank_blend") + " FROM scored", SCORED_CTE))
def q_rank_blend(spark, sf_dir):
    """K8: weighted blend of rank percentiles (w = 0.45)."""
    return FU.rank_blend(_scored(spark, sf_dir), "p_a", "p_b").select(S.ID, "rank_blend")


def _test_scored(spark, sf_dir):
    return _scored(spark, sf_dir).filter(F.col(S.PERIOD) >= S.TEST_PERIOD_START)


@register("operation_prior", O.with_tx(
    "SELECT id, " + O.r6(OC.clip_sql(
        "CASE WHEN (SELECT count_if(operation = 'op_03') > 0 AND count_if(operation IS DISTINCT FROM 'op_03') > 0 "
        "FROM scored WHERE period >= 106) AND operation IS DISTINCT FROM 'op_03' THEN p_a * 0.01 ELSE p_a END",
        0.0, 1.0), "adjusted") + " FROM scored WHERE period >= 106", SCORED_CTE))
def q_operation_prior(spark, sf_dir):
    """K9: shrink non-op_03 test scores by 0.01 when both kinds exist."""
    return FU.operation_prior(_test_scored(spark, sf_dir), "p_a").select(S.ID, "adjusted")


@register("two_stage_scores", O.with_tx(
    """SELECT id, """ + O.r6("fused", "fused") + """ FROM (
  SELECT id, """ + OC.clip_sql(f"0.38::DOUBLE * {_rank_sql('p_a')} + (1.0::DOUBLE - 0.38::DOUBLE) * {_rank_sql('p_b')}", 0.0, 1.0) + """ AS fused
  FROM scored WHERE period >= 106 AND operation = 'op_03'
  UNION ALL
  SELECT id, least(greatest(coalesce(greatest((SELECT min(f) FROM (
      SELECT 0.38::DOUBLE * """ + _rank_sql('p_a') + " + (1.0::DOUBLE - 0.38::DOUBLE) * " + _rank_sql('p_b') + """ AS f
      FROM scored WHERE period >= 106 AND operation = 'op_03')) * 0.05, 1e-8), 1e-8), 0.0), 1.0) AS fused
  FROM scored WHERE period >= 106 AND operation IS DISTINCT FROM 'op_03')""", SCORED_CTE))
def q_two_stage_scores(spark, sf_dir):
    """Rank blend inside op_03 (w = 0.38), floor for the other operations."""
    return FU.two_stage_scores(_test_scored(spark, sf_dir), "p_a", "p_b").select(S.ID, "fused")


# ------------------------------------------------------- submission

_SAMPLE_CTE = "smp AS (SELECT id FROM test WHERE id % 97 <> 0 UNION ALL SELECT * FROM (VALUES (-1), (-2), (-3)) v(id))"
_PRIOR_PRED = ("CASE WHEN (SELECT count_if(operation = 'op_03') > 0 AND count_if(operation IS DISTINCT FROM 'op_03') > 0 "
               "FROM scored WHERE period >= 106) AND operation IS DISTINCT FROM 'op_03' THEN p_a * 0.01 ELSE p_a END")
_SUB_CTE = (f"sub AS (SELECT smp.id, {OC.clip_sql('coalesce(pp.p, (SELECT avg(fraud_flag) FROM train))', 0.0, 1.0)} AS target "
            f"FROM (SELECT id, {OC.clip_sql(_PRIOR_PRED, 0.0, 1.0)} AS p FROM scored WHERE period >= 106) pp "
            "RIGHT JOIN smp ON pp.id = smp.id)")


def _submission(spark, sf_dir):
    train, test = TX.load_train_test(spark, sf_dir)
    preds = FU.operation_prior(_test_scored(spark, sf_dir), "p_a", out=S.TARGET)
    fill = train.agg(F.avg(S.LABEL)).first()[0]
    return SU.build_submission(preds, TX.sample_ids(test), fill), TX.sample_ids(test)


@register("submission", O.with_tx("SELECT id, " + O.r6("target", "target") + " FROM sub",
                                  SCORED_CTE, _SAMPLE_CTE, _SUB_CTE))
def q_submission(spark, sf_dir):
    """Right join to the sample ids, missing ids get the train label mean, clip."""
    return _submission(spark, sf_dir)[0]


_BROKEN_CTE = """brk AS (SELECT id, CASE WHEN id % 30 = 0 THEN target + 1.5 ELSE target END AS target FROM sub WHERE id % 50 <> 1
  UNION ALL SELECT id, target FROM sub WHERE id % 70 = 0
  UNION ALL SELECT id - 1000000 AS id, CAST(NULL AS DOUBLE) AS target FROM sub WHERE id % 90 = 0)"""


def _violations_sql(case: str, sub: str) -> str:
    return f"""SELECT '{case}' AS submission, CAST((SELECT count(*) FROM {sub}) - (SELECT count(*) FROM smp) AS BIGINT) AS row_count_diff,
  0 AS column_mismatch,
  CAST((SELECT coalesce(sum(c - 1), 0) FROM (SELECT id, count(*) AS c FROM {sub} GROUP BY id HAVING count(*) > 1)) AS BIGINT) AS duplicate_ids,
  CAST((SELECT count_if(target IS NULL OR target < 0 OR target > 1) FROM {sub}) AS BIGINT) AS out_of_range,
  (SELECT count(*) FROM (SELECT DISTINCT id FROM smp) s WHERE s.id NOT IN (SELECT id FROM {sub})) AS missing_ids,
  (SELECT count(*) FROM {sub} WHERE id NOT IN (SELECT id FROM smp)) AS extra_ids"""


@register("submission_checks", O.with_tx(_violations_sql("valid", "sub") + "\nUNION ALL\n" + _violations_sql("broken", "brk"),
                                         SCORED_CTE, _SAMPLE_CTE, _SUB_CTE, _BROKEN_CTE))
def q_submission_checks(spark, sf_dir):
    """Violation counts of the output contract, for the submission (all 0)
    and for one with rows dropped, repeated, added and out of range."""
    sub, sample = _submission(spark, sf_dir)
    sub = materialize(sub, "submission")
    i, t = F.col(S.ID), F.col(S.TARGET)
    broken = (sub.filter(i % 50 != 1).select(S.ID, F.when(i % 30 == 0, t + 1.5).otherwise(t).alias(S.TARGET))
              .unionByName(sub.filter(i % 70 == 0))
              .unionByName(sub.filter(i % 90 == 0).select((i - 1000000).alias(S.ID), F.lit(None).cast("double").alias(S.TARGET))))
    return (SU.submission_violations(sub, sample).select(F.lit("valid").alias("submission"), "*")
            .unionByName(SU.submission_violations(broken, sample).select(F.lit("broken").alias("submission"), "*")))


# ------------------------------------------------------------ fingerprint
from ..sources import sinks as SK  # noqa: E402

_FP_COLS = ["id", "period", "operation", "origin_account", "destination_account",
            "CAST(round(amount * 100.0) AS BIGINT)", "CAST(round(origin_balance_before * 100.0) AS BIGINT)",
            "CAST(round(origin_balance_after * 100.0) AS BIGINT)",
            "CAST(round(destination_balance_before * 100.0) AS BIGINT)",
            "CAST(round(destination_balance_after * 100.0) AS BIGINT)", "fraud_flag"]


@register("dataset_fingerprint", O.with_tx(
    "SELECT count(*) AS rows, CAST(sum(" + O.md5_hash("concat_ws('|', " + ", ".join(
        f"CAST({c} AS VARCHAR)" for c in _FP_COLS) + ")") + ") AS BIGINT) AS fingerprint FROM tx"))
def q_dataset_fingerprint(spark, sf_dir):
    """Order-insensitive content fingerprint of the transaction table."""
    return SK.table_fingerprint(_tx(spark, sf_dir), SK.money_canonical_columns())


# ----------------------------------------------------------- feature table (L1)
from . import features as FT  # noqa: E402


def _feature_sql() -> str:
    def raw_block(exprs):
        return ",\n  ".join(f"{e} AS {n}" for n, e, _ in exprs)

    dbl = set()
    for n, _, d in _BAL_SQL + _ENC_SQL + AGG_SELECT + _profile_apply_select():
        if d:
            dbl.add(n)
    causal = []
    for side in ("origin", "dest"):
        causal += OC.rolling_exprs(side) + OC.expanding_exprs(side)
    dbl |= {n for n, _, d in causal if d}
    dbl |= _GRAPH_DOUBLE | {f"{c}_fraud_rate" for c in S.TE_COLUMNS}
    dbl |= {"amount", "origin_balance_before", "origin_balance_after", "destination_balance_before",
            "destination_balance_after"}
    te_oof = []
    te_app = []
    for c, _ in _TE_KEYS:
        te_oof.append(f"CASE WHEN coalesce(oe_{c}.n, 0.0) > 0 THEN (oe_{c}.s / oe_{c}.n * oe_{c}.n + tfp.fprior * 50.0) "
                      f"/ (oe_{c}.n + 50.0) ELSE tfp.fprior END AS {c}_fraud_rate")
        te_app.append(f"coalesce(te_{c}.rate, (SELECT prior FROM tprior)) AS {c}_fraud_rate")
    ctes = list(AGG_STATS_CTES) + list(PROFILE_CTES) + OG.pagerank_ctes(S.PAGERANK_MAX_ITER, True) \
        + list(OG.CYCLE_CTES) + [OG.side_stats_cte("go", "origin_account", "destination_account"),
                                 OG.side_stats_cte("gi", "destination_account", "origin_account")] \
        + _te_fit_ctes() + _oof_ctes() + [
        "cmb AS (SELECT *, CASE WHEN period < 106 THEN 'train' ELSE 'test' END AS split FROM tx)",
        "fb_bal AS (SELECT id,\n  " + raw_block(_BAL_SQL + _ENC_SQL) + "\nFROM tx)",
        "fb_cau AS (SELECT id,\n  " + raw_block(causal) + "\nFROM tx)",
        "fb_agg AS (SELECT t.id,\n  " + raw_block(AGG_SELECT) + "\nFROM tx t" + AGG_JOINS + ")",
        "fb_pro AS (SELECT t.id,\n  " + raw_block(_profile_apply_select()) + "\nFROM tx t" + PROFILE_JOINS + ")",
        """fb_gra0 AS (SELECT t.id, t.split,
  coalesce(go.deg, 0) AS o_out_degree, coalesce(go.cnt, 0) AS o_out_count, coalesce(go.s, 0.0) AS o_out_amount_sum,
  coalesce(go.m, 0.0) AS o_out_amount_mean, coalesce(go.span, 0) AS o_period_span, coalesce(go.rate, 0.0) AS o_fan_out_rate,
  coalesce(gco.c2, 0) AS o_cycle2_count, coalesce(po2.pagerank, 0.0) AS o_pagerank,
  coalesce(gi.deg, 0) AS d_in_degree, coalesce(gi.cnt, 0) AS d_in_count, coalesce(gi.s, 0.0) AS d_in_amount_sum,
  coalesce(gi.m, 0.0) AS d_in_amount_mean, coalesce(gi.span, 0) AS d_period_span, coalesce(gi.rate, 0.0) AS d_fan_in_rate,
  coalesce(gcd.c2, 0) AS d_cycle2_count, coalesce(pd2.pagerank, 0.0) AS d_pagerank
  FROM cmb t
  LEFT JOIN go ON t.origin_account = go.account LEFT JOIN gco ON t.origin_account = gco.account
  LEFT JOIN gpr po2 ON t.origin_account = po2.node
  LEFT JOIN gi ON t.destination_account = gi.account LEFT JOIN gcd ON t.destination_account = gcd.account
  LEFT JOIN gpr pd2 ON t.destination_account = pd2.node)""",
        f"""fb_gra AS (SELECT * EXCLUDE (split),
  coalesce(abs({_rank_sql('o_pagerank', 'split')} - {_rank_sql('d_pagerank', 'split')}), 0.0) AS graph_pagerank_gap
  FROM fb_gra0)""",
        "fb_te AS (SELECT x.id, " + ", ".join(te_oof) + "\nFROM tx_f x JOIN tfp ON x.fold = tfp.fold"
        + "".join(f"\nLEFT JOIN oe_{c} ON x.{c} = oe_{c}.k AND x.fold = oe_{c}.fold" for c, _ in _TE_KEYS)
        + "\nUNION ALL SELECT t.id, " + ", ".join(te_app) + "\nFROM test t"
        + "".join(f"\nLEFT JOIN te_{c} ON t.{c} = te_{c}.k" for c, _ in _TE_KEYS) + ")",
    ]
    names = FT.feature_names(include_iso=False)
    sel = ["t.id", "t.split", "CASE WHEN t.split = 'train' THEN t.fraud_flag END AS fraud_flag",
           "t.origin_account", "t.destination_account"]
    for n in names:
        src = "t." + n if n in S.RAW_FEATURES else n
        sel.append(O.r6(src, n) if n in dbl else f"{src} AS {n}")
    body = ("SELECT " + ",\n  ".join(sel) + "\nFROM cmb t JOIN fb_bal USING (id) JOIN fb_cau USING (id) "
            "JOIN fb_agg USING (id) JOIN fb_pro USING (id) JOIN fb_gra USING (id) JOIN fb_te USING (id)")
    return O.with_tx(body, *ctes)


@register("feature_table", _feature_sql())
def q_feature_table(spark, sf_dir):
    """L1/L2: the feature table of train (OOF encodings) and test (full-fit), 156
    columns (the anomaly score is checked separately by isolation_score)."""
    train, test = TX.load_train_test(spark, sf_dir)
    return FT.build_feature_table(train, test)


# one account after the other, in SQL: the state of the recursion is the folds' negatives and positives
_GREEDY_CTES = [
    f"""acc AS (SELECT origin_account AS account, count(*) AS n, sum(fraud_flag)::BIGINT AS pos, {O.md5_hash('origin_account', S.RANDOM_STATE)} AS h
  FROM train WHERE origin_account IS NOT NULL GROUP BY origin_account)""",
    "line AS (SELECT *, row_number() OVER (ORDER BY abs(n - 2 * pos) DESC, n DESC, pos DESC, h, account) AS i FROM acc)",
    "tot AS (SELECT greatest(sum(n - pos), 1)::HUGEINT AS t0, greatest(sum(pos), 1)::HUGEINT AS t1 FROM acc)",
    """dealt AS (
  SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::HUGEINT[] AS neg, [0, 0, 0, 0, 0]::HUGEINT[] AS pos, 0 AS fold
  UNION ALL
  SELECT i, list_transform(neg, lambda x, j: CASE WHEN j = f THEN x + a ELSE x END), list_transform(pos, lambda x, j: CASE WHEN j = f THEN x + b ELSE x END), f FROM (
    SELECT l.i, d.neg, d.pos, l.n - l.pos AS a, l.pos AS b, (list_sort(list_transform([1, 2, 3, 4, 5], lambda j: {
      'cost': d.neg[j] * (l.n - l.pos) * t1 * t1 + d.pos[j] * l.pos * t0 * t0, 'rows': d.neg[j] + d.pos[j], 'j': j}))[1]).j AS f
    FROM dealt d JOIN line l ON l.i = d.i + 1, tot))""",
    """share AS (SELECT l.n, l.pos, d.fold - 1 AS fold, count(*) AS c, min(l.i) AS i FROM dealt d JOIN line l ON l.i = d.i GROUP BY ALL)""",
    """spans AS (SELECT n, pos, fold, coalesce(sum(c) OVER (PARTITION BY n, pos ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
  sum(c) OVER (PARTITION BY n, pos ORDER BY fold) AS b FROM share)""",
    "placed AS (SELECT *, row_number() OVER (PARTITION BY n, pos ORDER BY h, account) - 1 AS r FROM acc)",
]


@register("greedy_group_folds", O.with_tx(
    "SELECT p.account AS origin_account, CAST(s.fold AS INTEGER) AS fold FROM placed p JOIN spans s ON s.n = p.n AND s.pos = p.pos AND r >= a AND r < b",
    *_GREEDY_CTES).replace("WITH ", "WITH RECURSIVE ", 1))
def q_greedy_group_folds(spark, sf_dir):
    """Folds of origin accounts by greedy balancing of rows and positives."""
    return SP.greedy_group_folds(_train(spark, sf_dir))


# the same statements over transactions that lack some accounts
_NO_ACCOUNTS = [("user_id AS origin_account", "CASE WHEN event_id % 3 <> 0 THEN user_id END AS origin_account"),
                ("k AS destination_account", "CASE WHEN event_id % 4 <> 1 THEN k END AS destination_account")]


def _without_accounts(sql: str) -> str:
    for had, has in _NO_ACCOUNTS:
        assert had in sql
        sql = sql.replace(had, has)
    return sql


def _lacking_accounts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Train and test with a third of the origins and a quarter of the destinations null."""
    gone = {S.ORIGIN: F.when(F.col(S.ID) % 3 != 0, F.col(S.ORIGIN)), S.DEST: F.when(F.col(S.ID) % 4 != 1, F.col(S.DEST))}
    train, test = (df.withColumns(gone) for df in TX.load_train_test(spark, sf_dir))
    return train, test


@register("feature_table_null_accounts", _without_accounts(SQL["feature_table"]))
def q_feature_table_null_accounts(spark, sf_dir):
    """L1/H2/H3: the feature table where rows lack accounts."""
    return FT.build_feature_table(*_lacking_accounts(spark, sf_dir))


@register("target_encoding_oof_null_accounts", _without_accounts(SQL["target_encoding_oof"]))
def q_target_encoding_oof_null_accounts(spark, sf_dir):
    """H3: out-of-fold encodings where rows lack accounts; each id once."""
    train, _ = _lacking_accounts(spark, sf_dir)
    return EN.oof_target_encoding(train, SP.stratified_group_folds(train), S.ORIGIN).select(S.ID, "fold", *EN.encoded_names())


def _fold_stats_sql() -> str:
    cents = "CAST(round(amount * 100.0) AS HUGEINT)"
    total, n = f"CAST(sum({cents}) AS DOUBLE) / 100.0::DOUBLE", "count(amount)"
    spread = f"CAST({n} * sum({cents} * {cents}) - sum({cents}) * sum({cents}) AS DOUBLE) / (CAST({n} AS DOUBLE) * CAST({n} - 1 AS DOUBLE))"
    std = f"CASE WHEN {n} > 1 THEN sqrt({spread}) / 100.0::DOUBLE END"
    parts = []
    for side, account, other in (("origin", S.ORIGIN, S.DEST), ("dest", S.DEST, S.ORIGIN)):
        for f in range(5):
            parts.append(f"SELECT '{side}' AS side, {f} AS fold, {account} AS account, count(*) AS rows, {n} AS txn_count, {O.r6(total, 'amount_sum')}, "
                         f"{O.r6(f'{total} / {n}', 'amount_mean')}, {O.r6(std, 'amount_std')}, min(period) AS period_min, max(period) AS period_max, "
                         f"count(DISTINCT {other}) AS n_counterparts FROM tx_f WHERE fold <> {f} AND {account} IS NOT NULL GROUP BY {account}")
    return " UNION ALL ".join(parts)


@register("fold_aggregates", _without_accounts(O.with_tx(_fold_stats_sql(), *_oof_ctes())))
def q_fold_aggregates(spark, sf_dir):
    """Account statistics of the training rows of every group fold, from one scan per side, where rows lack accounts."""
    train, _ = _lacking_accounts(spark, sf_dir)
    rows = SP.with_folds(train, materialize(SP.stratified_group_folds(train), "folds"))
    parts = [FO.fold_account_stats(FO.fold_pairs(rows, a, o, 5), 5).select(F.lit(side).alias("side"), "fold", "account", "rows", "txn_count", "amount_sum", "amount_mean",
                                                                          "amount_std", "period_min", "period_max", "n_counterparts")
             for side, a, o in (("origin", S.ORIGIN, S.DEST), ("dest", S.DEST, S.ORIGIN))]
    return parts[0].unionByName(parts[1])


_ORDERED_SQL = "SELECT id, " + ", ".join(O.r6(
    f"(coalesce(sum(fraud_flag) OVER {c}_before, 0)::DOUBLE + (SELECT avg(fraud_flag) FROM train)) / (count(fraud_flag) OVER {c}_before + 1.0::DOUBLE)",
    f"{c}_ordered_rate") for c in S.TE_COLUMNS) + " FROM train WINDOW " + ", ".join(
    f"{c}_before AS (PARTITION BY {c} ORDER BY {O.md5_hash('id', S.RANDOM_STATE)}, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for c in S.TE_COLUMNS)


@register("ordered_encoding", _without_accounts(O.with_tx(_ORDERED_SQL)))
def q_ordered_encoding(spark, sf_dir):
    """Ordered target statistics of operation and accounts over a hash permutation."""
    return EN.ordered_target_statistics(_lacking_accounts(spark, sf_dir)[0]).select(S.ID, *[f"{c}_ordered_rate" for c in S.TE_COLUMNS])


# ---------------------------------------------------------------- anomaly (I*)
from ..operators import anomaly as AN  # noqa: E402


def _iso_frame(spark, sf_dir):
    return B.add_balance_features(_tx(spark, sf_dir))


@register("isolation_forest_fit")
def q_isolation_forest_fit(spark, sf_dir):
    """200 trees of 256 hash-sampled rows each, built per tree with applyInPandas."""
    model = AN.fit_isolation_forest(_iso_frame(spark, sf_dir))
    return spark.createDataFrame(model.nodes)


@register("isolation_score")
def q_isolation_score(spark, sf_dir):
    """Anomaly score of every transaction (vectorised pandas UDF over the forest)."""
    frame = _iso_frame(spark, sf_dir)
    model = AN.fit_isolation_forest(frame)
    return AN.add_isolation_score(frame, model).select(S.ID, "iso_anomaly_score")


# ------------------------------------------------- models and validation (J*, L*)
from . import models as MD  # noqa: E402
from . import validation as VA  # noqa: E402


def _holdout_frames(spark, sf_dir):
    """Temporal-holdout feature frames, from the given tables at every call."""
    tr, va = SP.temporal_split(_train(spark, sf_dir))
    return VA.fold_frames(tr, va, unsupervised_ref="train")


def _full_frames(spark, sf_dir):
    """Assembled train/test feature frames of the whole fixture."""
    train, test = TX.load_train_test(spark, sf_dir)
    frames, _ = VA.feature_frames(train, test=test)
    return frames["train"], frames["test"]


_MISSING = f"{MD.MISSING!r}::DOUBLE"


@register("assemble_features", O.with_tx(
    "SELECT t.id, 157 AS n_features, "
    "CAST((SELECT count(DISTINCT f.operation) FROM train f WHERE f.period < 96 AND f.operation < t.operation) AS DOUBLE) AS operation_index, "
    + ", ".join(O.r6(f"coalesce(CAST(t.{c} AS DOUBLE), {_MISSING})", c) for c in S.RAW_FEATURES if c != S.OPERATION)
    + " FROM train t WHERE t.period >= 96"))
def q_assemble_features(spark, sf_dir):
    """Operation index fitted on train (unseen -> extra index) + feature vector;
    the vector's length and its entries for the raw features."""
    trA, vaA, cols = _holdout_frames(spark, sf_dir)
    v = vaA.select(S.ID, vector_to_array_col("features").alias("v"))
    at = {c: F.col("v")[i] for i, c in enumerate(cols)}
    return v.select(S.ID, F.size("v").alias("n_features"), at[S.OPERATION].alias("operation_index"),
                    *[at[c].alias(c) for c in S.RAW_FEATURES if c != S.OPERATION])


def vector_to_array_col(c):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(c))


def _learner_query(name: str):
    def q(spark, sf_dir):
        trA, vaA, _ = _holdout_frames(spark, sf_dir)
        with MD.kept_vectors(trA, vaA) as kept:
            model = MD.fit_learner(MD.BASE_LEARNERS[name], *kept)
        return MD.predict(model, vaA, "score").select(S.ID, S.LABEL, "score")
    q.__doc__ = f"J3-J5/J7: fit '{name}' on the temporal holdout and score the valid rows."
    return q


register("fit_gbt")(_learner_query("gbt"))
register("fit_forest")(_learner_query("forest"))
register("fit_gbt_deep")(_learner_query("gbt_deep"))


@register("predict")
def q_predict(spark, sf_dir):
    """Positive-class probability of the three learners on the holdout."""
    trA, vaA, _ = _holdout_frames(spark, sf_dir)
    _, preds, _ = VA.score_fold(trA, vaA)
    return preds


@register("refit_full")
def q_refit_full(spark, sf_dir):
    """Refit on all train rows with the holdout's kept tree count (floored)."""
    tr_all, te = _full_frames(spark, sf_dir)
    with MD.kept_vectors(tr_all) as (rows,):
        hold = MD.fit_learner(MD.BASE_LEARNERS["gbt"], rows.filter(F.col(S.PERIOD) < S.VAL_PERIOD_CUTOFF),
                              rows.filter(F.col(S.PERIOD) >= S.VAL_PERIOD_CUTOFF))
        full = MD.refit_full(MD.BASE_LEARNERS["gbt"], "gbt", hold, rows)
    return MD.predict(full, te, "score").select(S.ID, "score")


@register("fit_specialist")
def q_fit_specialist(spark, sf_dir):
    """Boosted trees on op_03 rows only (C9 guard), scored on op_03 holdout rows."""
    trA, vaA, _ = _holdout_frames(spark, sf_dir)
    tr3 = SP.operation_filter(trA)
    va3 = vaA.filter(F.col(S.OPERATION) == S.POSITIVE_OPERATION)
    with MD.kept_vectors(tr3, va3) as kept:
        model = MD.fit_learner(MD.SPECIALIST, *kept)
    return MD.predict(model, va3, "score").select(S.ID, S.LABEL, "score")


_STARTER_NUM = [n for n, _, _ in _STARTER_SELECT if n != "operation"]


def _starter_frames(spark, sf_dir):
    train, test = TX.load_train_test(spark, sf_dir)
    fo, fd = A.frequency_table(train, S.ORIGIN), A.frequency_table(train, S.DEST)
    return B.starter_features(train, fo, fd), B.starter_features(test, fo, fd)


_OPERATION_FLAGS = [f"operation_{op}" for op in S.OPERATIONS]
_STARTER_SQL = {n: x for n, x, _ in _STARTER_SELECT}


def _starter_vector_sql() -> str:
    """Numeric columns with the train median for nulls, then one flag per train operation."""
    joins = ("LEFT JOIN fo ON t.origin_account = fo.account LEFT JOIN fd ON t.destination_account = fd.account")
    cols = [O.r6(f"coalesce({_STARTER_SQL[n]}, (SELECT median({_STARTER_SQL[n]}) FROM train t {joins}))", n)
            for n in _STARTER_NUM]
    flags = [f"CAST(t.operation IS NOT DISTINCT FROM '{op}' AS INTEGER)::DOUBLE AS operation_{op}" for op in S.OPERATIONS]
    return "SELECT t.id, " + ", ".join(cols + flags) + f" FROM test t {joins}"


@register("starter_preprocess", O.with_tx(_starter_vector_sql(), *_FREQ_CTES))
def q_starter_preprocess(spark, sf_dir):
    """Exact-median fill and one-hot operation (unknown -> zero vector); the entries of the vector."""
    tr, te = _starter_frames(spark, sf_dir)
    pre, med = MD.starter_preprocess(tr, _STARTER_NUM, ["operation"])
    v = pre.fit(tr.fillna(med)).transform(te.fillna(med)).select(S.ID, vector_to_array_col("features").alias("v"))
    return v.select(S.ID, *[F.col("v")[i].alias(n) for i, n in enumerate([*_STARTER_NUM, *_OPERATION_FLAGS])])


@register("starter_model")
def q_starter_model(spark, sf_dir):
    """Starter pipeline (preprocess + 150 boosting rounds), test probabilities clipped."""
    tr, te = _starter_frames(spark, sf_dir)
    model, med = MD.fit_starter(tr, _STARTER_NUM, ["operation"])
    out = MD.predict(model, te.fillna(med), "p")
    return out.select(S.ID, F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0)).alias(S.TARGET))


@register("stack_logistic")
def q_stack_logistic(spark, sf_dir):
    """L2 logistic regression on base-score logits (fit on train rows, score test rows)."""
    sc = _scored(spark, sf_dir)
    tr = sc.filter(F.col(S.PERIOD) < S.TEST_PERIOD_START)
    te = sc.filter(F.col(S.PERIOD) >= S.TEST_PERIOD_START)
    model = MD.fit_stack_logistic(tr, _MODELS)
    return MD.predict_stack_logistic(model, te, _MODELS).select(S.ID, "stack")


@register("stack_gbt")
def q_stack_gbt(spark, sf_dir):
    """Shallow boosted trees on base scores (fit on train rows, score test rows)."""
    sc = _scored(spark, sf_dir)
    tr = sc.filter(F.col(S.PERIOD) < S.TEST_PERIOD_START)
    te = sc.filter(F.col(S.PERIOD) >= S.TEST_PERIOD_START)
    model = MD.fit_stack_gbt(tr, _MODELS)
    return MD.predict_stack_gbt(model, te, _MODELS).select(S.ID, "stack")


@register("stack_out_of_fold")
def q_stack_out_of_fold(spark, sf_dir):
    """Both stackers fitted on the out-of-fold scores of the three learners, applied to their test scores."""
    return VA.stack_out_of_fold(spark, *TX.load_train_test(spark, sf_dir))


@register("validate_models")
def q_validate_models(spark, sf_dir):
    """Temporal holdout of three learners + ensemble choice + group check."""
    return VA.validate_models(spark, _train(spark, sf_dir))


register("boost_histogram", BQ.BOOST_HISTOGRAM_SQL)(BQ.boost_histogram)
register("boost_splits", BQ.BOOST_SPLITS_SQL)(BQ.boost_splits)
register("boost_stages", BQ.BOOST_STAGES_SQL)(BQ.boost_stages)
register("fit_focal")(BQ.fit_focal)
register("fit_ap_stopped")(BQ.fit_ap_stopped)
register("hyperband")(BQ.hyperband)
_halving_body, _halving_ctes = BQ._halving_sql()
register("halving_blend", O.with_tx(_halving_body, SCORED_CTE, *_halving_ctes))(BQ.halving_blend)


def _cv(spark, sf_dir, kind: str):
    """A CV report (a few rows)."""
    fn = VA.cv_rolling if kind == "cv_rolling" else VA.cv_group
    return fn(spark, _train(spark, sf_dir))


@register("cv_rolling")
def q_cv_rolling(spark, sf_dir):
    """Rolling temporal CV (cutoffs 75..99, open valid, skip rule)."""
    return _cv(spark, sf_dir, "cv_rolling")


@register("cv_group")
def q_cv_group(spark, sf_dir):
    """Group-aware 5-fold CV over origin accounts."""
    return _cv(spark, sf_dir, "cv_group")


@register("cv_ensemble")
def q_cv_ensemble(spark, sf_dir):
    """Bounded rolling folds and group folds, three learners + ensemble on the reduced feature set."""
    return VA.cv_ensemble(spark, _train(spark, sf_dir))


@register("fold_summary")
def q_fold_summary(spark, sf_dir):
    """Mean and population std of the rolling-CV AP."""
    return VA.fold_summary_table(_cv(spark, sf_dir, "cv_rolling"))


@register("oof_scores")
def q_oof_scores(spark, sf_dir):
    """Out-of-fold base predictions over group folds (each id once), written and read back."""
    train, test = TX.load_train_test(spark, sf_dir)
    path = VA.report_path(spark, "oof")
    SK.write_table(VA.oof_scores(spark, train, test), path)
    return spark.read.parquet(path)


@register("oof_folds", _without_accounts(O.with_tx("SELECT id, fold FROM tx_f", *_oof_ctes())))
def q_oof_folds(spark, sf_dir):
    """The valid rows of every group fold where rows lack accounts; each id once."""
    parts = None
    for f, _, va in VA.group_parts(_lacking_accounts(spark, sf_dir)[0]):
        part = va.select(S.ID, F.lit(f).alias("fold"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


_OOF_CTES = [
    "ol AS (" + " UNION ALL ".join(
        f"SELECT CAST({fold} AS INTEGER) AS fold, '{m}' AS model, {m} AS s, fraud_flag AS y FROM scored"
        for m in _MODELS for fold in ("id % 5", "NULL")) + ")",
    "og AS (SELECT fold, model, s, sum(y) AS tp, count(*) AS n FROM ol GROUP BY fold, model, s)",
    """oc AS (SELECT fold, model, tp, sum(tp) OVER (PARTITION BY fold, model) AS p,
  sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM og WINDOW w AS (PARTITION BY fold, model ORDER BY s DESC))""",
]


@register("oof_report", O.with_tx("SELECT fold, model, " + O.r6(
    "coalesce(sum(CASE WHEN p > 0 THEN (tp / CAST(p AS DOUBLE)) * (ctp / CAST(cn AS DOUBLE)) END), 0.0)", "ap")
    + " FROM oc GROUP BY fold, model", SCORED_CTE, *_OOF_CTES))
def q_oof_report(spark, sf_dir):
    """AP of each score per fold and over all rows (null fold)."""
    folded = _scored(spark, sf_dir).withColumn("fold", (F.col(S.ID) % 5).cast("int"))
    return VA.oof_report(folded, _MODELS, label=S.LABEL)


@register("random_search")
def q_random_search(spark, sf_dir):
    """Seeded random search of each learner's settings on the temporal holdout."""
    return VA.random_search(spark, _train(spark, sf_dir))


@register("quick_validation")
def q_quick_validation(spark, sf_dir):
    """25% account sample, holdout at 96, three learners + ensemble, gain vs 0.360."""
    train, test = TX.load_train_test(spark, sf_dir)
    return VA.quick_validation(spark, train, test)


@register("baseline_manifest")
def q_baseline_manifest(spark, sf_dir):
    """Rolling and group CV summaries with data fingerprints and seed."""
    train, test = TX.load_train_test(spark, sf_dir)
    rolling, group = together([lambda: _cv(spark, sf_dir, "cv_rolling"), lambda: _cv(spark, sf_dir, "cv_group")],
                              fits_at_once(train.count()))
    return VA.baseline_manifest(spark, train, test, rolling, group)


@register("prepare_datasets")
def q_prepare_datasets(spark, sf_dir):
    """L2: full feature table with the anomaly score (157 features)."""
    train, test = TX.load_train_test(spark, sf_dir)
    comb = SP.combine_splits(train, ("test", test))
    iso = AN.fit_isolation_forest(B.add_balance_features(comb))
    return FT.build_feature_table(train, test, iso_forest=iso)


@register("score_table")
def q_score_table(spark, sf_dir):
    """Test predictions of the holdout-stopped learners, written and read back."""
    path = VA.report_path(spark, "score_table")
    SK.write_table(VA.test_predictions(*TX.load_train_test(spark, sf_dir)), path)
    return spark.read.parquet(path)


@register("pipeline_submit")
def q_pipeline_submit(spark, sf_dir):
    """L3: validated blend weights, final training, operation prior, submission with contract checks."""
    train, test = TX.load_train_test(spark, sf_dir)
    return VA.train_final_and_submit(spark, train, test, TX.sample_ids(test), report=VA.report_path(spark, "validation"))


@register("pipeline_two_stage")
def q_pipeline_two_stage(spark, sf_dir):
    """L4: holdout weights and AP, global blend + op_03 specialist fused by rank, submission with checks."""
    train, test = TX.load_train_test(spark, sf_dir)
    return VA.pipeline_two_stage(spark, train, test, TX.sample_ids(test))


# ------------------------------------------------ what SQL knows of the models (see plans/checks.py)
from . import checks as CK  # noqa: E402

_TWO_FOLDS = [_sgkf_cte().replace("// 5", "// 2").replace("% 5", "% 2").replace("4 -", "1 -"),
              f"tx2 AS (SELECT t.*, coalesce(tf.fold, CAST({O.md5_hash('id', S.RANDOM_STATE)} % 2 AS INTEGER)) AS fold FROM train t LEFT JOIN tf ON t.origin_account = tf.origin_account)"]
_ROLLING_AP = [
    SCORED_CTE,
    "ro AS (SELECT c AS cutoff, p_a AS s, fraud_flag AS y FROM scored, (VALUES " + ", ".join(f"({c})" for c in S.ROLLING_CUTOFFS) + ") v(c) WHERE period >= c AND period < 106)",
    "rg AS (SELECT cutoff, s, sum(y) AS tp, count(*) AS n FROM ro GROUP BY cutoff, s)",
    """rc AS (SELECT cutoff, tp, sum(tp) OVER (PARTITION BY cutoff) AS p, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM rg
  WINDOW w AS (PARTITION BY cutoff ORDER BY s DESC))""",
    "ra AS (SELECT cutoff, coalesce(sum(CASE WHEN p > 0 THEN (tp / CAST(p AS DOUBLE)) * (ctp / CAST(cn AS DOUBLE)) END), 0.0) AS ap FROM rc GROUP BY cutoff)",
]
_FP_SQL = ("SELECT CAST(sum(" + O.md5_hash("concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in _FP_COLS) + ")") + ") AS BIGINT) FROM {}")
_FP_TEST = _FP_SQL.format("(SELECT *, NULL AS fraud_flag FROM test)")
register("isolation_forest_checks", O.with_tx(CK.FOREST_SQL))(CK.forest)
register("isolation_score_checks", O.with_tx(CK.SCORES_SQL))(CK.scores)
register("learner_checks", O.with_tx(CK.LEARNERS_SQL))(CK.learners)
register("cv_checks", O.with_tx(*CK.folds_sql(), *_TWO_FOLDS))(CK.folds)
register("oof_checks", O.with_tx(CK.OOF_SQL, *_TWO_FOLDS))(CK.oof)
register("fold_summary_checks", O.with_tx("SELECT " + O.r6("avg(ap)", "mean_ap") + ", " + O.r6("stddev_pop(ap)", "std_ap") + ", count(*) AS n_folds FROM ra", *_ROLLING_AP))(
    lambda spark, sf_dir: VA.fold_summary_table(CK.scored_report(spark, sf_dir)))
register("manifest_checks", O.with_tx(
    f"SELECT {S.RANDOM_STATE} AS seed, ({_FP_SQL.format('train')}) AS train_fingerprint, ({_FP_TEST}) AS test_fingerprint, "
    + ", ".join(O.r6(f"(SELECT {f}(ap) FROM ra WHERE {w})", n) for f, w, n in (
        ("avg", "true", "rolling_mean_ap"), ("stddev_pop", "true", "rolling_std_ap"), ("avg", "cutoff > 80", "group_mean_ap"), ("stddev_pop", "cutoff > 80", "group_std_ap"))),
    *_ROLLING_AP))(CK.manifest)
register("submission_pipeline_checks", O.with_tx(CK.SUBMISSIONS_SQL, _SAMPLE_CTE))(CK.submissions)
register("prepared_checks", O.with_tx(CK.PREPARED_SQL.format(amount=O.r6("amount", "amount"))))(CK.prepared)
register("validation_checks", CK.VALIDATED_SQL)(CK.validated)


@register("score_checks", O.with_tx(" UNION ALL ".join(
    f"SELECT '{m}' AS model, count(*) AS rows, count(DISTINCT id) AS ids, count(*) AS in_range FROM test"
    for m in ("stack_logistic", "stack_gbt", "blend", "starter", *VA.LEARNERS))))
def q_score_checks(spark, sf_dir):
    """Each model scores every test id once, within [0, 1]."""
    table, starter, blends = together([
        lambda: QUERIES["score_table"](spark, sf_dir), lambda: QUERIES["starter_model"](spark, sf_dir), lambda: CK.blends(spark, sf_dir)],
        fits_at_once(_train(spark, sf_dir).count()))
    return CK.ranges(blends | {"starter": starter} | {m: table.select(S.ID, m) for m in VA.LEARNERS})


# ------------------------------------------------ files written and read back

@register("csv_transactions", SQL["load_transactions"])
def q_csv_transactions(spark, sf_dir):
    """A1/A2: train written as CSV and read by the fixed-schema reader, from the first path that exists."""
    path = VA.report_path(spark, "train_csv")
    _train(spark, sf_dir).select(*TX_COLS).write.option("header", True).csv(path)
    return TX.read_csv_transactions(spark, [path + "-absent", path], id_type=T.LongType(), account_type=T.LongType())


@register("submission_csv", SQL["submission"])
def q_submission_csv(spark, sf_dir):
    """A3: the submission written as CSV in id ranges and read back."""
    path = VA.report_path(spark, "submission_csv")
    SK.write_submission(_submission(spark, sf_dir)[0], path)
    return spark.read.schema(f"{S.ID} bigint, {S.TARGET} double").option("header", True).csv(path)


@register("report_round_trip", SQL["dataset_fingerprint"])
def q_report_round_trip(spark, sf_dir):
    """A JSON report (the fingerprint) written and read back."""
    path = VA.report_path(spark, "fingerprint")
    SK.write_report(spark, QUERIES["dataset_fingerprint"](spark, sf_dir).first().asDict(), path)
    report = SK.read_report(spark, path)
    return spark.createDataFrame([(report["rows"], report["fingerprint"])], "rows long, fingerprint long")


def _fingerprint_sql(name: str, cols: list) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in cols) + ")"
    return f"SELECT '{name}' AS table_name, count(*) AS rows, CAST(sum({O.md5_hash(text)}) AS BIGINT) AS fingerprint FROM "


@register("published_tables", O.with_tx(
    _fingerprint_sql("submission", ["id", "CAST(floor(target * 1000000 + 0.5) AS BIGINT)"]) + "sub UNION ALL "
    + _fingerprint_sql("scores", ["id", *[f"CAST(floor({m} * 1000000 + 0.5) AS BIGINT)" for m in _MODELS]]) + "scored WHERE period >= 106",
    SCORED_CTE, _SAMPLE_CTE, _SUB_CTE))
def q_published_tables(spark, sf_dir):
    """Submission and scores published as one release after the contract holds; the visible manifest."""
    root = VA.report_path(spark, "release")
    with scratch(spark):
        sub, sample = _submission(spark, sf_dir)
        PB.publish(spark, root, {"submission": sub, "scores": _test_scored(spark, sf_dir).select(S.ID, *_MODELS)}, VA.submission_check(sample))
    tables = PB.current(spark, root)["tables"]   # two
    return spark.createDataFrame([(n, t["rows"], t["fingerprint"]) for n, t in tables.items()], "table_name string, rows long, fingerprint long")


@register("feature_columns", O.with_tx("\nUNION ALL ".join(
    f"SELECT '{n}' AS feature, {i} AS position, count({x}) AS present FROM tx"
    for i, (n, x) in enumerate([(c, c) for c in S.RAW_FEATURES] + [(n, x) for n, x, _ in _BAL_SQL]))))
def q_feature_columns(spark, sf_dir):
    """The feature columns of the balance frame in order, with their non-null rows."""
    frame = B.add_balance_features(_tx(spark, sf_dir))
    cols = FT.feature_columns(frame)
    counts = frame.agg(*[F.count(c).alias(c) for c in cols])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.col(c).alias("present"))
        for i, c in enumerate(cols)])).alias("_e")).select("_e.*")
