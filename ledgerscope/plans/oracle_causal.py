"""DuckDB text of the causal window features (used by the oracle statements)."""
from __future__ import annotations

from .. import schema as S

SIDE_SQL = {"origin": (S.ORIGIN, "origin", "o_roll"), "dest": (S.DEST, "dest", "d_roll")}


UNITS = "CAST(round(amount * 100.0) AS BIGINT)"


def msum(over: str, x: str = "amount") -> str:
    """Exact sum of an amount column in integer cents (see AMOUNT_SCALE)."""
    u = UNITS.replace("amount", x)
    return f"(CAST(sum({u}) {over} AS DOUBLE) / 100.0)"


def mmean(over: str, x: str = "amount") -> str:
    return f"({msum(over, x)} / CAST(nullif(count({x}) {over}, 0) AS DOUBLE))"


def clip_sql(x: str, lo: float | None, hi: float | None) -> str:
    inner = x
    if lo is not None:
        inner = f"greatest({inner}, {lo!r})"
    if hi is not None:
        inner = f"least({inner}, {hi!r})"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE {inner} END)"


def _w(acct: str, frame: str | None = None) -> str:
    f = f" {frame}" if frame else ""
    return f"OVER (PARTITION BY {acct} ORDER BY period, id{f})"


def expanding_exprs(side: str) -> list[tuple[str, str, bool]]:
    """(name, expression, is_double) for the six expanding columns of a side."""
    acct, p, _ = SIDE_SQL[side]
    prior = _w(acct, "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    return [
        (f"{p}_txn_rank", f"CAST(row_number() {_w(acct)} - 1 AS BIGINT)", False),
        (f"{p}_amount_cumsum_prior",
         f"coalesce(CASE WHEN lag(amount, 1) {_w(acct)} IS NOT NULL THEN {msum(prior)} END, 0.0)", True),
        (f"{p}_amount_cummean_prior", f"coalesce({mmean(prior)}, 0.0)", True),
        (f"{p}_amount_cummax_prior", f"coalesce(max(amount) {prior}, 0.0)", True),
        (f"{p}_period_since_last", f"CAST(coalesce(period - lag(period, 1) {_w(acct)}, 0) AS BIGINT)", False),
        (f"{p}_period_since_first", f"CAST(period - min(period) OVER (PARTITION BY {acct}) AS BIGINT)", False),
    ]


def rolling_exprs(side: str, windows=S.ROLLING_WINDOWS) -> list[tuple[str, str, bool]]:
    acct, _, r = SIDE_SQL[side]
    out = [
        (f"{r}_dt_prev", f"coalesce(CAST(period - lag(period, 1) {_w(acct)} AS DOUBLE), -1.0)", True),
        (f"{r}_dt_prev2", f"coalesce(CAST(period - lag(period, 2) {_w(acct)} AS DOUBLE), -1.0)", True),
    ]
    for w in windows:
        fr = _w(acct, f"ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING")
        out += [
            (f"{r}_amt_mean_w{w}", f"coalesce({mmean(fr)}, -1.0)", True),
            (f"{r}_amt_std_w{w}", f"coalesce(stddev_samp(amount) {fr}, 0.0)", True),
            (f"{r}_amt_max_w{w}", f"coalesce(max(amount) {fr}, -1.0)", True),
            (f"{r}_amt_min_w{w}", f"coalesce(min(amount) {fr}, -1.0)", True),
            (f"{r}_amt_sum_w{w}", f"coalesce({msum(fr)}, -1.0)", True),
        ]
    fr20 = _w(acct, "ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING")
    z = f"((amount - {mmean(fr20)}) / (coalesce(stddev_samp(amount) {fr20}, 0.0) + 1.0))"
    esc = f"(amount / {clip_sql(f'max(amount) {fr20}', 1.0, None)})"
    out += [
        (f"{r}_amt_zscore_w20", f"coalesce({clip_sql(z, -50.0, 50.0)}, -1.0)", True),
        (f"{r}_amt_ratio_max20", f"coalesce({clip_sql(esc, 0.0, 10000.0)}, -1.0)", True),
        (f"{r}_burst2", f"CAST(coalesce(CAST((period - lag(period, 1) {_w(acct)}) <= 2 AS INTEGER), 0) AS DOUBLE)", True),
        (f"{r}_is_first", f"CAST(CAST(row_number() {_w(acct)} = 1 AS INTEGER) AS DOUBLE)", True),
        (f"{r}_rank", f"CAST(row_number() {_w(acct)} - 1 AS DOUBLE)", True),
    ]
    return out


def select_list(exprs: list[tuple[str, str, bool]]) -> str:
    from .oracle import r6
    parts = []
    for name, e, is_double in exprs:
        parts.append(r6(e, name) if is_double else f"{e} AS {name}")
    return ",\n  ".join(parts)
