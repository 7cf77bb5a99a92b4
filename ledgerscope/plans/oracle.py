"""Reference SQL (DuckDB dialect) for the registered queries.

Each statement reads the pre-registered ``events`` view through the same
transaction definition as :mod:`ledgerscope.sources.transactions` and rounds
double outputs to 6 digits (``+ 0.0`` maps -0.0 to 0.0), like
:func:`ledgerscope.functions.columns.round_doubles` on the Spark side.
"""
from __future__ import annotations

TX_CTE = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events
),
tx AS (
  SELECT
    event_id AS id,
    CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 18000000000) AS INTEGER) AS period,
    CASE event_type WHEN 'click' THEN 'op_01' WHEN 'view' THEN 'op_02' WHEN 'error' THEN 'op_03'
                    WHEN 'purchase' THEN 'op_04' WHEN 'signup' THEN 'op_05' END AS operation,
    value AS amount,
    user_id AS origin_account,
    CAST((user_id * 37 + event_id * 13) % 700 - 50 AS DOUBLE) AS origin_balance_before,
    CASE WHEN event_type = 'error' THEN 0.0
         WHEN event_type = 'signup' THEN CAST((user_id * 37 + event_id * 13) % 700 - 50 AS DOUBLE)
         ELSE CAST((user_id * 37 + event_id * 13) % 700 - 50 AS DOUBLE) - value END AS origin_balance_after,
    k AS destination_account,
    CAST((k * 53 + event_id * 7) % 900 AS DOUBLE) AS destination_balance_before,
    CASE WHEN event_type = 'view' THEN CAST((k * 53 + event_id * 7) % 900 AS DOUBLE)
         ELSE CAST((k * 53 + event_id * 7) % 900 AS DOUBLE) + value END AS destination_balance_after,
    CASE WHEN event_type = 'error' AND ((value > 60 AND event_id % 10 < 7) OR event_id % 20 = 0)
         THEN 1 ELSE 0 END AS fraud_flag
  FROM ev
),
train AS (SELECT * FROM tx WHERE period < 106),
test AS (SELECT * EXCLUDE (fraud_flag) FROM tx WHERE period >= 106)
"""


def with_tx(body: str, *ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {TX_CTE}{extra}\n{body}"


def r6(expr: str, alias: str | None = None) -> str:
    """Rounded double output column: the same IEEE steps as
    :func:`ledgerscope.functions.columns.round_half_up`."""
    x = f"CAST({expr} AS DOUBLE)"
    out = (f"((CASE WHEN abs({x}) < 1e12 THEN sign({x}) * (floor(abs({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) "
           f"/ 1000000.0::DOUBLE) ELSE {x} END) + 0.0::DOUBLE)")
    return f"{out} AS {alias}" if alias else out


def md5_hash(expr: str, seed: int | None = None) -> str:
    """DuckDB form of :func:`ledgerscope.functions.columns.stable_hash`."""
    s = f"CAST({expr} AS VARCHAR)"
    if seed is not None:
        s = f"({s} || '#{seed}')"
    return f"CAST(('0x' || substr(md5({s}), 1, 8)) AS BIGINT)"
