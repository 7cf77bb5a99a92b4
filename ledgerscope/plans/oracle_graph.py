"""DuckDB text for the graph features: edge list, transitions and PageRank
unrolled into a chain of materialised CTEs (one per iteration)."""
from __future__ import annotations

from .. import schema as S
from .oracle_causal import msum

GRAPH_BASE_CTES = [
    f"""ge AS (SELECT origin_account AS src, destination_account AS dst,
  coalesce({msum('')}, 0.0) AS w FROM tx
  WHERE origin_account IS NOT NULL AND destination_account IS NOT NULL GROUP BY 1, 2)""",
    "gn AS MATERIALIZED (SELECT src AS node FROM ge UNION SELECT dst FROM ge)",
    "gcount AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM gn)",
    f"gout AS (SELECT src, {msum('', 'w')} AS s FROM ge GROUP BY src)",
    "gtr AS MATERIALIZED (SELECT ge.src, ge.dst, ge.w / gout.s AS p FROM ge JOIN gout ON ge.src = gout.src WHERE gout.s <> 0)",
    """gnd AS MATERIALIZED (SELECT gn.node, (l.src IS NULL) AS dangling FROM gn
  LEFT JOIN (SELECT src FROM gout WHERE s <> 0) l ON gn.node = l.src)""",
    "pr0 AS MATERIALIZED (SELECT node, 1.0 / (SELECT n FROM gcount) AS x FROM gnd)",
]


def _step(i: int, damping: float) -> str:
    prev = f"pr{i - 1}"
    base = (f"({damping!r}::DOUBLE * ((SELECT coalesce(sum(q.x), 0.0) FROM {prev} q JOIN gnd d2 "
            f"ON q.node = d2.node WHERE d2.dangling) / (SELECT n FROM gcount)) "
            f"+ (1.0::DOUBLE - {damping!r}::DOUBLE) / (SELECT n FROM gcount))")
    return (f"pr{i} AS MATERIALIZED (SELECT gnd.node, {damping!r}::DOUBLE * coalesce(c.s, 0.0) + {base} AS x "
            f"FROM gnd LEFT JOIN (SELECT e.dst, sum(q.x * e.p) AS s FROM gtr e JOIN {prev} q ON q.node = e.src "
            f"GROUP BY e.dst) c ON c.dst = gnd.node)")


def pagerank_ctes(iterations: int, convergent: bool, damping: float = S.PAGERANK_DAMPING,
                  tol: float = S.PAGERANK_TOL) -> list:
    """CTEs ending in ``gpr(node, pagerank)`` (rounded to 9 digits of the mean rank)."""
    ctes = list(GRAPH_BASE_CTES) + [_step(i, damping) for i in range(1, iterations + 1)]
    if not convergent:
        ctes.append(f"gpr AS (SELECT node, round(x * (SELECT n FROM gcount), 9) / (SELECT n FROM gcount)::DOUBLE AS pagerank FROM pr{iterations})")
        return ctes
    errs = " UNION ALL ".join(
        f"SELECT {i} AS it, sum(abs(a.x - b.x)) AS err FROM pr{i} a JOIN pr{i - 1} b ON a.node = b.node"
        for i in range(1, iterations + 1))
    ctes.append(f"gerr AS (SELECT min(it) AS it FROM ({errs}) WHERE err < (SELECT n FROM gcount) * {tol!r})")
    alls = " UNION ALL ".join(f"SELECT {i} AS it, node, x FROM pr{i}" for i in range(1, iterations + 1))
    ctes.append(f"""gpr AS (SELECT gnd.node, coalesce(round(v.x * (SELECT n FROM gcount), 9) / (SELECT n FROM gcount)::DOUBLE, 0.0) AS pagerank FROM gnd
  LEFT JOIN (SELECT node, x FROM ({alls}) u WHERE u.it = (SELECT it FROM gerr)) v ON gnd.node = v.node)""")
    return ctes


def side_stats_cte(name: str, acct: str, other: str) -> str:
    return f"""{name} AS (SELECT {acct} AS account, count(DISTINCT {other}) AS deg, count(amount) AS cnt,
  {msum('')} AS s, {msum('')} / CAST(nullif(count(amount), 0) AS DOUBLE) AS m,
  max(period) - min(period) + 1 AS span,
  count(DISTINCT {other}) / greatest(CAST(max(period) - min(period) + 1 AS DOUBLE), 1.0) AS rate
  FROM tx WHERE {acct} IS NOT NULL GROUP BY {acct})"""


CYCLE_CTES = [
    """gp AS (SELECT origin_account AS a, destination_account AS b, count(*) AS cnt FROM tx
  WHERE origin_account IS NOT NULL AND destination_account IS NOT NULL GROUP BY 1, 2)""",
    """gc AS (SELECT p.a, p.b, p.cnt + coalesce(r.cnt, 0) AS c2 FROM gp p
  LEFT JOIN gp r ON r.a = p.b AND r.b = p.a WHERE p.a < p.b)""",
    "gco AS (SELECT a AS account, CAST(sum(c2) AS BIGINT) AS c2 FROM gc GROUP BY a)",
    "gcd AS (SELECT b AS account, CAST(sum(c2) AS BIGINT) AS c2 FROM gc GROUP BY b)",
]
