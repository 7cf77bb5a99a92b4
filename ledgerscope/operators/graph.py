"""Transaction-graph features (G1-G5) over the amount-weighted directed edge list.

PageRank follows the power iteration of the weighted, dangling-aware
definition: out-weights normalise each row; nodes whose out-weight is 0 are
dangling and spread their mass evenly; teleport is uniform.  The loop joins
the (persisted, src-partitioned) edge table with the rank table and
aggregates by destination; the only driver traffic per iteration is two
scalars (dangling mass, L1 change).  Lineage is cut by reliable checkpoints.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import clip, from_units, units
from ..session import materialize
from .ordered import rank_pct

GRAPH_COLUMNS = ["o_out_degree", "o_out_count", "o_out_amount_sum", "o_out_amount_mean",
                 "o_period_span", "o_fan_out_rate", "o_cycle2_count", "o_pagerank",
                 "d_in_degree", "d_in_count", "d_in_amount_sum", "d_in_amount_mean",
                 "d_period_span", "d_fan_in_rate", "d_cycle2_count", "d_pagerank",
                 "graph_pagerank_gap"]
PAGERANK_DIGITS = 9   # ranks are reported to 1e-9 of the mean rank 1/N, so equal ranks tie at any N


def _side_stats(ref: DataFrame, acct: str, other: str, p: str, kind: str, scale) -> DataFrame:
    total_u = F.sum(units(S.AMOUNT, scale))
    span = (F.max(S.PERIOD) - F.min(S.PERIOD) + 1)
    g = (ref.filter(F.col(acct).isNotNull()).groupBy(acct)
         .agg(F.count_distinct(other).alias(f"{p}_{kind}_degree"),
              F.count(S.AMOUNT).alias(f"{p}_{kind}_count"),
              from_units(total_u, scale).alias(f"{p}_{kind}_amount_sum"),
              span.alias(f"{p}_period_span")))
    cnt = F.col(f"{p}_{kind}_count")
    rate = "fan_out_rate" if kind == "out" else "fan_in_rate"
    return g.select(
        F.col(acct).alias("account"),
        f"{p}_{kind}_degree", cnt.alias(f"{p}_{kind}_count"), f"{p}_{kind}_amount_sum",
        (F.col(f"{p}_{kind}_amount_sum") / F.nullif(cnt, F.lit(0)).cast("double"))
        .alias(f"{p}_{kind}_amount_mean"),
        f"{p}_period_span",
        (F.col(f"{p}_{kind}_degree") / clip(F.col(f"{p}_period_span").cast("double"), lo=1.0))
        .alias(f"{p}_{rate}"),
    )


def edge_weights(ref: DataFrame, scale=S.AMOUNT_SCALE) -> DataFrame:
    """(src, dst, weight = sum of amounts, count = non-null amounts)."""
    return (ref.filter(F.col(S.ORIGIN).isNotNull() & F.col(S.DEST).isNotNull())
            .groupBy(F.col(S.ORIGIN).alias("src"), F.col(S.DEST).alias("dst"))
            .agg(F.coalesce(from_units(F.sum(units(S.AMOUNT, scale)), scale), F.lit(0.0)).alias("weight"),
                 F.count(S.AMOUNT).alias("count"),
                 F.count(F.lit(1)).alias("rows")))


def reciprocal_pairs(ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per pair ``rows(a->b) + rows(b->a)``, kept for pairs with a < b and
    summed per origin and per destination."""
    pairs = (ref.filter(F.col(S.ORIGIN).isNotNull() & F.col(S.DEST).isNotNull())
             .groupBy(F.col(S.ORIGIN).alias("a"), F.col(S.DEST).alias("b"))
             .agg(F.count(F.lit(1)).alias("cnt")))
    rev = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("cnt").alias("rev_cnt"))
    cyc = (pairs.filter(F.col("a") < F.col("b"))
           .join(rev, ["a", "b"], "left")
           .select("a", "b", (F.col("cnt") + F.coalesce(F.col("rev_cnt"), F.lit(0))).alias("c2")))
    o = cyc.groupBy(F.col("a").alias("account")).agg(F.sum("c2").alias("o_cycle2_count"))
    d = cyc.groupBy(F.col("b").alias("account")).agg(F.sum("c2").alias("d_cycle2_count"))
    return o, d


def account_graph(pairs: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """One row per account of the pair table ``(src, dst, rows)``: degrees, 2-cycle
    counts of both sides and, given ``ranks(node, pagerank)``, the rank, from one aggregate."""
    rev = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rows").alias("_rev"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    c2 = F.when(F.col("src") < F.col("dst"), F.col("rows") + F.coalesce("_rev", F.lit(0))).otherwise(zero)
    names = ["out_degree", "in_degree", "o_cycle2_count", "d_cycle2_count"]

    def end(account, *values):
        return F.struct(F.col(account).alias("account"), *[v.alias(n) for n, v in zip(names, values)])

    both = F.array(end("src", one, zero, c2, zero), end("dst", zero, one, zero, c2))
    parts = (pairs.join(rev, ["src", "dst"], "left").select(F.explode(both).alias("_e"))
             .select("_e.*", F.lit(None).cast("double").alias("pagerank")))
    if ranks is not None:
        parts = parts.unionByName(ranks.select(F.col("node").alias("account"), *[zero.alias(n) for n in names],
                                               "pagerank"))
    return parts.groupBy("account").agg(*[F.sum(n).alias(n) for n in names], F.max("pagerank").alias("pagerank"))


HUB_EDGES = 500_000      # outgoing edges of a node that stay in one task
PART_EDGES = 2_000_000   # edges of a partition of the transitions, on average


def _hub_transitions(known: DataFrame, hub_edges: int, nparts: int) -> tuple[DataFrame, DataFrame]:
    """The hubs with their number of parts (one row per ``hub_edges`` edges at most), and their transitions by part."""
    parts = F.ceil(F.col("_d") / hub_edges).cast("int")
    edges = known.filter(F.col("_d") > hub_edges).select(
        "src", F.pmod(F.xxhash64("dst"), parts).cast("int").alias("_part"), "dst", (F.col("w") / F.col("_s")).alias("p"), parts.alias("_parts"))
    hubs = edges.groupBy("src").agg(F.max("_parts").alias("_parts"))
    # dealt round, as hashing few parts would put several of them into one task
    return materialize(hubs, "hubs"), edges.drop("_parts").repartition(max(nparts, 1)).persist(StorageLevel.MEMORY_AND_DISK)


def pagerank(edges: DataFrame, damping: float = S.PAGERANK_DAMPING, max_iter: int = S.PAGERANK_MAX_ITER,
             tol: float | None = S.PAGERANK_TOL,
             num_partitions: int | None = None, scale=S.AMOUNT_SCALE, hub_edges: int = HUB_EDGES) -> tuple[DataFrame, bool, int]:
    """Weighted PageRank of ``edges(src, dst, weight)``.

    With ``tol`` set, stops when the L1 change is below ``N * tol`` and returns
    ``(ranks, True, iterations)``; when ``max_iter`` passes without that, every
    rank is 0 and ``converged`` is False.  With ``tol=None`` runs exactly
    ``max_iter`` iterations.  ``ranks`` is ``(node, pagerank)``.

    Nodes with more than ``hub_edges`` outgoing edges are cut: their edges are dealt
    to parts of that size, every part gets the node's rank, and the partial sums of all
    parts meet in the contributions.
    """
    spark = edges.sparkSession
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("w"))
    nodes = (e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node")))
             .distinct())
    # out-weights summed exactly when weights are money (see AMOUNT_SCALE)
    out_w = e.groupBy("src").agg(from_units(F.sum(units("w", scale)), scale).alias("_s"), F.count(F.lit(1)).alias("_d"))
    size = out_w.agg(F.sum("_d").alias("edges"), F.max("_d").alias("most")).first()
    # transitions and ranks share one explicit partitioning, so each iteration shuffles only
    # the contributions; as many parts as the cores (capped by the session's shuffle setting, because
    # every iteration pays per-task overhead on every partition), more where the edges need them
    nparts = num_partitions or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                          spark.sparkContext.defaultParallelism),
                                   -(-(size["edges"] or 0) // PART_EDGES))
    cut = (size["most"] or 0) > hub_edges
    known = e.join(out_w, "src").filter(F.col("_s") != 0)
    hubs = _hub_transitions(known, hub_edges, nparts) if cut else None
    # normalised transition weights, partitioned by src once and kept
    trans = (known.filter(F.col("_d") <= hub_edges)
             .select("src", "dst", (F.col("w") / F.col("_s")).alias("p"))
             .repartition(nparts, "src")
             .persist(StorageLevel.MEMORY_AND_DISK))
    live = out_w.filter(F.col("_s") != 0).select(F.col("src").alias("node"), F.lit(False).alias("_l"))
    node_tbl = (nodes.join(live, "node", "left")
                .select("node", F.col("_l").isNull().alias("dangling"))
                .repartition(nparts, "node")
                .persist(StorageLevel.MEMORY_AND_DISK))
    cnt = node_tbl.agg(F.count(F.lit(1)).alias("n"), F.count_if("dangling").alias("d")).first()
    n = int(cnt["n"])
    if n == 0:
        trans.unpersist()
        return node_tbl.select("node", F.lit(0.0).alias("pagerank")), True, 0
    x = node_tbl.select("node", "dangling", F.lit(1.0 / n).alias("x"))
    dang = x.filter("dangling").agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0] if cnt["d"] else 0.0
    converged = tol is None
    it = 0
    prev_cached = None
    for it in range(1, max_iter + 1):
        ranked = x.select(F.col("node").alias("src"), "x")
        given = trans.join(ranked, "src").select("dst", (F.col("x") * F.col("p")).alias("_c"))
        if cut:
            parts = ranked.join(hubs[0], "src").select("src", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "x")
            given = given.unionByName(hubs[1].join(parts, ["src", "_part"]).select("dst", (F.col("x") * F.col("p")).alias("_c")))
        contrib = given.groupBy(F.col("dst").alias("node")).agg(F.sum("_c").alias("_c"))
        base = damping * (dang / n) + (1.0 - damping) / n
        new = (x.join(contrib, "node", "left")
               .select("node", "dangling",
                       (F.lit(damping) * F.coalesce(F.col("_c"), F.lit(0.0)) + F.lit(base)).alias("x"),
                       F.col("x").alias("_old")))
        # computed once (persisted by the aggregate), then a reliable checkpoint
        # written from the cache keeps the plan one iteration deep and survives
        # executor loss without replaying earlier iterations
        cached = new.persist(StorageLevel.MEMORY_AND_DISK)
        new = cached.checkpoint(eager=False)
        row = new.agg(F.sum(F.abs(F.col("x") - F.col("_old"))).alias("err"),
                      F.coalesce(F.sum(F.when(F.col("dangling"), F.col("x"))), F.lit(0.0)).alias("d")).first()
        if prev_cached is not None:
            prev_cached.unpersist()
        prev_cached = cached
        x = new.select("node", "dangling", "x")
        dang = row["d"]
        if tol is not None and row["err"] < n * tol:
            converged = True
            break
    trans.unpersist()
    node_tbl.unpersist()
    if cut:
        hubs[1].unpersist()
    if prev_cached is not None:
        prev_cached.unpersist()   # the last ranks are read from their checkpoint
    if converged:
        ranks = x.select("node", (F.round(F.col("x") * F.lit(float(n)), PAGERANK_DIGITS) / F.lit(float(n))).alias("pagerank"))
    else:
        ranks = x.select("node", F.lit(0.0).alias("pagerank"))
    return ranks, converged, it


def fit_graph_features(ref: DataFrame, scale=S.AMOUNT_SCALE, **pr_kw) -> tuple[DataFrame, DataFrame]:
    """Per-origin and per-destination tables keyed by ``account``;
    missing cycle counts and ranks are 0."""
    o_stats = _side_stats(ref, S.ORIGIN, S.DEST, "o", "out", scale)
    d_stats = _side_stats(ref, S.DEST, S.ORIGIN, "d", "in", scale)
    pairs = materialize(edge_weights(ref, scale), "pairs")   # read by the ranks, cycles and degrees
    ranks, _, _ = pagerank(pairs, scale=scale, **pr_kw)
    nodes = materialize(account_graph(pairs, ranks), "nodes")
    o = (o_stats.join(nodes, "account", "left")
         .select(*[F.col(c) for c in o_stats.columns],
                 F.coalesce(F.col("o_cycle2_count"), F.lit(0)).alias("o_cycle2_count"),
                 F.coalesce(F.col("pagerank"), F.lit(0.0)).alias("o_pagerank")))
    d = (d_stats.join(nodes, "account", "left")
         .select(*[F.col(c) for c in d_stats.columns],
                 F.coalesce(F.col("d_cycle2_count"), F.lit(0)).alias("d_cycle2_count"),
                 F.coalesce(F.col("pagerank"), F.lit(0.0)).alias("d_pagerank")))
    # pandas fills every missing value of the fitted tables with 0
    return o.fillna(0), d.fillna(0)


def apply_graph_features(df: DataFrame, origin_stats: DataFrame, dest_stats: DataFrame,
                         gap_partition: list | None = None) -> DataFrame:
    """Left joins (unseen accounts get 0) and the PageRank rank gap over the
    rows being featurised (per ``gap_partition`` group when given)."""
    keep = list(df.columns)
    o_cols = [c for c in origin_stats.columns if c != "account"]
    d_cols = [c for c in dest_stats.columns if c != "account"]
    out = (df.join(origin_stats.withColumnRenamed("account", S.ORIGIN), S.ORIGIN, "left")
             .join(dest_stats.withColumnRenamed("account", S.DEST), S.DEST, "left"))
    out = out.select(*keep, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in o_cols + d_cols])
    parts = list(gap_partition or [])
    out = rank_pct(out, "o_pagerank", "_ro", parts)
    out = rank_pct(out, "d_pagerank", "_rd", parts)
    return (out.withColumn("graph_pagerank_gap", F.coalesce(F.abs(F.col("_ro") - F.col("_rd")), F.lit(0.0)))
               .drop("_ro", "_rd"))
