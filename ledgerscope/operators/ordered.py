"""Order statistics without a single-task global window.

``Window.orderBy(x)`` with no partition pulls every row into one task.  The
helpers here pre-aggregate to one row per distinct value and cut the value order
into cells of at most ``cell_rows`` of them, each a task's window; totals of
the earlier cells make the result exact, wherever the cuts lie.

Two ways give the cells.  While ``n_buckets`` quantiles of the rows suffice for
cells of that size, their cut points come from one sketch and are literals of the
plan.  Beyond that Spark's range partitioning deals the (group, value) pairs out,
and ranges that are still too large are dealt again, more finely; so neither the
number of cells nor the size of a group or of a narrow range of values is limited.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DEFAULT_BUCKETS = 64
HASH_CELL_ROWS = 500_000   # rows of a cell of hashes, about
CELL_ROWS = 1_000_000   # distinct values that a task orders at most, but for the sketch's error and ranges twice as large


class Cuts(list):
    """Sorted cut points; ``ranged`` if they are too few for the rows they were taken from."""
    ranged = False


def boundaries(df: DataFrame, key: str, n_buckets: int = DEFAULT_BUCKETS, cell_rows: int | None = None) -> Cuts:
    """Up to ``n_buckets - 1`` sorted cut points of ``key`` (approximate quantiles), from one aggregate."""
    cuts = Cuts()
    fracs = [i / n_buckets for i in range(1, n_buckets)] or [0.5]
    row = df.agg(F.percentile_approx(F.col(key).cast("double"), fracs, 10_000).alias("b"), F.count(key).alias("n")).first()
    # a cell between two cuts holds a share of the rows, and at most as many distinct values
    cuts.ranged = row["n"] > (CELL_ROWS if cell_rows is None else cell_rows) * n_buckets // 2
    if n_buckets > 1 and not cuts.ranged:
        cuts += sorted({float(b) for b in row["b"] or [] if b is not None})
    return cuts


def range_cells(df: DataFrame, order: list, cell_rows: int) -> DataFrame:
    """``df`` sorted by ``order`` over tasks of about ``cell_rows`` rows, written, with ``_at`` (task in the upper bits, place in
    the lower 33).  Tasks are counted after the sort; if one holds over twice as many rows, all are dealt again to more tasks."""
    place = F.monotonically_increasing_id().alias("_at")
    out = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", place), "cells")
    wanted = 0
    while True:
        sizes = out.groupBy(F.shiftright("_at", 33).alias("t")).count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
        if (sizes["most"] or 0) <= 2 * cell_rows or wanted > sizes["n"]:
            return out
        wanted = max(2 * wanted, -(-2 * sizes["n"] // cell_rows))
        out = materialize(out.drop("_at").repartitionByRange(wanted, *order).sortWithinPartitions(*order).select("*", place), "cells")


def bucket_column(key: str, bounds: list, descending: bool = False) -> Column:
    """Bucket number such that buckets are ordered like ``key`` (or reversed)."""
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(b) for b in bounds])
    k = F.col(key).cast("double")
    if descending:
        # number of boundaries >= key: larger keys get smaller bucket numbers
        return F.size(F.filter(arr, lambda b: b >= k))
    return F.size(F.filter(arr, lambda b: b < k))


def ordered_prefix(
    df: DataFrame,
    key: str,
    sums: dict,
    partition_cols: list | None = None,
    descending: bool = False,
    inclusive: bool = True,
    n_buckets: int = DEFAULT_BUCKETS,
    bounds_from: DataFrame | None = None,
    bounds: list | None = None,
    cell_rows: int | None = None,
) -> DataFrame:
    """Running sums over ``key`` order, per ``partition_cols``.

    ``df`` should hold one row per (partition, key) (pre-aggregated).  For each
    ``name -> column`` in ``sums`` the output gets ``name`` = the sum over all
    rows of the same partition that come before (or at, when ``inclusive``) the
    row's key in the chosen order.  Keys must be unique per partition.
    """
    parts = list(partition_cols or [])
    # boundaries only balance the buckets; a sketch over the raw rows (map-side
    # partial aggregation, no shuffle of ``df``) is as good as one over ``df``
    if bounds is None:
        bounds = boundaries(bounds_from if bounds_from is not None else df, key, n_buckets, cell_rows)
    names = list(sums)
    values = [F.coalesce(sums[n], F.lit(0)).alias(f"_v_{n}") for n in names]
    order = F.col(key).desc() if descending else F.col(key).asc()
    ranged = getattr(bounds, "ranged", False)
    if ranged:
        cells = range_cells(df.select("*", *values), [*parts, order], CELL_ROWS if cell_rows is None else cell_rows)
        base = cells.withColumn("_bkt", F.shiftright("_at", 33))
    else:
        base = df.select("*", bucket_column(key, bounds, descending).alias("_bkt"), *values)
    # bucket totals per partition: one row per (partition, bucket)
    totals = base.groupBy(*parts, "_bkt").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    w_off = (Window.partitionBy(*parts).orderBy("_bkt")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*parts, "_bkt",
                            *[F.coalesce(F.sum(f"_t_{n}").over(w_off), F.lit(0)).alias(f"_o_{n}")
                              for n in names])
    frame_end = Window.currentRow if inclusive else -1
    w_in = (Window.partitionBy(*parts, "_bkt").orderBy(order)
            .rowsBetween(Window.unboundedPreceding, frame_end))
    if not parts and not ranged:
        offsets = F.broadcast(offsets)   # at most n_buckets rows
    joined = base.join(offsets, [*parts, "_bkt"], "left")
    return joined.select(
        *[c for c in df.columns],
        *[(F.coalesce(F.sum(f"_v_{n}").over(w_in), F.lit(0)) + F.col(f"_o_{n}")).alias(n)
          for n in names],
    )


def rank_pct(df: DataFrame, value: str, out: str, partition_cols: list | None = None,
             n_buckets: int = DEFAULT_BUCKETS, cell_rows: int | None = None) -> DataFrame:
    """``Series.rank(method='average', pct=True)`` as a distributed join.

    Rank of v = (#values < v) + (#values == v + 1) / 2, divided by the count of
    non-null values of the partition; null stays null.
    """
    parts = list(partition_cols or [])
    counts = (df.filter(F.col(value).isNotNull())
              .groupBy(*parts, value).agg(F.count(F.lit(1)).alias("_cnt")))
    pref = ordered_prefix(counts, value, {"_before": F.col("_cnt")}, parts,
                          inclusive=False, n_buckets=n_buckets, bounds_from=df.select(value), cell_rows=cell_rows)
    if parts:
        totals = counts.groupBy(*parts).agg(F.sum("_cnt").alias("_n"))
        ranked = pref.join(totals, parts, "inner")
    else:
        n_total = counts.agg(F.sum("_cnt")).first()[0] or 0
        ranked = pref.withColumn("_n", F.lit(int(n_total)))
    ranked = ranked.select(*parts, value,
                           ((F.col("_before") + (F.col("_cnt") + 1) / 2.0) / F.col("_n")).alias(out))
    return df.join(ranked, [*parts, value], "left")


def global_positions(df: DataFrame, order: list, out: str = "pos") -> DataFrame:
    """0-based position of every row in a total order, without a single task.

    ``orderBy`` range-partitions and sorts in parallel; each row then gets
    ``monotonically_increasing_id`` (partition index in the upper bits, record
    number in the lower 33).  The sorted table is checkpointed to the session's
    checkpoint directory so both uses see the same partition layout (and a lost
    executor does not re-sample the range bounds).  Per-partition counts (one
    row per partition) become offsets.  ``order`` must be a total order.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    mask = (1 << 33) - 1
    sorted_df = df.orderBy(*order).select("*", F.monotonically_increasing_id().alias("_mid"))
    sorted_df = sorted_df.checkpoint(eager=True)
    counts = (sorted_df.groupBy(F.shiftright(F.col("_mid"), 33).alias("_pid"))
              .agg(F.count(F.lit(1)).alias("_cnt")))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sorted table: bounded by the partition count
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    joined = sorted_df.join(F.broadcast(offsets),
                            F.shiftright(sorted_df["_mid"], 33) == offsets["_pid"], "inner")
    return joined.select(*df.columns,
                         (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(mask))).cast("long").alias(out))


def hash_bits(n: int, rows: int) -> int:
    """Leading bits of a 32-bit hash whose cells hold about ``rows`` of ``n`` rows."""
    return min(32, max(0, math.ceil(math.log2(max(n, 1) / max(rows, 1)))))


def hash_cell(hashed: str | Column, bits: int) -> Column:
    """The cell of a 32-bit hash by its leading ``bits``; null hashes come first."""
    return F.coalesce(F.shiftright(F.col(hashed) if isinstance(hashed, str) else hashed, 32 - bits), F.lit(-1))


def hash_positions(df: DataFrame, hashed: str, tie: str, out: str = "pos", by: tuple = (), n: int | None = None,
                   cell_rows: int = HASH_CELL_ROWS) -> DataFrame:
    """0-based position of every row in the order of a 32-bit hash (then ``tie``), within each ``by`` group.

    A hash is spread evenly, so its leading bits cut the order into cells of about ``cell_rows`` rows without a sample or a
    sorted copy of the table: rows are numbered inside their cell, and the cells' counts (partial aggregates, one
    row per cell) say how many rows stand before it.  Null groups are a group.
    """
    cell = hash_cell(hashed, hash_bits(df.count() if n is None else n, cell_rows)).alias("cell")
    x = df.select("*", F.struct(*by, cell).alias("_cell"))
    counts = x.groupBy("_cell").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*[f"_cell.{b}" for b in by]).orderBy("_cell.cell").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_cell", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(hashed, tie)) - 1
    numbered = x.select("*", inside.alias("_inside")).join(before, "_cell")
    return numbered.select(*df.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(out))


def exact_quantiles(df: DataFrame, value: str, qs: list, group_cols: list | None = None,
                    n_buckets: int = DEFAULT_BUCKETS, prefix: str = "q", bounds: list | None = None,
                    cell_rows: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group, without a per-group buffer.

    ``percentile`` keeps a value -> count map per group and merges it in one
    task, which a group holding a third of the rows (or very many distinct
    values) cannot afford.  Here: counts per (group, value) (partial
    aggregation), cumulative counts by bucketed prefix sums, then the values
    covering positions floor(q (n-1)) and ceil(q (n-1)), interpolated exactly
    like ``percentile`` does.  Output: group columns + one column per quantile
    named ``{prefix}{i}`` (null for an empty group).  ``bounds`` are cut points of
    ``value`` known from an earlier call.
    """
    parts = list(group_cols or [])
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*parts, value)
              .agg(F.count(F.lit(1)).alias("_c")))
    pref = ordered_prefix(counts, value, {"_cum": F.col("_c")}, parts, inclusive=True,
                          n_buckets=n_buckets, bounds_from=df.select(value), bounds=bounds, cell_rows=cell_rows)
    totals = counts.groupBy(*parts).agg(F.sum("_c").alias("_n"))
    x = pref.join(totals, parts, "inner") if parts else pref.withColumn(
        "_n", F.lit(int(counts.agg(F.sum("_c")).first()[0] or 0)))
    start = F.col("_cum") - F.col("_c")        # first 0-based index covered by this value
    end = F.col("_cum") - 1                    # last index covered
    aggs = []
    for i, q in enumerate(qs):
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.max(F.when((start <= lo) & (lo <= end), F.col(value))).alias(f"_lo{i}"),
                 F.max(F.when((start <= hi) & (hi <= end), F.col(value))).alias(f"_hi{i}"),
                 F.max(pos).alias(f"_p{i}")]
    g = x.groupBy(*parts).agg(*aggs)
    outs = []
    for i, _ in enumerate(qs):
        p, vlo, vhi = F.col(f"_p{i}"), F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        lo, hi = F.floor(p).cast("double"), F.ceil(p).cast("double")
        interp = (hi - p) * vlo + (p - lo) * vhi
        outs.append(F.when((lo == hi) | (vlo == vhi), vlo).otherwise(interp).alias(f"{prefix}{i}"))
    return g.select(*parts, *outs)
