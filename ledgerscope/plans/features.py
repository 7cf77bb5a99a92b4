"""Feature table (L1/L2): the 157 columns per transaction for train and test.

Plan shape (chosen for large inputs):

* the rows are aggregated once per account of each side and once per account
  pair; degrees, cycles, PageRank, folds, fold sums and rank percentiles are
  derived from these written tables, not from the rows;
* the transaction rows are joined once with the origin table and once with
  the destination table; the causal window of each side runs right after its
  join and reuses the join's hash partitioning (no extra exchange);
* the operation table has one row per operation; the pair count is a
  (origin, destination) join with the written pair table.

Train rows get out-of-fold target encodings (stratified group folds over the
origin account); test rows get the full-fit encodings.
"""
from __future__ import annotations

from functools import partial, reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import materialize, together
from ..functions.columns import clip, money_mean, money_sum
from ..operators import aggregates as A
from ..operators import anomaly as AN
from ..operators import balance as B
from ..operators import causal as C
from ..operators import graph as G
from ..operators import profiles as PR
from ..operators import splits as SP
from ..operators.ordered import DEFAULT_BUCKETS, boundaries, exact_quantiles, ordered_prefix

K_FOLDS = 5
# per side: account column, names of its aggregate, graph and profile columns
SIDES = {
    "origin": dict(account=S.ORIGIN, distinct="origin_dest_nunique", p="o", kind="out", rate="fan_out_rate",
                   profile="op_orig"),
    "dest": dict(account=S.DEST, distinct="dest_origin_nunique", p="d", kind="in", rate="fan_in_rate",
                 profile="op_dest"),
}


def feature_names(include_iso: bool = True) -> list:
    """The 157 feature names in creation order (156 without the anomaly score)."""
    names = list(S.RAW_FEATURES) + B.BALANCE_COLUMNS + B.ENCODING_COLUMNS + A.AGGREGATE_COLUMNS
    names += G.GRAPH_COLUMNS
    names += PR.profile_columns("op_orig") + PR.profile_columns("op_dest") + PR.PROFILE_DERIVED
    if include_iso:
        names += ["iso_anomaly_score"]
    names += [f"{c}_fraud_rate" for c in S.TE_COLUMNS]
    names += C.rolling_names() + C.expanding_names()
    return names


def feature_columns(df: DataFrame) -> list:
    """Every column except the id, the label, the two accounts (and the split tag)."""
    drop = {S.ID, S.LABEL, S.ORIGIN, S.DEST, S.SPLIT}
    return [c for c in df.columns if c not in drop]


# ----------------------------------------------------------- target encoding

def _te_columns(prior: float, fold_priors: dict, m: float, k: int) -> list:
    """``te_full`` and ``te_f{fold}``: full-fit rate and the out-of-fold rate of each fold from the sums ``_ts``,
    ``_tn`` and ``_s{fold}``, ``_n{fold}`` of a key (null rate: no labelled rows)."""
    def smooth(s, n, p):
        return F.when(n > 0, (s / n * n + F.lit(float(p)) * F.lit(float(m))) / (n + F.lit(float(m))))

    s, n = F.col("_ts").cast("double"), F.col("_tn").cast("double")
    cols = [smooth(s, n, prior).alias("te_full")]
    for f in range(k):
        s_o, n_o = s - F.col(f"_s{f}").cast("double"), n - F.col(f"_n{f}").cast("double")
        cols.append(F.coalesce(smooth(s_o, n_o, fold_priors[f]), F.lit(fold_priors[f])).alias(f"te_f{f}"))
    return cols


def _fold_sums(parts: DataFrame, key: str, k: int) -> DataFrame:
    """Sums of ``_y`` and ``_yn`` per key, in all and per fold."""
    aggs = [F.coalesce(F.sum("_y"), F.lit(0)).alias("_ts"), F.sum("_yn").alias("_tn")]
    for f in range(k):
        here = F.col("fold") == f
        aggs += [F.coalesce(F.sum(F.when(here, F.col("_y"))), F.lit(0)).alias(f"_s{f}"),
                 F.coalesce(F.sum(F.when(here, F.col("_yn"))), F.lit(0)).alias(f"_n{f}")]
    return parts.groupBy(F.col(key).alias("account")).agg(*aggs)


def _te_pick(prefix: str, fold: F.Column, prior: float, fold_priors: dict, k: int, split: str = S.SPLIT, w: str = "") -> F.Column:
    """Train rows: the fold's out-of-fold value (fold prior when the key is
    unseen in the other folds); other rows: full-fit value (global prior when unseen)."""
    oof = None
    for f in range(k):
        v = F.coalesce(F.col(f"{prefix}te_f{f}{w}"), F.lit(fold_priors[f]))
        oof = F.when(fold == f, v) if oof is None else oof.when(fold == f, v)
    full = F.coalesce(F.col(f"{prefix}te_full{w}"), F.lit(prior))
    return F.when(F.col(split) == "train", oof).otherwise(full)


# ------------------------------------------------------------- account tables

def _account_rows(combined: DataFrame, account: str, refs: dict, ways: tuple, splits: tuple, scale) -> DataFrame:
    """The one aggregate of the rows per account: statistics of the reference rows (``refs``: suffix and condition of
    each reference), profile counts of all rows; per way its rows per split and its label sums of train."""
    found = []
    for r, is_ref in refs.items():
        a, period = F.when(is_ref, F.col(S.AMOUNT)), F.when(is_ref, F.col(S.PERIOD))
        found += [F.count_if(is_ref).alias(f"_ref{r}"), F.count(a).alias(f"_cnt{r}"),
                  money_sum(a, scale).alias(f"_sum{r}"), money_mean(a, scale).alias(f"_mean{r}"),
                  F.stddev_samp(a).alias(f"_std{r}"), F.min(period).alias(f"_pmin{r}"), F.max(period).alias(f"_pmax{r}")]
    found += PR.profile_counts()
    for w in ways:
        y = F.when(F.col(S.SPLIT + w) == "train", F.col(S.LABEL))
        found += [*[F.count_if(F.col(S.SPLIT + w) == s).alias(f"_n_{s}{w}") for s in splits],
                  F.sum(y).alias(f"_y{w}"), F.count(y).alias(f"_yn{w}")]
    return combined.filter(F.col(account).isNotNull()).groupBy(F.col(account).alias("account")).agg(*found)


def _side_columns(side: str, r: str) -> list:
    """Aggregate and graph columns of an account by one reference (null where the account has no rows there)."""
    v = SIDES[side]
    seen = F.col(f"_ref{r}") > 0
    degree = F.when(seen, F.coalesce(F.col(f"{v['kind']}_degree{r}"), F.lit(0)))
    span = F.col(f"_pmax{r}") - F.col(f"_pmin{r}") + 1
    g, p = f"{v['p']}_{v['kind']}", v["p"]
    return [c.alias(name + r) for name, c in (
        (f"{side}_txn_count", F.col(f"_cnt{r}")), (f"{side}_amount_sum", F.col(f"_sum{r}")),
        (f"{side}_amount_mean", F.col(f"_mean{r}")), (f"{side}_amount_std", F.col(f"_std{r}")),
        (f"{side}_period_min", F.col(f"_pmin{r}")), (f"{side}_period_max", F.col(f"_pmax{r}")),
        (v["distinct"], degree),
        (f"{g}_degree", degree), (f"{g}_count", F.col(f"_cnt{r}")), (f"{g}_amount_sum", F.col(f"_sum{r}")),
        (f"{g}_amount_mean", F.col(f"_mean{r}")), (f"{p}_period_span", span),
        (f"{p}_{v['rate']}", degree / clip(span.cast("double"), lo=1.0)),
        (f"{p}_cycle2_count", F.when(seen, F.col(f"{p}_cycle2_count{r}"))),
        (f"{p}_pagerank", F.when(seen, F.col(f"pagerank{r}"))))]


# ------------------------------------------------------ PageRank rank gap

def _rank_pct(side: DataFrame, p: str, splits: tuple, bounds: list, nulls: dict, r: str = "", w: str = "") -> tuple[DataFrame, dict]:
    """The rank percentiles (ties averaged) of an account's PageRank among the rows of each split, per rank ``_v``, and the
    percentile of rows without account.

    Works on the account table alone: it knows the rows per split.  Rows
    without account (``nulls``: their number per split) rank as 0.
    """
    spark = side.sparkSession
    per_split = F.explode(F.array(*[F.struct(F.lit(s).alias(S.SPLIT), F.col(f"{p}_n_{s}{w}").alias("_c")) for s in splits]))
    counts = side.select(_rank(p, r).alias("_v"), per_split.alias("_e")).select(F.col(f"_e.{S.SPLIT}"), "_v", "_e._c")
    if any(nulls.values()):
        counts = counts.unionByName(spark.createDataFrame([(s, 0.0, n) for s, n in nulls.items()],
                                                          f"{S.SPLIT} string, _v double, _c long"))
    per_value = (counts.filter(F.col("_c") > 0).groupBy(S.SPLIT, "_v").agg(F.sum("_c").alias("_cnt")))
    per_value = materialize(per_value, "rank_values")
    totals = per_value.groupBy(S.SPLIT).agg(F.sum("_cnt").alias("_n"))
    pref = ordered_prefix(per_value, "_v", {"_before": F.col("_cnt")}, [S.SPLIT], inclusive=False, bounds=bounds)
    pct = (pref.join(F.broadcast(totals), S.SPLIT)   # one row per split
           .select(S.SPLIT, "_v", ((F.col("_before") + (F.col("_cnt") + 1) / 2.0) / F.col("_n")).alias("_pct")))
    zero = {}
    if any(nulls.values()):
        zero = {x[S.SPLIT]: x["_pct"] for x in pct.filter(F.col("_v") == 0.0).collect()}   # one row per split
    by_value = pct.groupBy("_v").agg(*[F.max(F.when(F.col(S.SPLIT) == s, F.col("_pct"))).alias(f"{p}_pct_{s}{w}")
                                       for s in splits])
    return by_value, zero


def _rank(p: str, r: str) -> F.Column:
    return F.coalesce(F.col(f"{p}_pagerank{r}"), F.lit(0.0))


def _pick_pct(p: str, account: str, splits: tuple, zero: dict, w: str = "") -> F.Column:
    out = F.lit(None).cast("double")
    for s in splits:
        v = F.col(f"{p}_pct_{s}{w}")
        if s in zero:
            v = F.when(F.col(account).isNull(), F.lit(zero[s])).otherwise(v)
        out = F.when(F.col(S.SPLIT + w) == s, v).otherwise(out)
    return out


def _join_dealt(rows: DataFrame, table: DataFrame, keys: list) -> DataFrame:
    """Left join with a table of known keys of the same types; rows that lack a key match nothing and are dealt to the tasks by their id."""
    lacking = reduce(or_, [F.col(c).isNull() for c in keys])
    dealt = F.xxhash64(*keys)   # follows from the keys, so it rules out no match
    rows = rows.withColumn("_deal", F.when(lacking, F.xxhash64(S.ID)).otherwise(dealt))
    return rows.join(table.withColumn("_deal", dealt), [*keys, "_deal"], "left").drop("_deal")


# ---------------------------------------------------------------- builder

def build_feature_table(
    train: DataFrame,
    test: DataFrame | None = None,
    k: int = K_FOLDS,
    m: float = S.TE_SMOOTHING,
    seed: int = S.RANDOM_STATE,
    iso_forest=None,
    causal_mode: str = "auto",
    causal_kw: dict | None = None,
    scale=S.AMOUNT_SCALE,
    unsupervised_ref: str = "combined",
    blocks: tuple = ("graph", "profile", "rolling"),
    valid: DataFrame | None = None,
    iso: bool = False,
) -> DataFrame:
    """All features for train (OOF encodings) and for valid and test (full-fit encodings).

    ``unsupervised_ref='train'`` fits aggregates and graph on the train rows only
    (the reference's temporal validation); profiles, anomaly scores and causal
    windows always use all rows.  ``valid`` rows carry their own split tag, so
    they are ranked among themselves.  ``blocks`` selects the optional blocks
    (the reduced CV feature set drops graph, profile and rolling).

    Returns ``id, split, fraud_flag, origin_account, destination_account`` and
    the feature columns of :func:`feature_names` (the anomaly score only when
    ``iso_forest`` is given or ``iso`` asks to fit one on all rows).
    """
    others = [(name, d) for name, d in (("valid", valid), ("test", test)) if d is not None]
    splits = ("train", *[name for name, _ in others])
    # the input rows are read by several branches: compute them once
    combined = materialize(SP.combine_splits(train, *others), "combined")
    return _features(combined, ("",), splits, k, m, seed, iso_forest, causal_mode, causal_kw, scale, unsupervised_ref, blocks, iso)


def build_fold_features(
    rows: DataFrame,
    ways: dict,
    k: int = K_FOLDS,
    m: float = S.TE_SMOOTHING,
    seed: int = S.RANDOM_STATE,
    iso_forest=None,
    causal_mode: str = "auto",
    causal_kw: dict | None = None,
    scale=S.AMOUNT_SCALE,
    unsupervised_ref: str = "combined",
    blocks: tuple = ("graph", "profile", "rolling"),
    iso: bool = False,
) -> DataFrame:
    """The features of the same rows split in several ways, in one table for :func:`fold_table`.

    ``ways`` gives each way's suffix (of its own: no name of a column may end with it) and the split of a row ('train', 'valid', 'test') as a column.  What depends on the rows
    alone (causal windows, profiles, anomaly scores; with ``unsupervised_ref='combined'`` aggregates and graph as well) is
    computed once and the rows go through one join and one window per side; encodings, rank gaps and statistics of a
    reference of train rows are columns per way, named with its suffix.  A row may be outside of a way (null split) if it is
    not earlier than the way's rows and ``blocks`` has no profiles, with a reference of train rows: nothing of it reaches them.
    """
    combined = materialize(rows.select("*", *[c.alias(S.SPLIT + w) for w, c in ways.items()]), "combined")
    return _features(combined, tuple(ways), ("train", "valid", "test"), k, m, seed, iso_forest, causal_mode, causal_kw, scale,
                     unsupervised_ref, blocks, iso)


def fold_table(table: DataFrame, way: str) -> DataFrame:
    """The feature table of one way from a table of :func:`build_fold_features`."""
    made = set(table.columns)
    found = [(n, n + way if n + way in made else n) for n in feature_names()]
    return (table.filter(F.col(S.SPLIT + way).isNotNull())
            .select(S.ID, F.col(S.SPLIT + way).alias(S.SPLIT), S.LABEL, S.ORIGIN, S.DEST,
                    *[F.col(c).alias(n) for n, c in found if c in made]))


def _features(combined, ways, splits, k, m, seed, iso_forest, causal_mode, causal_kw, scale, unsupervised_ref, blocks, iso) -> DataFrame:
    """The feature columns of the written rows ``combined``.  ``ways`` are the suffixes of their split columns; what depends on the
    split has the suffix of its way, what depends on the reference that of its way as well, or none if the reference is all rows."""
    causal_kw = dict(causal_kw or {})
    is_train = {w: F.col(S.SPLIT + w) == "train" for w in ways}
    refs = {"": F.lit(True)} if unsupervised_ref == "combined" else is_train
    ref_of = {w: "" if unsupervised_ref == "combined" else w for w in ways}
    any_train = reduce(or_, is_train.values())
    label = {w: F.when(c, F.col(S.LABEL)) for w, c in is_train.items()}
    # ---- the rows once per account pair and once per account of each side; what reads only the rows runs side by side
    label_sums = [c for w, y in label.items() for c in (F.sum(y).alias(f"_y{w}"), F.count(y).alias(f"_yn{w}"))]
    pairs = (combined.filter(F.col(S.ORIGIN).isNotNull() & F.col(S.DEST).isNotNull())
             .groupBy(F.col(S.ORIGIN).alias("src"), F.col(S.DEST).alias("dst"))
             .agg(*[c for r, is_ref in refs.items() for c in (
                 F.coalesce(money_sum(F.when(is_ref, F.col(S.AMOUNT)), scale), F.lit(0.0)).alias(f"weight{r}"),
                 F.count_if(is_ref).alias(f"rows{r}"))], *label_sums))
    # labelled rows without an origin account: their fold goes by the id; sums per (destination, operation, fold)
    row_fold = SP.fold_of_row(k, S.ID, seed)
    lone = (combined.filter(any_train & F.col(S.ORIGIN).isNull())
            .groupBy(F.col(S.DEST).alias("dst"), S.OPERATION, row_fold.alias("fold")).agg(*label_sums))
    split_sums = combined.agg(
        *[c for w, y in label.items() for c in (F.sum(y).alias(f"s{w}"), F.count(y).alias(f"n{w}"))],
        *[F.count_if((F.col(S.SPLIT + w) == s) & F.col(a).isNull()).alias(f"no_{p}_{s}{w}")
          for w in ways for s in splits for p, a in (("o", S.ORIGIN), ("d", S.DEST))],
        *[F.count_if(F.col(a).isNull()).alias(f"no_{p}") for p, a in (("o", S.ORIGIN), ("d", S.DEST))])
    pairs, o_rows, d_rows, lone, sums, amounts, iso_forest = together([
        lambda: materialize(pairs, "pairs"),
        lambda: materialize(_account_rows(combined, S.ORIGIN, refs, ways, splits, scale), "origin_rows"),
        lambda: materialize(_account_rows(combined, S.DEST, refs, ways, splits, scale), "dest_rows"),
        lambda: materialize(lone, "lone"),
        lambda: split_sums.first(),
        lambda: boundaries(combined, S.AMOUNT, DEFAULT_BUCKETS) if "profile" in blocks else [],   # one sketch for both sides
        lambda: AN.fit_isolation_forest(B.add_balance_features(combined)) if iso and iso_forest is None else iso_forest,
    ])
    prior = {w: float(sums[f"s{w}"] or 0) / sums[f"n{w}"] if sums[f"n{w}"] else 0.0 for w in ways}

    def way_sums(df, w, *keys):
        return df.select(*keys, F.col(f"_y{w}").alias("_y"), F.col(f"_yn{w}").alias("_yn"))

    # ---- folds with their sums, the graph, the quartiles: each from the written tables or the rows
    def fold_sums(w):
        dealt = SP.deal_folds(o_rows.filter(F.col(f"_n_train{w}") > 0)
                              .select(F.col("account").alias(S.ORIGIN), F.col(f"_n_train{w}").alias("_n"),
                                      F.col(f"_y{w}").alias("_pos")), k, S.ORIGIN, seed)
        folds = materialize(dealt, "folds").withColumnRenamed(S.ORIGIN, "account")
        found = (way_sums(o_rows.join(folds, "account"), w, "fold").unionByName(way_sums(lone, w, "fold"))
                 .groupBy("fold").agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("s"), F.sum("_yn").alias("n")))
        return folds, {x["fold"]: x for x in found.collect()}   # one row per fold

    def ref_pairs(r):
        return pairs.filter(F.col(f"rows{r}") > 0).select("src", "dst", F.col(f"weight{r}").alias("weight"), F.col(f"rows{r}").alias("rows"))

    def graph_nodes(r):
        ranks = G.pagerank(ref_pairs(r), scale=scale)[0] if "graph" in blocks else None
        nodes = G.account_graph(ref_pairs(r), ranks)
        nodes = materialize(nodes.select("account", *[F.col(c).alias(c + r) for c in nodes.columns if c != "account"]), "nodes")   # one table of all accounts
        return nodes, boundaries(nodes, f"pagerank{r}", DEFAULT_BUCKETS) if "graph" in blocks else []   # one sketch for both sides

    def account_quartiles(account):
        if "profile" not in blocks:
            return None
        q = exact_quantiles(combined.filter(F.col(account).isNotNull()), S.AMOUNT, [0.25, 0.5, 0.75], [account], prefix="_q", bounds=amounts)
        return materialize(q.withColumnRenamed(account, "account"), "quartiles")

    done = together([*[partial(graph_nodes, r) for r in refs], *[partial(fold_sums, w) for w in ways],
                     partial(account_quartiles, S.ORIGIN), partial(account_quartiles, S.DEST)])
    graphs, dealt_folds = dict(zip(refs, done)), dict(zip(ways, done[len(refs):]))
    o_quartiles, d_quartiles = done[-2:]
    folds = {w: d[0] for w, d in dealt_folds.items()}
    fold_priors = {w: dict.fromkeys(range(k), float("nan")) for w in ways}
    for w, (_, per_fold) in dealt_folds.items():
        tot_s, tot_n = sum(x["s"] for x in per_fold.values()), sum(x["n"] for x in per_fold.values())
        for f, x in per_fold.items():
            if tot_n > x["n"]:
                fold_priors[w][int(f)] = (tot_s - x["s"]) / (tot_n - x["n"])

    # ---- side tables
    def te_table(by_key, w, p, *keys):
        """Rates per key; columns ``{p}_te_full``, ``{p}_te_f{fold}`` with the way's suffix."""
        return by_key.select(*keys, *[c.alias(f"{p}_{n}{w}") for c, n in zip(
            _te_columns(prior[w], fold_priors[w], m, k), ["te_full", *[f"te_f{f}" for f in range(k)]])])

    def side_te(side, w):
        if side == "dest":
            parts = way_sums(pairs.filter(F.col(f"_yn{w}") > 0).withColumnRenamed("src", "account").join(folds[w], "account"), w, "dst", "fold")
            return te_table(_fold_sums(parts.unionByName(way_sums(lone.filter(F.col("dst").isNotNull()), w, "dst", "fold")), "dst", k), w, "d", "account")
        y, n = F.coalesce(F.col(f"_y{w}"), F.lit(0)), F.col(f"_yn{w}")
        by_account = o_rows.join(folds[w], "account").select(
            "account", F.col("fold").alias(f"_fold{w}"), y.alias("_ts"), n.alias("_tn"),
            *[F.when(F.col("fold") == f, y).otherwise(F.lit(0)).alias(f"_s{f}") for f in range(k)],
            *[F.when(F.col("fold") == f, n).otherwise(F.lit(0)).alias(f"_n{f}") for f in range(k)])
        return te_table(by_account, w, "o", "account", f"_fold{w}")

    def side_table(side, rows, q):
        """The written table of a side (one row per account), the same with rank percentiles, and per way the percentiles of rows without account."""
        v = SIDES[side]
        table, own = rows, []
        for r in refs:
            table = table.join(graphs[r][0], "account", "left")
        for w in ways:
            te = side_te(side, w)
            table = table.join(te, "account", "left")
            own += [*[F.col(f"_n_{s}{w}").alias(f"{v['p']}_n_{s}{w}") for s in splits], *[c for c in te.columns if c != "account"]]
        if q is not None:
            table = table.join(q, "account", "left")
            quartiles = [F.col(f"_q{i}") for i in range(3)]
        else:
            quartiles = [F.lit(None).cast("double")] * 3
        table = table.select(F.col("account").alias(v["account"]), *[c for r in refs for c in _side_columns(side, r)],
                             *PR.profile_output(v["profile"], quartiles), *own)
        table = materialize(table, f"{side}_side")
        if "graph" not in blocks:
            return table, table, dict.fromkeys(ways, {})
        p = v["p"]
        found = dict(zip(ways, together([
            partial(_rank_pct, table, p, splits, graphs[ref_of[w]][1], {s: sums[f"no_{p}_{s}{w}"] for s in splits}, ref_of[w], w) for w in ways])))
        ranked = table
        for w, (by_value, _) in found.items():
            ranked = ranked.withColumn("_v", _rank(p, ref_of[w])).join(by_value, "_v", "left").drop("_v")
        return table, ranked, {w: zero for w, (_, zero) in found.items()}

    op_rows = (combined.filter(any_train & F.col(S.OPERATION).isNotNull() & F.col(S.ORIGIN).isNotNull())
               .groupBy(F.col(S.ORIGIN).alias("account"), S.OPERATION).agg(*label_sums))

    def operation_table():
        parts = materialize(op_rows, "operation_rows") if len(ways) > 1 else op_rows
        table = None
        for r, is_ref in refs.items():
            stats = A.operation_stats(combined if unsupervised_ref == "combined" else combined.filter(is_ref), scale)
            stats = stats.select(S.OPERATION, *[F.col(c).alias(c + r) for c in stats.columns if c != S.OPERATION])
            # an operation that a reference lacks is joined as one without statistics
            table = stats if table is None else table.join(stats, S.OPERATION, "full")
        for w in ways:
            by_fold = way_sums(parts.join(folds[w], "account"), w, S.OPERATION, "fold")
            by_op = _fold_sums(by_fold.unionByName(way_sums(lone.filter(F.col(S.OPERATION).isNotNull()), w, S.OPERATION, "fold")), S.OPERATION, k)
            table = table.join(te_table(by_op, w, "p", F.col("account").alias(S.OPERATION)), S.OPERATION, "left")
        return materialize(table, "operations")

    done = together([
        lambda: side_table("origin", o_rows, o_quartiles), lambda: side_table("dest", d_rows, d_quartiles), operation_table])
    op_side = done[2]
    tables, ranked, zero_pct = ({side: d[i] for side, d in zip(SIDES, done)} for i in range(3))
    pair_side = (pairs if len(refs) > 1 else pairs.filter(F.col(f"rows{[*refs][0]}") > 0)).select(
        F.col("src").alias(S.ORIGIN), F.col("dst").alias(S.DEST), *[F.col(f"rows{r}").alias(f"pair_count{r}") for r in refs])

    # ---- rows: one join and one window per side
    max_rows = causal_kw.get("max_rows_per_task", C.DEFAULT_MAX_ROWS_PER_TASK)
    mode = causal_mode
    rolling = "rolling" in blocks
    if mode == "auto":
        # rows per account are already in the written side tables (profile frequency); the rows
        # without an account are one window group as well
        hot = max(tables["origin"].agg(F.max("op_orig_amt_freq")).first()[0] or 0,
                  tables["dest"].agg(F.max("op_dest_amt_freq")).first()[0] or 0, sums["no_o"], sums["no_d"])
        mode = "chunked" if hot > max_rows else "plain"
    lone_o, lone_d = sums["no_o"] > 0, sums["no_d"] > 0
    rows = B.add_balance_features(combined)
    rows = B.encode_operation(rows)
    # the pairs first, while the rows are narrow: those that lack both accounts would all meet in one task of wide rows
    rows = _join_dealt(rows, pair_side, [S.ORIGIN, S.DEST]) if lone_o or lone_d else rows.join(pair_side, [S.ORIGIN, S.DEST], "left")
    for side, lone_rows in (("origin", lone_o), ("dest", lone_d)):
        account = SIDES[side]["account"]
        # the plain window reuses the join's partitioning; the chunked one does not
        dealt_out = lone_rows and mode == "chunked"
        rows = _join_dealt(rows, ranked[side], [account]) if dealt_out else rows.join(ranked[side], account, "left")
        rows = C.add_causal_features(rows, sides=(side,), rolling=rolling, mode=mode, amount_scale=scale, counted=combined, **causal_kw)
    rows = rows.join(op_side, S.OPERATION, "left")   # Spark broadcasts it where its size allows

    # ---- final projection with the reference's fills
    graph_cols = [c for c in G.GRAPH_COLUMNS if c != "graph_pagerank_gap"]
    graph = [F.coalesce(F.col(c + r), F.lit(0)).alias(c + r) for r in refs for c in graph_cols]
    rows = rows.withColumns({f"_fold{w}": F.coalesce(F.col(f"_fold{w}"), row_fold) for w in ways})
    te_cols = []
    for w in ways:
        if "graph" in blocks:
            o_pct = _pick_pct("o", S.ORIGIN, splits, zero_pct["origin"][w], w)
            d_pct = _pick_pct("d", S.DEST, splits, zero_pct["dest"][w], w)
            graph.append(F.coalesce(F.abs(o_pct - d_pct), F.lit(0.0)).alias(f"graph_pagerank_gap{w}"))
        pick = [_te_pick(f"{p}_", F.col(f"_fold{w}"), prior[w], fold_priors[w], k, S.SPLIT + w, w) for p in "pod"]
        te_cols += [c.alias(f"{n}_fraud_rate{w}") for c, n in zip(pick, S.TE_COLUMNS)]
    prof_cols = PR.profile_columns("op_orig") + PR.profile_columns("op_dest")
    out = rows.select(
        S.ID, *[S.SPLIT + w for w in ways], S.LABEL, S.ORIGIN, S.DEST, *S.RAW_FEATURES,
        *B.BALANCE_COLUMNS, *B.ENCODING_COLUMNS,
        *[c for r in refs for c in A.aggregate_projection(suffix=r)],
        *graph,
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in prof_cols],
        *te_cols,
        *(C.rolling_names() if rolling else []), *C.expanding_names(),
    )
    out = PR.apply_account_profiles_derived(out)
    if iso_forest is not None:
        out = out.withColumn("iso_anomaly_score", AN.score_column(iso_forest, out))
    names = feature_names(include_iso=iso_forest is not None)
    drop = set()
    if "graph" not in blocks:
        drop |= set(G.GRAPH_COLUMNS)
    if "profile" not in blocks:
        drop |= set(PR.profile_columns("op_orig") + PR.profile_columns("op_dest") + PR.PROFILE_DERIVED)
    if "rolling" not in blocks:
        drop |= set(C.rolling_names())
    made = set(out.columns)
    kept = [n + w for n in names if n not in drop for w in dict.fromkeys(("", *refs, *ways)) if n + w in made]
    return out.select(S.ID, *[S.SPLIT + w for w in ways], S.LABEL, S.ORIGIN, S.DEST, *kept)
