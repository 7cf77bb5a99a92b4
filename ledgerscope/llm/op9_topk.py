"""Exact top-k inner products by no-random-access (NRA) aggregation.

The rows are dealt into blocks of candidates and blocks of queries, each pair of blocks being one unit of work.
In a unit every component has its list of candidates sorted by value.  For a query the lists are read in step
from their better end, to the depths of ``DEPTHS`` and at last their whole length; what a candidate has shown so far plus the
least (most) that its unread components can still give bounds its score from below (above).  Reading stops when at
most a few candidates can still reach the k-th best lower bound; their scores are then resolved, and the best k of all
units are merged.  Bounds are inclusive, so ties go to the smaller id as asked.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerscope.llm.common import read
from ledgerscope.session import materialize

K, SCALE, QUERY_STEP = 20, 64, 20
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 256
DEPTHS = (1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16)  # shares of the lists after which the stop rule is asked


class Lists:
    """The sorted lists of a block of candidates: for each component one from the largest value down and one from the least up.

    A list's first ``depth`` entries are held as a row of a matrix with a place for each candidate (zero: not read
    yet), so that one product reads a prefix of all lists for all queries of a block.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        up = np.argsort(self.vectors, axis=0, kind="stable")
        values = np.take_along_axis(self.vectors, up, axis=0)
        place = np.empty_like(up)
        np.put_along_axis(place, up, np.arange(len(ids))[:, None], axis=0)
        self.values = np.concatenate([values[::-1], values], axis=1)  # entry, list
        self.place = np.concatenate([len(ids) - 1 - place, place], axis=1)  # candidate, list: where the candidate stands

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of the best k, by score and then id; ``own`` takes no part."""
        n, out = len(self.ids), [None] * len(queries)
        self.stops = np.zeros(len(queries), np.int64)  # how deep the lists were read for each query
        # a positive component reads its list from the top, a negative one from the bottom
        asked = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
        most = np.abs(asked).sum(1).max(initial=0) * np.abs(self.vectors).max(initial=0)
        real = np.float32 if most < 1 << 23 else np.float64  # whole numbers, exact in both
        asked, open_ = asked.astype(real), np.arange(len(queries))
        both = np.concatenate([self.vectors, self.vectors], axis=1).astype(real)
        worst = self.values[-1].astype(real)
        for depth in sorted({*(max(1, int(n * share)) for share in DEPTHS), n}):
            read = self.place < depth
            part = asked[open_]
            shown = part @ np.where(read, both, 0).T
            read = read.astype(real)
            rest = lambda value: (w := part * value).sum(1, keepdims=True) - w @ read.T
            low, high = (shown, shown) if depth == n else (shown + rest(worst), shown + rest(self.values[depth - 1].astype(real)))
            mine = self.ids[None, :] == own[open_, None]
            low = np.where(mine, -np.inf, low)
            bar = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), -np.inf)
            alive = (high >= bar[:, None]) & ~mine
            done = (alive.sum(1) <= 4 * k) | (depth == n)
            self.stops[open_[done]] = depth
            for j in np.flatnonzero(done):  # outsiders cannot qualify any more: resolve the others
                left = np.flatnonzero(alive[j])
                scores = self.vectors[left] @ queries[open_[j]]
                best = np.lexsort((left, -scores))[:k]
                out[open_[j]] = self.ids[left[best]], scores[best]
            open_ = open_[~done]
            if not len(open_):
                break
        return out


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v)`` of the rows that take part, v in whole numbers."""
    ok = F.col(id_col).isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (table.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias("x")).where(ok)
            .select(F.col(id_col).alias("id"), F.transform("x", lambda e: F.floor(e * float(scale))).alias("v")))


def _matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of whole numbers; a short vector is zero from its end on."""
    lists = vectors.combine_chunks()
    out = np.zeros((len(lists), dims), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lists)), sizes)
    flat = lists.flatten().to_numpy()
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def top_k(table: DataFrame, is_query, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
          candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query(id)`` its k best other rows.

    Rows without an id, or whose vector is null or holds a null or non-finite component, take no part; vectors of
    different lengths are compared as if filled up with zeros; a repeated id is one query, its own rows are no
    candidates for it, and other repeats rank each for itself; an empty table gives an empty result; other
    columns are not read.
    """
    vectors = materialize(whole_vectors(table, id_col, vector_col, scale), "vectors")
    queries = vectors.where(is_query(F.col("id"))).dropDuplicates(["id"])
    n = vectors.count()
    c_blocks = max(1, -(-n // candidate_block))
    q_blocks = max(1, -(-queries.count() // query_block))
    deal = lambda df, mine, others, n_mine, n_others: df.select(
        F.pmod(F.xxhash64("id", "v"), F.lit(n_mine)).cast("int").alias(mine), "id", "v",
        F.explode(F.sequence(F.lit(0), F.lit(n_others - 1))).alias(others))
    left = deal(queries, "qb", "cb", q_blocks, c_blocks).groupBy("qb", "cb")
    right = deal(vectors, "cb", "qb", c_blocks, q_blocks).groupBy("qb", "cb")

    def run(asked: pa.Table, offered: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if asked.num_rows and offered.num_rows:
            dims = max(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for t in (asked, offered) for c in t.column("v").chunks)
            lists = Lists(offered.column("id").to_numpy(), _matrix(offered.column("v"), dims))
            names = asked.column("id").to_numpy()
            for q, (ids, scores) in zip(names, lists.top(_matrix(asked.column("v"), dims), names, k)):
                found.append((np.full(len(ids), q), ids, scores))
        cols = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], ["query_id", "vec_id", "score"])

    best = left.cogroup(right).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), lambda i: i % QUERY_STEP == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
