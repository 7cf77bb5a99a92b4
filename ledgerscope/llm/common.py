"""Helpers shared by the operators of this package."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerscope.session import materialize


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Arrow batches through ``fn``; input partitions stay as Spark dealt them."""
    return df.mapInArrow(fn, schema)


def release() -> None:
    """Freed memory goes back to the system: a Python worker serves one stage after the other and would keep the most that any of them needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def as_bytes(column) -> list[bytes]:
    """A text column as UTF-8 bytes; null is the empty text."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def as_texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an undirected edge list as ``(node, root)``; root is the smallest node.

    Each round points every node at the smallest node of its closed neighbourhood, follows the
    pointers once more and contracts the edges to the remaining roots, so paths shrink
    geometrically.  Every round is one written table per step (``materialize``: the shared
    checkpoint folder), never a driver-side list.  Nodes without an edge are absent.
    """
    links = materialize(edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
                        .where("u < v").distinct(), "links")
    steps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
        low = materialize(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("p")), "low")
        up = low.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        step = materialize(low.join(up, "p").select(F.col("u").alias("node"), F.col("pp").alias("root")), "step")
        steps.append(step)
        a = step.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = step.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        links = materialize(links.join(a, "u").join(b, "v").where("ru <> rv")
                            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links")
    if not steps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
