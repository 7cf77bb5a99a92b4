"""Hashed word features of whole texts, shared by the two classifiers."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerscope.llm.common import release

DIMS = 1 << 18
_GROUP_BYTES = 4_000_000
_SLICE = 1024  # rows that are judged and sent back at once


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (DIMS - 1)


def word_groups(texts: pa.Array) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Texts cut at ASCII white space, a bounded group of texts at a time.

    Gives the group's different words, the index of each word in reading order and the texts' bounds
    in it.  A null text has no words; the empty string can stand at the ends of a text and means nothing.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // _GROUP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            cut = pc.ascii_split_whitespace(texts.slice(a, b - a))
            coded = cut.flatten().dictionary_encode()
            offsets = np.asarray(cut.offsets)
            yield coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), offsets - offsets[0]


def collect_features(docs: DataFrame, wanted: DataFrame, extract: Callable, id_col: str, text_col: str) -> list[tuple]:
    """``(id, extra columns of wanted, feature buckets, values)`` of a bounded list of ids, in id order.

    ``extract`` gives buckets and values for each text, or None for values that are all one.
    ``wanted`` has a column ``id`` and at most as many rows as its documented bound, so it can be broadcast; a
    repeated id counts once.
    """
    extra = [c for c in wanted.columns if c != "id"]

    def run(batches):
        for b in batches:
            sparse = [x for group in word_groups(b.column(1)) for x in extract(*group)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[b.column(i + 2) for i in range(len(extra))],
                 pa.array([i.astype("<u4").tobytes() for i, _ in sparse], pa.binary()),
                 pa.array([b"" if v is None else v.astype("<f4").tobytes() for _, v in sparse], pa.binary())], ["id", *extra, "idx", "val"])

    kinds = "".join(f", {n} {t}" for n, t in wanted.dtypes if n != "id")
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(wanted), "id").select("id", "text", *extra)
            .mapInArrow(run, f"id long{kinds}, idx binary, val binary")
            .dropDuplicates(["id"]).collect())
    return [(*[r[c] for c in ("id", *extra)], np.frombuffer(r["idx"], "<u4"), np.frombuffer(r["val"], "<f4"))
            for r in sorted(rows, key=lambda r: r["id"])]


def first_by_hash(ids: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` rows, the first in the order of the hash of ``id``: the same ones at every run."""
    return ids.orderBy(F.xxhash64("id"), "id").limit(bound)


def one_label(labels: DataFrame, id_col: str, label_col: str, train) -> DataFrame:
    """``(id, label)`` of the rows that ``train`` allows; nulls are left out, the larger of an id's labels counts."""
    return (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & train(F.col("id")))
            .groupBy("id").agg(F.max("label").alias("label")))


def id_remainder(column, n: int):
    """crc32 of the id written as text, modulo ``n``."""
    return F.crc32(column.cast("string").cast("binary")) % n


def score_texts(docs: DataFrame, score_group: Callable, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``."""
    def run(batches):
        for b in batches:
            scores = [score_group(*group) for group in word_groups(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between each two neighbouring bounds."""
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return total[bounds[1:]] - total[bounds[:-1]]


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def keep_scored(docs: DataFrame, score_group: Callable, text_col: str, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, judged where they lie."""
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, _SLICE):
                b = whole.slice(first, _SLICE)
                scores = [score_group(*group) for group in word_groups(b.column(at))]
                yield b.filter(pa.array((np.concatenate(scores) if scores else np.zeros(0)) >= threshold))
            release()
    return docs.mapInArrow(run, docs.schema)
