"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into ``distance + 2`` blocks.  Two fingerprints that differ in at most
``distance`` bits leave at least two blocks untouched, so they share one of the C(distance + 2, 2)
keys made of a pair of blocks; every candidate is then verified by its Hamming distance.  Pairs of
blocks make keys of about 26 bits, so a bucket stays small on a large corpus.

Exact copies collapse to one fingerprint before any key is made.  A bucket with more than ``chunk``
different fingerprints (a hot group of near copies) is cut into chunks, and each pair of chunks is its
own unit of work, so no task holds the bucket.  A unit reports a spanning forest of its verified links,
not all its pairs: the components are the same and the output is linear.
"""
from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerscope.llm.common import as_bytes, components, map_batches, read
from ledgerscope.session import materialize

SEED = 42
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """SimHash of the word shingles of one text, repeats included; no words give zero."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(_hash, shingles), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def text_key(text):
    """With the id, the key of a row: equal for equal texts."""
    return F.xxhash64(text.cast("string"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, key, fp)``, fp as a signed long with the bits of the fingerprint, key the text's ``text_key``."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(b.column(1))], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(fps)], ["doc_id", "key", "fp"])
    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), text_key(F.col(text_col)))
    return map_batches(picked, run, "doc_id long, key long, fp long")


def block_masks(distance: int) -> list[int]:
    """Signed masks of every pair of the ``distance + 2`` blocks of 64 bits."""
    n = distance + 2
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(n)]
    masks = [a | b for a, b in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph of fingerprints within ``distance`` bits."""
    left, us, vs = np.arange(len(fps)), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            found, left = left[near], left[~near]
            us.append(np.full(len(found), at))
            vs.append(found)
            todo.extend(found)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(us).astype(np.int64), cat(vs).astype(np.int64)


SMALL_UNIT = 8


def _unit_links(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, distance: int):
    """Links inside the units ``[start, end)`` of consecutive rows: small ones all at once, others one by one."""
    sizes = ends - starts
    us, vs = [], []
    small, sz = starts[sizes <= SMALL_UNIT], sizes[sizes <= SMALL_UNIT]
    for i, j in combinations(range(SMALL_UNIT), 2):
        at = small[sz > j]
        if len(at):
            near = np.bitwise_count(fps[at + i] ^ fps[at + j]) <= distance
            us.append((at + i)[near])
            vs.append((at + j)[near])
    for s, e in zip(starts[sizes > SMALL_UNIT], ends[sizes > SMALL_UNIT]):
        u, v = spanning_links(fps[s:e], distance)
        us.append(u + s)
        vs.append(v + s)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(us), cat(vs)


def verified_links(nodes: DataFrame, distance: int = 3, chunk: int = 1024) -> DataFrame:
    """Links ``(u, v)`` between different fingerprints; their transitive closure is that of all pairs within ``distance``."""
    masks = block_masks(distance)
    keys = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                                 for i, m in enumerate(masks)])).alias("k")).select("fp", "k.*")
    # units: one per bucket, or one per pair of chunks of a hot bucket
    sizes = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = (keys.join(sizes, ["t", "key"])
             .withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
             .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
             .withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("fp", "t", "key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j")))
    unit = ["t", "key", "i", "j"]

    def run(batches):
        def links(fps, ids):
            cut = np.flatnonzero(np.any(ids[1:] != ids[:-1], axis=1)) + 1
            u, v = _unit_links(fps, np.r_[0, cut], np.r_[cut, len(fps)], distance)
            return pa.RecordBatch.from_arrays([pa.array(fps[u].view("<i8")), pa.array(fps[v].view("<i8"))], ["u", "v"])

        fps, ids = np.zeros(0, "<u8"), np.zeros((0, 4), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            new = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5)], axis=1)
            fps, ids = np.concatenate([fps, b.column(0).to_numpy().view("<u8")]), np.concatenate([ids, new])
            whole = np.flatnonzero(np.any(ids != ids[-1], axis=1))  # the last unit may go on in the next batch
            if len(whole):
                end = whole[-1] + 1
                yield links(fps[:end], ids[:end])
                fps, ids = fps[end:], ids[end:]
        if len(fps):
            yield links(fps, ids)

    return map_batches(dealt.repartition(*unit).sortWithinPartitions(*unit), run, "u long, v long")


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int, chunk: int = 1024) -> DataFrame:
    """One row per document: ``doc_id, key, fp`` and ``first``, the least ``(doc_id, key)`` of its group (null if no member has an id)."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))
    nodes = materialize(fps.groupBy("fp").agg(F.min(named).alias("least")), "nodes")
    roots = components(verified_links(nodes, distance, chunk))
    classes = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = materialize(classes, "classes")
    names = classes.groupBy("root").agg(F.min("least").alias("first"))
    return fps.join(classes.join(names, "root").select("fp", "first"), "fp").select("doc_id", "key", "fp", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3,
                    chunk: int = 1024) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (signed long) and ``component_id``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``distance`` bits.  Null and
    empty texts have fingerprint zero and link like any other; a row without an id gets the
    component of its fingerprint (null if no member has an id); repeated rows are kept as they
    are; an empty table gives an empty result; columns besides the two named are not read.
    """
    found = grouped(docs, id_col, text_col, shingle, distance, chunk)
    return found.select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each group one row, with the smallest id and, if that id repeats in the group, the
    smallest text key; of rows that share both, the first by their content.

    An id that repeats in several groups names a row in each.  Rows without an id cannot be named as a copy and stay.
    """
    found = grouped(docs, id_col, text_col, shingle, distance).where("doc_id is not null")
    # written first: the joins then see their real size, and only ids and keys travel
    rows = materialize(found.groupBy("doc_id", "key").agg(F.first("first").alias("first"), F.count("*").alias("n")), "rows")
    own = F.struct("doc_id", "key")
    often = rows.where((own == F.col("first")) & (F.col("n") > 1))

    def is_row(named):
        return (docs[id_col].cast("long") == named["doc_id"]) & (text_key(docs[text_col]) == named["key"])

    away = rows.where((own != F.col("first")) | (F.col("n") > 1)).select("doc_id", "key")
    single = docs.join(away, is_row(away), "left_anti")
    whole = F.struct(*[docs[c] for c in docs.columns])
    equal = docs.join(often, is_row(often)).groupBy(often["doc_id"], often["key"]).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return single.unionAll(equal.select("row.*"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
