"""Sequence packing by patterns of document lengths.

Packing is decided on the histogram of piece lengths, whose size is bounded by the capacity and not by
the data.  Lengths fall into 64 classes; the patterns of at most four classes that fill a sequence
are enumerated, and non-negative least squares finds how often to repeat each so that together they use up
the class histogram.  The counts are rounded down and carried out with real lengths, the last place of a
pattern going to the best fitting length.  What remains, and any room left in those sequences, is packed by best-fit decreasing, for all
pieces of a length at once.  The plan is a list of runs ("pieces r to s of length L go to sequences a, a+1, ... at
offset o"), and each piece finds its run from its length and its rank among the pieces of that length.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerscope.llm import tokens
from ledgerscope.llm.common import map_batches, read, release
from ledgerscope.session import materialize

CAPACITY, END_ID = 4096, 1
CLASSES, MOST_DOCS, LEAST_CLASS = 64, 4, 3
_GROUP_BYTES = 2_000_000  # of text that a task encodes at once


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """argmin |a x - b| over x >= 0 by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * n):
        grad = a.T @ (b - a @ x)
        grad[active] = -np.inf
        j = int(np.argmax(grad))
        if grad[j] <= tol * scale:
            break
        active[j] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (s <= tol)
            if not bad.any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            active &= x > tol
            x[~active] = 0
        x = s
    return x


def patterns(classes: int, most: int, least: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``most`` classes, none below ``least``, that add up to ``classes``; largest class first."""
    out = []

    def grow(head, left, top):
        if left == 0:
            out.append(head)
        elif len(head) < most:
            for c in range(min(left, top), least - 1, -1):
                grow((*head, c), left - c, c)

    grow((), classes, classes)
    return out


class _Plan:
    def __init__(self, hist: dict[int, int], capacity: int):
        self.left, self.capacity = {k: v for k, v in hist.items() if v}, capacity
        self.lengths = sorted(self.left)
        self.rank, self.runs, self.sequences = Counter(), [], 0
        self.room: dict[int, list] = defaultdict(list)  # free tokens -> runs (first sequence, how many)
        self.free: list[int] = []

    def put(self, length: int, bins: int, each: int, first: int, offset: int) -> None:
        """``each`` pieces of ``length`` into each of ``bins`` sequences from ``first`` on."""
        self.runs.append((length, self.rank[length], bins * each, each, first, offset))
        self.rank[length] += bins * each
        self.left[length] -= bins * each

    def open(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            if not self.room[room]:
                insort(self.free, room)
            self.room[room].append((first, bins))

    def carry_out(self, pattern: tuple[int, ...], times: int, classes: dict[int, list[int]]) -> None:
        """Fill ``times`` new sequences or fewer: each class gives its longest piece, and the last place the best fit."""
        while times:
            members: list[int] = []
            for c in pattern[:-1] or pattern:
                while classes[c] and self.left[classes[c][-1]] <= members.count(classes[c][-1]):
                    if self.left[classes[c][-1]]:
                        return
                    classes[c].pop()
                if not classes[c]:
                    return
                members.append(classes[c][-1])
            if len(pattern) > 1:
                i = bisect_right(self.lengths, self.capacity - sum(members)) - 1
                while i >= 0 and self.left[self.lengths[i]] <= members.count(self.lengths[i]):
                    if not self.left[self.lengths[i]]:
                        self.lengths.pop(i)
                    i -= 1
                if i < 0:
                    return
                members.append(self.lengths[i])
            bins, offset = min([times, *(self.left[x] // k for x, k in Counter(members).items())]), 0
            for x in members:
                self.put(x, bins, 1, self.sequences, offset)
                offset += x
            self.open(self.capacity - offset, self.sequences, bins)
            self.sequences += bins
            times -= bins

    def best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            while n := self.left[length]:
                i = bisect_left(self.free, length)
                if i < len(self.free):
                    room = self.free[i]
                    first, bins = self.room[room].pop()
                    if not self.room[room]:
                        self.free.pop(i)
                else:
                    room, first, bins = self.capacity, self.sequences, n
                    bins = -(-n // (room // length))
                    self.sequences += bins
                each = min(room // length, n)
                full = min(bins, n // each)
                self.put(length, full, each, first, self.capacity - room)
                self.open(room - each * length, first, full)
                if room < self.capacity or bins > full:
                    self.open(room, first + full, bins - full)


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs ``(length, first rank, pieces, pieces a sequence, first sequence, offset)`` and the number of sequences."""
    out = _Plan(hist, capacity)
    grain = max(1, -(-capacity // CLASSES))
    classes: dict[int, list[int]] = defaultdict(list)
    for length in out.lengths:
        classes[-(-length // grain)].append(length)
    top = capacity // grain
    have = np.array([sum(out.left[x] for x in classes[c]) for c in range(top + 1)], float)
    shapes = [p for p in patterns(top, MOST_DOCS, min(LEAST_CLASS, top)) if all(have[c] for c in p)]
    if shapes:
        a = np.zeros((top + 1, len(shapes)))
        for j, p in enumerate(shapes):
            for c in p:
                a[c, j] += 1
        weight = np.sqrt(np.arange(top + 1) / top)  # a long piece left over costs more than a short one
        counts = np.floor(nnls(a * weight[:, None], have * weight) + 1e-6).astype(int)
        for j in np.argsort(-counts, kind="stable"):
            if counts[j] > 0:
                out.carry_out(shapes[j], int(counts[j]), classes)
    out.best_fit()
    return out.runs, out.sequences


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids and end id, cut only where they exceed ``capacity``.

    ``part`` and ``nth`` number the pieces of a length within an input partition.
    """
    schema = ("doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids)

    def run(batches):
        release()  # what earlier stages of the same worker left
        part, seen = TaskContext.get().partitionId(), Counter()
        encode_all, end = tokens.encoder(tokenizer, True).encode_all, np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for name, ids in zip(b.column(0).to_pylist(), encode_all(b.column(1), _GROUP_BYTES)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at:at + 4 * capacity]
                    length = len(cut) // 4
                    rows.append((name, k, at // 4, length, zlib.crc32(cut), part, seen[length], cut)[:7 + with_ids])
                    seen[length] += 1
            if rows:
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names[:7 + with_ids])
            del rows
            release()

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids``.

    A null text is the empty one (its end id alone); rows without an id and repeated rows are packed like any
    other; an empty table gives no row; other columns are not read.  The cut pieces are written once
    before they are ranked, so a lost executor cannot change a rank.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    # at most `capacity` lengths reach the driver, whatever the size of the data
    runs, _ = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    # as many runs as the plan has steps: a function of the capacity, not of the number of documents
    steps = F.broadcast(cut.sparkSession.createDataFrame(
        runs, "length int, first_rank long, n_run long, each long, first_seq long, first_offset long"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    within = F.col("rank") - F.col("first_rank")
    placed = ranked.join(steps, "length").where((within >= 0) & (within < F.col("n_run")))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                         (F.col("first_seq") + F.floor(within / F.col("each"))).alias("sequence_id"),
                         (F.col("first_offset") + within % F.col("each") * F.col("length")).alias("offset"),
                         *(["ids"] if with_ids else []))


def word_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), word_tokenizer())
