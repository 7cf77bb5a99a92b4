"""Benchmark decontamination by greedy string tiling.

Words are cut at Unicode white space, in scripts written without spaces at every character, and compared in lower case
without punctuation.  Karp-Rabin hashes of every run of ``min_match`` words of the
benchmark are joined with the running hashes of each text (a hash join whose small side is a bounded
block of benchmark items); equal hashes are verified word by word and joined along diagonals to maximal
matches.  Greedy tiling then marks the longest match whose words are all free, cuts what the marks
have broken, and goes on until no free match of ``min_match`` words is left.  The share of an item's
words under tiles does not depend on the order of its passages, so reordered leaks count in full.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerscope.llm.common import map_batches, read, release
from ledgerscope.llm.hashed import word_groups
from ledgerscope.session import materialize

MIN_MATCH, COVERAGE = 5, 0.5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NOT_WORD = re.compile(r"[\W_]+")
# Thai, Lao, Myanmar, Khmer, kana, Han with its extensions
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def normal(word: str) -> str:
    return _NOT_WORD.sub("", word.lower())


def cut(text: str) -> list[str]:
    """The words of an item or of a piece of a text."""
    return [w for w in map(normal, (text if text.isascii() else _UNSPACED.sub(r" \g<0> ", text)).split()) if w]


def running_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each window of ``size`` ids, modulo 2**64."""
    n = max(0, len(ids) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * _BASE + ids[k:k + n].astype(np.uint64)
    return h


class Index:
    """The words of a bounded block of benchmark items, put end to end, and where each seed hash stands."""

    def __init__(self, items: list[tuple[int, str]], min_match: int, short: bool = False):
        self.size, self.vocabulary, self.short = min_match, {}, {}
        words = [cut(text or "") for _, text in items]
        self.names, self.lengths = [name for name, _ in items], np.array([len(w) for w in words], np.int64)
        self.ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for ws in words for w in ws], np.int64)
        self.item = np.repeat(np.arange(len(items)), self.lengths)
        self.start = np.cumsum(self.lengths) - self.lengths
        at = np.flatnonzero(self.item[:len(self.item) - min_match + 1] == self.item[min_match - 1:]) if len(self.ids) >= min_match else np.zeros(0, np.int64)
        if short:  # words of the items that are too short for a seed, by their number
            for k in np.flatnonzero((self.lengths > 0) & (self.lengths < min_match)).tolist():
                self.short.setdefault(int(self.lengths[k]), {}).setdefault(tuple(self.ids[self.start[k]:self.start[k] + self.lengths[k]].tolist()), []).append(k)
        hashes = running_hashes(self.ids, min_match)[at]
        order = np.argsort(hashes, kind="stable")
        self.at = at[order]
        self.seeds, first = np.unique(hashes[order], return_index=True)
        self.first = np.r_[first, len(order)].astype(np.int64)

    def short_items(self, ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """``(doc, item)`` of the short items that stand in a text as a whole."""
        found = set()
        for length, sequences in self.short.items():
            wanted = np.unique(running_hashes(np.array(list(sequences), np.int64).ravel(), length)[::length])
            n = max(0, len(ids) - length + 1)
            for t in np.flatnonzero(np.isin(running_hashes(ids, length), wanted) & (doc[:n] == doc[length - 1:])).tolist():
                found.update((int(doc[t]), item) for item in sequences.get(tuple(ids[t:t + length].tolist()), ()))
        return sorted(found)

    def seeds_in(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``ids`` whose window has a seed's hash, and which seed's."""
        n = len(ids) - self.size + 1
        if n <= 0 or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unknown = np.r_[0, np.cumsum(ids == 0)]
        at = np.flatnonzero((unknown[self.size:] == unknown[:n]) & (doc[:n] == doc[self.size - 1:]))
        hashes = running_hashes(ids, self.size)[at]
        k = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        equal = self.seeds[k] == hashes
        return at[equal], k[equal]

    def verified(self, ids: np.ndarray, at: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of positions whose words are the same."""
        same = np.ones(len(at), bool)
        for j in range(self.size):
            same &= ids[at + j] == self.ids[there + j]
        return at[same], there[same]

    def places(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the seeds ``k`` all its places: the number in ``k`` and the place in the benchmark."""
        times = self.first[k + 1] - self.first[k]
        place = np.repeat(self.first[k] - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.repeat(np.arange(len(k)), times), self.at[place]

    def hits(self, ids: np.ndarray, doc: np.ndarray):
        """Verified seeds, position in ``ids`` and in the benchmark, a bounded number at a time: those of one text and item
        always together.  Texts and items that share more than ``PAIR_SEEDS`` are given as ``(doc, item)`` in place of them.
        """
        at, k = self.seeds_in(ids, doc)
        if not len(at):
            return
        times = self.first[k + 1] - self.first[k]
        bounds = np.flatnonzero(np.r_[True, np.diff(doc[at]) != 0, True])
        of_doc = np.add.reduceat(times, bounds[:-1])
        some, held = [], 0
        for first, last, n in zip(bounds[:-1].tolist(), bounds[1:].tolist(), of_doc.tolist()):
            if n <= PAIR_SEEDS:
                some.append(np.arange(first, last))
                held += n
            if some and (held > GROUP_SEEDS or last == len(at)):
                rows = np.concatenate(some)
                which, there = self.places(k[rows])
                yield self.verified(ids, at[rows][which], there)
                some, held = [], 0
            if n > PAIR_SEEDS:
                yield from self._crowded(ids, int(doc[at[first]]), at[first:last], k[first:last])

    def _crowded(self, ids: np.ndarray, doc: int, at: np.ndarray, k: np.ndarray):
        """The same for one text of many seeds, by groups of items."""
        seeds, seen = np.unique(k, return_counts=True)
        which, there = self.places(seeds)
        of_item = np.bincount(self.item[there], seen[which], len(self.names)).astype(np.int64)
        few = np.flatnonzero((of_item > 0) & (of_item <= PAIR_SEEDS))
        for item in np.flatnonzero(of_item > PAIR_SEEDS).tolist():
            yield doc, item
        order = np.argsort(k, kind="stable")
        starts = np.r_[0, np.cumsum(seen)]
        for items in np.split(few, np.flatnonzero(np.diff(np.cumsum(of_item[few]) // GROUP_SEEDS)) + 1):
            mine = np.isin(self.item[there], items)
            # for each place of these items all positions of its seed in the text
            seed, place = which[mine], there[mine]
            n = seen[seed]
            where = np.repeat(starts[seed] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield self.verified(ids, at[order[where]], np.repeat(place, n))


# seeds of one text and item that are joined one by one, and of all that are held at once; beyond, runs are found by columns
PAIR_SEEDS, GROUP_SEEDS = 50_000, 2_000_000


def runs_of_seeds(text_at: np.ndarray, item_at: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal matches ``(words, text position, item position)`` from the seeds of one text and item."""
    order = np.lexsort((item_at, text_at - item_at))
    t, i = text_at[order], item_at[order]
    new = np.r_[True, (np.diff(t - i) != 0) | (np.diff(i) != 1)]
    first = np.flatnonzero(new)
    return [(int(n) + size - 1, int(t[f]), int(i[f])) for f, n in zip(first, np.diff(np.r_[first, len(t)]))]


def runs_by_column(text: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal matches of a text and an item without their seeds: the length of the match that begins at each word of the text,
    for one word of the item after the other from the last, so memory is that of the text.

    Of matches of one length at one place of the item only so many are given, apart in the text, that tiles can never stand in
    the way of all of them: tiles cover each word of the item once at most, so they touch at most ``3 * words / length + 2``.
    """
    out, n = [], len(text)
    length = np.zeros(n + 1, np.int64)
    for j in range(len(item) - 1, -1, -1):
        length[:n] = np.where(text == item[j], length[1:] + 1, 0)
        begins = length[:n] >= size
        if j:
            begins[1:] &= text[:-1] != item[j - 1]
        at = np.flatnonzero(begins)
        if not len(at):
            continue
        order = np.argsort(length[at], kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(length[at][order]) != 0, True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            same = at[order[a:b]]
            words, k = int(length[same[0]]), 0
            for _ in range(3 * len(item) // words + 2):
                out.append((words, int(same[k]), j))
                k = int(np.searchsorted(same, same[k] + words))
                if k == len(same):
                    break
    return out


def tiles(runs: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from the maximal matches of one text and one item: ``(text position, item position, words)``, longest first."""
    heap = [(-n, t, i) for n, t, i in runs]
    heapq.heapify(heap)
    used_text, used_item, out = set(), set(), []
    while heap:
        length, ts, is_ = heapq.heappop(heap)
        free = [k for k in range(-length) if ts + k not in used_text and is_ + k not in used_item]
        if len(free) == -length:
            out.append((ts, is_, -length))
            used_text.update(range(ts, ts - length))
            used_item.update(range(is_, is_ - length))
        elif len(free) >= size:
            free = np.array(free)
            for run in np.split(free, np.flatnonzero(np.diff(free) != 1) + 1):
                if len(run) >= size:
                    heapq.heappush(heap, (-len(run), ts + int(run[0]), is_ + int(run[0])))
    return out


def leaks(texts: pa.Array, index: Index, coverage: float) -> list[tuple[int, int, int, int]]:
    """``(text, item, words covered, tiles)`` of the texts and items that reach the coverage."""
    out, base = [], 0

    def judge(d: int, item: int, runs: list) -> None:
        found = tiles(runs, index.size)
        covered = sum(x[2] for x in found)
        if covered >= coverage * index.lengths[item]:
            out.append((base + d, item, covered, len(found)))

    for words, at, bounds in word_groups(texts):
        known = [[index.vocabulary.get(w, 0) for w in cut(word)] for word in words]
        sizes = np.array([len(k) for k in known], np.int64)
        flat, first, n = np.array([i for k in known for i in k], np.int64), np.cumsum(sizes) - sizes, sizes[at]
        ids = flat[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        doc = np.repeat(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), n)
        for d, item in index.short_items(ids, doc):
            out.append((base + d, item, int(index.lengths[item]), 1))
        for a, b in index.hits(ids, doc):
            if isinstance(a, int):
                mine = slice(*np.searchsorted(doc, [a, a + 1]))
                judge(a, b, runs_by_column(ids[mine], index.ids[index.start[b]:index.start[b] + index.lengths[b]], index.size))
                continue
            pair = doc[a] * len(index.names) + index.item[b]
            order = np.argsort(pair, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0]) if len(pair) else []
            for rows in np.split(order, cuts[1:]) if len(pair) else []:
                d, item = divmod(int(pair[rows[0]]), len(index.names))
                # even apart, so few seeds cannot cover enough
                if len(np.unique(b[rows])) * index.size >= coverage * index.lengths[item]:
                    judge(d, item, runs_of_seeds(a[rows], b[rows], index.size))
        base += len(bounds) - 1
    return out


def indexes(benchmark: DataFrame, min_match: int, id_col: str, text_col: str, block_chars: int, short: bool = False) -> tuple[int, Callable[[int], Index]]:
    """The number of blocks of about ``block_chars``, each small enough to go to every task, and what builds one of them."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(-(-chars // block_chars))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, blocks)))
    return blocks, lambda b: Index(sorted(map(tuple, items.where(block == b).distinct().collect()), key=str), min_match, short)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, id_col: str = "doc_id",
                 text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = 32_000_000, short_items: bool = False) -> DataFrame:
    """``doc_id, item_id, covered, item_tokens, tiles, coverage``: a row per text and item of which tiles cover at least ``coverage``.

    Items with fewer than ``min_match`` words match nothing, or with ``short_items`` the texts that hold all their words in a
    row; null and empty items match nothing; null and empty texts hold nothing.
    Rows without an id and repeated rows are reported like any other, exact repeats of an item once; empty
    tables give an empty result; other columns are not read.
    """
    schema = "doc_id long, item_id long, covered long, item_tokens long, tiles long, coverage double"
    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    blocks, build = indexes(benchmark, min_match, item_id_col, item_text_col, block_chars, short_items)

    def found(index: Index) -> DataFrame:
        def run(batches):
            for b in batches:
                names, rows = b.column(0).to_pylist(), leaks(b.column(1), index, coverage)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([names[d] for d, *_ in rows], pa.int64()), "item_id": pa.array([index.names[i] for _, i, *_ in rows], pa.int64()),
                    "covered": pa.array([r[2] for r in rows], pa.int64()), "item_tokens": pa.array([int(index.lengths[r[1]]) for r in rows], pa.int64()),
                    "tiles": pa.array([r[3] for r in rows], pa.int64()), "coverage": pa.array([r[2] / float(index.lengths[r[1]]) for r in rows], pa.float64())})
        return map_batches(picked, run, schema)

    if blocks == 1:
        return found(build(0))
    # each block is written out and released before the next is built
    parts = [materialize(found(build(b)), "leaks") for b in range(blocks)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = 32_000_000, short_items: bool = False) -> DataFrame:
    """The rows of ``docs`` whose text covers no benchmark item; with one block of the benchmark decided where each row
    lies, with more by the digests of the leaking texts, so that one block at a time is held."""
    blocks, build = indexes(benchmark, min_match, item_id_col, item_text_col, block_chars, short_items)

    def clean(index: Index) -> DataFrame:
        at = docs.columns.index(text_col)

        def run(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, *_ in leaks(b.column(at), index, coverage)]] = False
                yield b.filter(pa.array(keep))
                release()
        return map_batches(docs, run, docs.schema)

    def digests(index: Index) -> DataFrame:
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(sorted({d for d, *_ in leaks(b.column(0), index, coverage)}), pa.int64()))], ["leaked"])
        texts = docs.select(F.col(text_col).cast("string"))
        return map_batches(texts, run, "leaked string").select(F.sha2("leaked", 256).alias("leaked")).distinct()

    if blocks == 1:
        return clean(build(0))
    parts = [materialize(digests(build(b)), "leaked") for b in range(blocks)]
    if not parts:
        return docs
    leaked = materialize(reduce(DataFrame.unionAll, parts).distinct(), "leaked")
    return docs.join(leaked, F.sha2(docs[text_col].cast("string"), 256) == leaked["leaked"], "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
