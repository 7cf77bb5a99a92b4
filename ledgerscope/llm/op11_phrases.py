"""Phrase collocations from count streams in prefix and suffix order.

Phrases are counted order by order.  Both parts of a frequent phrase that lack its last or first word are frequent too, so
the tasks of order ``k`` only send phrases on whose two parts of order ``k - 1`` pass a filter of the frequent ones; what a filter
lets through wrongly is counted and then dropped, so the counts are exact.

The frequent phrases then stand in two streams.  In prefix order a phrase follows its own beginnings and precedes its
extensions to the right; in suffix order (words from last to first) the same holds for endings and extensions to the left.
Each stream is cut at bounds into ordered runs; a task reads its run once in lockstep with the chain of the phrase's parents, at
most one entry per length, so a phrase meets the counts of all its beginnings (or endings) and each parent its most
frequent extension without any lookup.  A run that begins inside a family gets the few parents of its bound beforehand.

Null and empty texts have no words; a null language counts as ``und``; rows without an id and repeated rows count like any
other; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerscope.llm import bloom
from ledgerscope.llm.common import map_batches, read
from ledgerscope.session import materialize

LONGEST, LEAST, SHARE, TOP = 5, 100, 100, 2000
RUN_ROWS = 50_000  # frequent phrases in a run of a stream
_GROUP_BYTES = 4_000_000
_MIX = 0x9E3779B97F4A7C15

# fixed sets of bytes
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIECE_END = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_GAP = _PIECE_END | np.isin(np.arange(256), list(b" \t"))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of the texts, the index of each word in reading order and its piece's number.

    Works on the bytes of all texts at once; pieces never reach over two texts.
    """
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]] if len(texts) else np.zeros(0, np.uint8)
    raw = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
    solid = ~_GAP[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[bounds[:-1] - bounds[0]] = True  # of texts
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | begins[1:-1]
    starts = np.flatnonzero(starts)
    ends = np.flatnonzero(_PIECE_END[raw])
    piece = np.searchsorted(ends, starts) + np.searchsorted(bounds[:-1] - bounds[0], starts, "right")
    kept = raw[solid]
    places = np.r_[(np.cumsum(solid) - solid)[starts], len(kept)].astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(kept.tobytes())])
    coded = found.dictionary_encode()
    return coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy().astype(np.int64), piece


def language_groups(langs: pa.Array, texts: pa.Array):
    """``(language, texts)`` of a batch, a bounded number of bytes at a time."""
    langs, texts = langs.fill_null("und"), texts.cast(pa.large_string()).fill_null("")
    for lang in pc.unique(langs).to_pylist():
        some = texts.filter(pc.equal(langs, lang))
        ends = np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False)) // _GROUP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(some)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield lang, pa.concat_arrays([some.slice(a, b - a)])


def _word_hash(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode()) & 0x7FFFFFFF
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in words), np.uint64, len(words))


def _chain(parts) -> np.ndarray:
    """Hash of phrases from the hashes of their words, first to last."""
    out = np.uint64(0)
    for h in parts:
        out = (out * np.uint64(_MIX)) ^ (h + (out >> np.uint64(29)))
    return out


def count_order(docs: DataFrame, lang_col: str, text_col: str, order: int, bits: np.ndarray | None) -> DataFrame:
    """``(lang, phrase, f)`` of the phrases of ``order`` words whose parts may be frequent; of order 1 all, and in the phrase '' the
    number of all words.

    A task counts what it finds in a group of texts; Spark adds these counts up before and after the shuffle.
    """
    def run(batches):
        for b in batches:
            for lang, texts in language_groups(b.column(0), b.column(1)):
                words, at, piece = words_of(texts)
                n = len(at) - order + 1
                if order == 1:
                    phrases, counts = words, np.bincount(at, minlength=len(words))
                    phrases, counts = pa.concat_arrays([phrases, pa.array([""], pa.large_string())]), np.r_[counts, len(at)]
                elif n > 0:
                    hashed = _word_hash(lang, words.to_pylist())[at]
                    short = len(at) - order + 2  # places of phrases one word shorter
                    known = bloom.may_hold(bits, _chain([hashed[k:k + short] for k in range(order - 1)]))
                    place = np.flatnonzero((piece[:n] == piece[order - 1:]) & known[:-1] & known[1:])
                    key = at[place]
                    for k in range(1, order):  # exact numbers of the phrases, a word at a time
                        key = np.unique(key * len(words) + at[place + k], return_inverse=True)[1]
                    _, first, counts = np.unique(key, return_index=True, return_counts=True)
                    first = place[first]
                    phrases = pc.binary_join_element_wise(*[words.take(pa.array(at[first + k])) for k in range(order)], pa.scalar(" ", pa.large_string()))
                else:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()) if len(phrases) < 2 else
                                                  pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(phrases), np.int32)), pa.array([lang])).cast(pa.string()),
                                                  phrases.cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "phrase", "f"])

    counted = map_batches(docs.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")), run, "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def phrase_keys(phrases: DataFrame) -> DataFrame:
    """``key``: the filter key of each ``(lang, phrase)``."""
    def run(batches):
        for b in batches:
            keys = [int(_chain([_word_hash(lang, [w]) for w in phrase.split(" ")])[0]) for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64))], ["key"])
    return map_batches(phrases.select("lang", "phrase"), run, "key long")


def frequent_phrases(docs: DataFrame, lang_col: str, text_col: str, longest: int, least: int) -> list[DataFrame]:
    """``(lang, phrase, f)`` of all phrases with ``f >= least``, a written table per order; the first also holds the phrase ''."""
    tables, bits = [], None
    for order in range(1, longest + 1):
        table = materialize(count_order(docs, lang_col, text_col, order, bits).where((F.col("f") >= least) | (F.col("phrase") == "")), f"phrases{order}")
        tables.append(table)
        found = table.where("phrase <> ''")
        if not (n := found.count()):
            break
        if order < longest:
            bits = bloom.build(phrase_keys(found), n)
    return tables


def stream(phrases: DataFrame, backward: bool, run_rows: int) -> DataFrame:
    """``lang, phrase, f, parts, longer`` from one pass over the phrases in prefix order (or suffix order if ``backward``).

    ``parts``: counts of the phrase's beginnings (endings) of 1, 2, ... words, without itself; null in rows that only tell of
    ``longer``, the highest count of an extension by one word to the right (left) found in that run.
    """
    words = F.split("phrase", " ")
    ordered = phrases.select("lang", (F.reverse(words) if backward else words).alias("words"), "f")
    total = ordered.count()
    runs = max(1, -(-total // run_rows))
    # bounds of the runs from a bounded sample by hash; they only decide where a row is read
    part = max(1, total // (runs * 20))
    sample = sorted((r["lang"], *r["words"]) for r in ordered.where(F.pmod(F.xxhash64("lang", "words"), F.lit(part)) == 0)
                    .orderBy(F.xxhash64("lang", "words")).limit(runs * 40).select("lang", "words").collect()) if runs > 1 else []
    step = len(sample) / runs
    bounds = sorted({sample[int(k * step)] for k in range(1, runs)}) if len(sample) >= runs else []

    kinds = "run int, parent boolean, lang string, words array<string>, f long"

    def deal(batches):
        heads: dict[tuple, list[int]] = {}  # what must be known before a run begins: the parents of its bound
        for k, bound in enumerate(bounds):
            for n in range(2, len(bound)):
                heads.setdefault(bound[:n], []).append(k + 1)
        for b in batches:
            out = []
            for lang, said, f in zip(*(b.column(k).to_pylist() for k in range(3))):
                mine = bisect_right(bounds, (lang, *said))
                out.append((mine, False, lang, said, f))
                out += [(k, True, lang, said, f) for k in heads.get((lang, *said), ()) if k != mine]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.int64()))],
                                             ["run", "parent", "lang", "words", "f"])

    def lockstep(batches):
        chain: list[list] = []  # [run, lang, words, f, parent, longer] of each shorter beginning of the next row

        def tell(entry):
            _, lang, said, f, parent, longer = entry
            return (lang, " ".join(reversed(said) if backward else said), f, None if parent else [e[3] for e in chain], longer)

        def batch(out):
            cols = list(zip(*out)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()))],
                                              ["lang", "phrase", "f", "parts", "longer"])

        for b in batches:
            out = []
            for at, parent, lang, said, f in zip(*(b.column(k).to_pylist() for k in range(5))):
                while chain and (chain[-1][0] != at or chain[-1][1] != lang or chain[-1][2] != said[:len(chain[-1][2])]):
                    out.append(tell(chain.pop()))
                if chain:
                    chain[-1][5] = max(chain[-1][5], f)
                chain.append([at, lang, said, f, parent, 0])
            yield batch(out)
        out = []
        while chain:
            out.append(tell(chain.pop()))
        yield batch(out)

    dealt = map_batches(ordered, deal, kinds)
    dealt = (dealt.repartitionByRange(runs, "run") if runs > 1 else dealt.coalesce(1)).sortWithinPartitions("run", "lang", "words")
    return map_batches(dealt, lockstep, "lang string, phrase string, f long, parts array<long>, longer long")


def _exact(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, share: int = SHARE,
                 run_rows: int = RUN_ROWS) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the phrases of 2 to ``longest`` words with ``a >= least`` that no longer one covers.

    A longer phrase covers a phrase in it from ``share`` percent of its count on.  Extensions by one word decide that: whatever
    lies between a phrase and a longer one has at least the count of the longer one.
    """
    tables = frequent_phrases(docs, lang_col, text_col, longest, least)
    phrases = tables[0].where("phrase <> ''")
    for table in tables[1:]:
        phrases = phrases.unionByName(table)
    sides = [stream(phrases, backward, run_rows) for backward in (False, True)]
    both = (sides[0].select("lang", "phrase", "f", F.col("parts").alias("lefts"), F.lit(None).cast("array<long>").alias("rights"), "longer")
            .unionByName(sides[1].select("lang", "phrase", "f", F.lit(None).cast("array<long>").alias("lefts"), F.col("parts").alias("rights"), "longer"))
            .groupBy("lang", "phrase").agg(F.first("f").alias("a"), F.max("lefts").alias("lefts"), F.max("rights").alias("rights"), F.max("longer").alias("longer")))
    both = both.where((F.size("lefts") > 0) & (F.col("longer") * 100 < F.col("a") * share))
    # one number per language; not broadcast on purpose, Spark decides by its size
    both = both.join(tables[0].where("phrase = ''").select("lang", F.col("f").alias("n")), "lang")

    def cut(k):
        left, right = F.get("lefts", k - 1), F.get("rights", F.size("lefts") - k)
        score = F.call_function("div", _exact(_exact(F.lit(1000) * F.col("a")) * _exact(F.col("n"))), _exact(_exact(left) * _exact(right)))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    cuts = F.transform(F.sequence(F.lit(1), F.size("lefts")), cut)
    return both.withColumn("best", F.array_min(cuts)).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
                                                             F.col("best.score").alias("score"))


def first_of_each(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language, ranked; first of parts of a language, so that no task ranks more than some of them."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("part")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_each(collocations(read(spark, sf_dir, "documents")), TOP).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
said AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM said GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM said, range(1, 6) t(k) WHERE len(w) >= k),
counts AS (SELECT lang, g, any_value(k) AS k, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100),
inside AS (
  SELECT lang, unnest([list_slice(g, 1, k - 1), list_slice(g, 2, k)]) AS g, f FROM counts WHERE k > 2),
covered AS (SELECT lang, g, max(f) AS longer FROM inside GROUP BY lang, g),
kept AS (
  SELECT c.* FROM counts c LEFT JOIN covered o ON o.lang = c.lang AND o.g = c.g WHERE c.k > 1 AND 100 * coalesce(o.longer, 0) < 100 * c.f),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, x.f AS l, y.f AS r, n, s.cut, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM kept c CROSS JOIN range(1, 5) s(cut) JOIN totals t ON t.lang = c.lang
  JOIN counts x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, s.cut)
  JOIN counts y ON y.lang = c.lang AND y.g = list_slice(c.g, s.cut + 1, c.k)
  WHERE s.cut < c.k),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""
