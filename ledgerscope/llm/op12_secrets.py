"""Secrets by fixed patterns and by novelty against a primed zstandard compressor.

Three patterns give the base spans.  Beside them every long run of key characters near a sensitive word is a candidate.  Its
novelty is what it adds to the compressed size of the text around it, per byte, with a compressor primed with the identifiers of
the corpus: words and names compose from what the dictionary or the surrounding text holds, keys do not.  Candidates from a
threshold on are reported as ``novel`` unless a base span already lies over them.

The dictionary holds the most frequent identifiers, counted over all documents outside runs that are long
enough to be candidates, so a key that stands in thousands of copies cannot make itself known.  Null and empty texts hold nothing; rows without an id and repeated rows
are searched like any other; texts are searched whole; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerscope.llm.common import as_texts, map_batches, read
from ledgerscope.llm.hashed import word_groups
from ledgerscope.session import materialize

KINDS = ("assign", "access", "hex", "novel")
WORDS = 8192  # identifiers in the dictionary: at most 25 bytes each, so some 200 KB on the driver and in a task
CONTEXT = 256  # code points of surrounding text on each side that prime the compressor further
NEAR = 64  # code points on each side in which the sensitive word stands
LEAST = 20  # code points of a candidate
NOVELTY = 0.95  # compressed bytes added per byte
_SLICE = 256  # rows that stand as Python objects at once

# fixed patterns
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")
_SENSITIVE = re.compile(r"passw|secret|token|api_?key|credential|private|bearer|auth|access|signature|session|cookie|pwd|encrypt|salt", re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}+" % LEAST)
_IDENTIFIER = re.compile(r"[A-Z]?[a-z]{2,23}|[A-Z]{3,24}")

_HEX_RUN = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
_KEY_RUN = bytes(1 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_=-") else 0 for c in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the three patterns, by start and then kind; code points, end exclusive.

    A text without the letters or runs that a pattern needs is not searched for it.
    """
    out, raw = [], text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"\1" * 16 in raw.translate(_HEX_RUN):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]):
    """``(start, end)`` of the runs of key characters near a sensitive word that no base span touches."""
    if b"\1" * LEAST not in text.encode("utf-8", "surrogatepass").translate(_KEY_RUN):
        return
    taken = sorted((s, e) for s, _, e in base)
    at = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end:
            continue
        if _SENSITIVE.search(text, max(0, start - NEAR), start) or _SENSITIVE.search(text, end, end + NEAR):
            yield start, end


class Novelty:
    """Marginal compressed bytes against a dictionary of identifiers and the text around."""

    # up to 63 literals are stored as they are, so in such pieces a key costs its bytes whatever its alphabet
    _PIECE = 48
    _PLAN = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=18, hash_log=17, chain_log=17,
                                                search_log=6, target_length=32, write_content_size=False)

    def __init__(self, words: list[str]) -> None:
        self._words = " ".join([*reversed(words), ""]).encode()  # what is most frequent stands last, where offsets are short

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes that ``text[start:end]`` adds to its surroundings, per byte.  Other copies of it are taken out of these: a key
        written twice is as secret as one written once.

        The surroundings stand in the dictionary after the identifiers and are compressed before the value as well: there they
        are one long match, so the difference holds nothing but the value's own literals and matches.
        """
        value = text[start:end]
        around = f"{text[max(0, start - CONTEXT):start]}\n{text[end:end + CONTEXT]}\n".replace(value, "").encode("utf-8", "surrogatepass").ljust(64)
        primed = zstandard.ZstdCompressionDict(self._words + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        engine = zstandard.ZstdCompressor(dict_data=primed, compression_params=self._PLAN)
        raw, alone = value.encode(), len(engine.compress(around))
        pieces = [raw[k:k + self._PIECE] for k in range(0, len(raw), self._PIECE)]
        return sum(len(engine.compress(around + piece)) - alone for piece in pieces) / len(raw)


def identifiers(docs: DataFrame, text_col: str, most: int) -> list[str]:
    """The ``most`` most frequent identifier words of all texts, ties by name; counts are summed per group of texts before the shuffle.

    The number of words per power of two of their counts tells from which power on the first ``most`` must be, so only words
    from there are sorted and sent on.
    """
    def run(batches):
        for b in batches:
            for words, at, _ in word_groups(b.column(0)):
                said: dict[str, int] = {}
                for w, n in zip(words, np.bincount(at, minlength=len(words)).tolist()):
                    for part in _IDENTIFIER.findall(_CANDIDATE.sub(" ", w)):
                        said[part] = said.get(part, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array(list(said), pa.string()), pa.array(list(said.values()), pa.int64())], ["word", "n"])

    counted = map_batches(docs.select(F.col(text_col).cast("string")), run, "word string, n long")
    counts = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "identifiers")
    powers = counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("words")).collect()  # at most 64 rows
    above, least = 0, 0
    for row in sorted(powers, key=lambda r: -r["power"]):
        above += row["words"]
        if above >= most:
            least = 2 ** row["power"]
            break
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)
    return [r["word"] for r in sorted(top.collect(), key=lambda r: (-r["n"], r["word"]))]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, novelty: float = NOVELTY) -> DataFrame:
    """``doc_id, spans`` per row: ``start, kind, end`` by start and then kind, and the ``novelty`` of those that are no base spans."""
    known = identifiers(docs, text_col, words)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))

    def run(batches):
        engine = None
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b, rows = whole.slice(at, _SLICE), []
                for text in as_texts(b.column(1)):
                    base = base_spans(text)
                    spans = [(*s, None) for s in base]
                    for start, end in candidates(text, base):
                        engine = engine or Novelty(known)
                        if (gain := engine.of(text, start, end)) >= novelty:
                            spans.append((start, 3, end, gain))
                    rows.append([dict(zip(("start", "kind", "end", "novelty"), s)) for s in sorted(spans, key=lambda s: s[:3])])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run,
                       "doc_id long, spans array<struct<start:int,kind:int,end:int,novelty:double>>")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b, rows = whole.slice(at, _SLICE), []
                for spans in b.column(1).to_pylist():
                    said = lambda some: ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in some)
                    base = [s for s in spans if s["kind"] < 3]
                    rows.append((*[sum(s["kind"] == k for s in base) for k in range(3)], hashlib.sha256(said(base).encode()).hexdigest(), said(spans)))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.string()) for k in range(5)]],
                                                 ["doc_id", *[f"n_{k}" for k in KINDS[:3]], "base_sha256", "spans"])

    return map_batches(found, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
