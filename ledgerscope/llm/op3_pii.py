"""Personal data by fixed patterns, and terms beside it by their information content.

Patterns find the protected entities (addresses, card and phone numbers).  For each word of a document that holds
an entity the corpus tells how strongly it reveals that entity: with document counts n over N documents,
``PMI(e; t) = log2(P(e|t) / P(e))`` against the entity's own information ``IC(e) = -log2 P(e)``, where ``P(e) = n(e) / N`` and
``P(e|t) = (n(e,t) + prior P(e)) / (n(t) + prior)``: ``prior`` documents that know nothing of the term are added, so a
term of few documents is drawn towards no information instead of being left out.  A term whose PMI reaches ``remove`` of
the IC gives the entity away and is removed wherever it stands in such a document; from ``generalise`` on it is generalised
to its first letter.  Texts without an entity stay as they are.

Shares of the IC alone loosen with the corpus, as a rare entity has much information to give away.  A ``Rule`` therefore also
holds absolute floors on ``P(e|t)``, counts evidence for groups of entities (a mail domain, the beginning of a number) beside the
single ones, and leaves out entities that so many documents share that they name nobody.  ``PLAIN`` is the bare formula;
``PRODUCTION``, which the query and the pipeline use, has a prior that neither one co-occurrence nor two can overcome to the
floor of removal.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ledgerscope.llm import bloom
from ledgerscope.llm.common import as_texts, map_batches, read, release
from ledgerscope.llm.hashed import word_groups
from ledgerscope.session import materialize

KINDS = ("email", "ip", "card", "phone")
ACTIONS = ("generalise", "remove")
PRIOR, GENERALISE, REMOVE = 1.0, 0.6, 0.8
_SLICE = 256  # rows that stand as Python objects at once
_HELD = 200_000  # terms that a task counts before it sends them on


@dataclass(frozen=True)
class Rule:
    """When a term discloses an entity; see the top of the module."""
    prior: float = PRIOR
    generalise: float = GENERALISE
    remove: float = REMOVE
    generalise_from: float = 0.0  # least P(e|t)
    remove_from: float = 0.0
    least_bits: float = 0.0  # least IC of an entity worth protecting
    groups: bool = False  # mail domains and beginnings of numbers are entities too


PLAIN = Rule()
PRODUCTION = Rule(prior=4.0, generalise_from=0.3, remove_from=0.5, least_bits=5.0, groups=True)

# fixed patterns: written so that no text makes them scan a run of characters twice
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at - (len(part) - len(part.rstrip(_LOCAL))) if (part := text[last:at]) else at
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def _luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the four kinds, by start and then kind; code points, end exclusive."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.groups()]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def _hash(text: str) -> int:
    x = xxhash.xxh64_intdigest(text.encode())
    return x - (1 << 64) if x >> 63 else x


def _entity(kind: int, value: str) -> int:
    """An entity's key: its kind and its value without case and punctuation."""
    return _hash(f"{kind}:{value.lower() if kind < 2 else ''.join(_DIGIT.findall(value))}")


def _group(kind: int, value: str) -> int:
    """The key of what an entity shares with its like: mail domain, address without its last part, issuer of a card, phone number
    without its last four digits."""
    digits = "".join(_DIGIT.findall(value))
    shared = value.lower().rsplit("@", 1)[-1] if kind == 0 else value.rsplit(".", 1)[0] if kind == 1 else digits[:6] if kind == 2 else digits[:-4]
    return _hash(f"group {kind}:{shared}")


def words_outside(text: str, spans: list[tuple[int, int, int]]):
    """``(word in lower case, start, end)`` of the words of a text that no span touches."""
    starts, ends = [s for s, _, _ in spans], sorted(e for _, _, e in spans)
    for m in _TERM.finditer(text):
        # spans begun before the word's end but not ended before its start lie over it
        if bisect_right(starts, m.end() - 1) == bisect_right(ends, m.start()):
            yield m[0].lower(), m.start(), m.end()


_BASE = pa.struct([(n, pa.int32()) for n in ("start", "kind", "end")])


def detect(docs: DataFrame, text_col: str, kept: list[Column], groups: bool, all_texts: bool) -> DataFrame:
    """``k0, k1, ...`` (the expressions ``kept``), a row number, the base spans, the different entities (and their ``groups``), the
    different words outside the spans, and the text.

    Rows without an entity have no words, and a text only with ``all_texts``.
    """
    picked = docs.select(F.col(text_col).cast("string").alias("text"), *[c.alias(f"k{i}") for i, c in enumerate(kept)])
    schema = T.StructType([*picked.schema.fields[1:], *T.StructType.fromDDL(
        "uid long, base array<struct<start:int,kind:int,end:int>>, entities array<long>, terms array<long>, text string").fields])

    def lists(parts, kind):
        flat = [x for part in parts for x in part] if pa.types.is_struct(kind) else np.concatenate([np.zeros(0, np.int64), *parts])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, kind))

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                bases, entities, terms, texts = [], [], [], []
                for text in as_texts(b.column(0)):
                    spans = base_spans(text)
                    keys = {key(kind, text[s:e]) for s, kind, e in spans for key in ((_entity, _group) if groups else (_entity,))}
                    bases.append([dict(zip(("start", "kind", "end"), s)) for s in spans])
                    entities.append(np.array(sorted(keys), np.int64))
                    terms.append(np.array([_hash(w) for w in {w for w, _, _ in words_outside(text, spans)}] if spans else [], np.int64))
                    texts.append(text if spans else None)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.arange(uid, uid + b.num_rows)), lists(bases, _BASE), lists(entities, pa.int64()),
                                                  lists(terms, pa.int64()), b.column(0) if all_texts else pa.array(texts, pa.string())], schema.names)
                uid += b.num_rows
            release()

    return map_batches(picked, run, schema)


def term_counts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """``(term, n_t)``: in how many documents each wanted term stands.

    All texts are read; a Bloom filter of a size that follows the number of wanted terms, up to its bound, keeps most other terms
    out of the shuffle, and those that pass it meet no partner later.
    """
    wanted = materialize(wanted.select(F.col("term").alias("key")), "terms")
    bits = bloom.build(wanted, wanted.count())

    def run(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the task so far

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["term", "n"])

        for b in batches:
            for words, at, bounds in word_groups(b.column(0)):
                said = [[_hash(t.lower()) for t in _TERM.findall(w)] for w in words]
                sizes = np.array([len(t) for t in said], np.int64)
                terms = np.array([h for t in said for h in t], np.int64)
                keep = bloom.may_hold(bits, terms)
                found, flat = np.unique(terms[keep], return_inverse=True)
                sizes = np.bincount(np.repeat(np.arange(len(words)), sizes)[keep], minlength=len(words))
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                some = sizes[at] > 0
                doc, word = np.divmod(np.unique(doc[some] * max(1, len(words)) + at[some]), max(1, len(words)))
                n = sizes[word]
                at_term = flat[np.repeat((np.cumsum(sizes) - sizes)[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                pairs = np.unique(np.repeat(doc, n) * max(1, len(found)) + at_term) % max(1, len(found))
                both, place = np.unique(np.r_[keys, found], return_inverse=True)
                counts = np.bincount(place, np.r_[counts, np.bincount(pairs, minlength=len(found))], len(both)).astype(np.int64)
                keys = both
                if len(keys) > _HELD:  # bounds a task's memory
                    yield flush()
                    keys, counts = keys[:0], counts[:0]
            release()
        yield flush()

    counted = map_batches(docs.select(F.col(text_col).cast("string")), run, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str, rule: Rule) -> DataFrame:
    """``(uid, removed, generalised)``: the terms that give an entity of the row away, from the detected rows and the
    counts of the whole corpus."""
    total = float(docs.agg(F.count("*")).first()[0] or 1)
    holds = found.select("uid", F.explode("entities").alias("entity"))
    sets = holds.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias("x"),
                                       F.bit_xor(F.xxhash64(F.lit(2), "uid")).alias("y"))
    # entities of the same documents share all their counts: one stands for them, so a list of addresses costs no more than one
    alone = F.col("n_e") / F.lit(total)
    first = (sets.groupBy("n_e", "x", "y").agg(F.min("entity").alias("entity")).where((F.col("n_e") < total) & (-F.log2(alone) >= rule.least_bits))
             .select("entity", "n_e"))
    groups = holds.join(first, "entity").groupBy("uid").agg(F.collect_list(F.struct("entity", "n_e")).alias("groups"))
    seen = (found.select("uid", "terms").join(groups, "uid").select("uid", "terms", F.explode("groups").alias("g"))
            .select("uid", "g.*", F.explode("terms").alias("term")))
    pairs = seen.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et"))
    near = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))

    def known(n_t):
        return (F.col("n_et") + rule.prior * alone) / (n_t + F.lit(rule.prior))

    def reaches(n_t, share, least):
        return (F.log2(known(n_t) / alone) / -F.log2(alone) >= share) & (known(n_t) >= least)

    # a term stands in at least as many documents as have it beside an entity, and P(e|t) only falls with
    # that number: what fails with the smaller number needs no count over the corpus
    wanted = materialize(pairs.join(near, "term").where(reaches(F.col("n_near"), rule.generalise, rule.generalise_from)), "pairs")
    judged = (wanted.join(term_counts(docs, text_col, wanted.select("term").distinct()), "term")
              .where(reaches(F.col("n_t"), rule.generalise, rule.generalise_from))
              .select("entity", "term", reaches(F.col("n_t"), rule.remove, rule.remove_from).cast("int").alias("action")))
    said = seen.join(judged, ["entity", "term"]).groupBy("uid", "term").agg(F.max("action").alias("action"))
    return said.groupBy("uid").agg(F.collect_list(F.when(F.col("action") == 1, F.col("term"))).alias("removed"),
                                   F.collect_list(F.when(F.col("action") == 0, F.col("term"))).alias("generalised"))


def term_spans(text: str, base: list[dict], removed: list[int] | None, generalised: list[int] | None) -> list[dict]:
    """``start, end, action`` of all places of the terms in a text, by start."""
    said = dict.fromkeys(generalised or (), 0) | dict.fromkeys(removed or (), 1)
    if not said:
        return []
    spans, known = [(s["start"], s["kind"], s["end"]) for s in base], {}
    out = []
    for word, start, end in words_outside(text, spans):
        if word not in known:
            known[word] = said.get(_hash(word))
        if known[word] is not None:
            out.append({"start": start, "end": end, "action": known[word]})
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = PLAIN) -> DataFrame:
    """``doc_id, base, terms`` per row: base spans ``(start, kind, end)`` and disclosing terms ``(start, end, action)``.

    Null and empty texts hold nothing; rows without an id and repeated rows are searched and counted like any other; an empty
    table gives an empty result; other columns are not read.
    """
    found = materialize(detect(docs, text_col, [F.col(id_col).cast("long")], rule.groups, all_texts=False), "entities")
    terms = disclosing_terms(found.where(F.size("base") > 0), docs, text_col, rule)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                done = [term_spans(t or "", *x) for t, *x in zip(*(b.column(k).to_pylist() for k in (2, 1, 3, 4)))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1),
                                                  pa.array(done, pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "action")])))],
                                                 ["doc_id", "base", "terms"])
            release()

    return map_batches(found.join(terms, "uid", "left").select("k0", "base", "text", "removed", "generalised"), run,
                       "doc_id long, base array<struct<start:int,kind:int,end:int>>, terms array<struct<start:int,end:int,action:int>>")


def _rewrite(text: str, base, terms) -> str:
    """Entities become their kind's mark, removed terms go, generalised ones keep their first letter."""
    marks = [(s["start"], s["end"], f"<{KINDS[s['kind']].upper()}>") for s in base or ()]
    marks += [(s["start"], s["end"], "" if s["action"] else text[s["start"]] + "…") for s in terms or ()]
    out, at = [], 0
    for a, b, mark in sorted(marks):
        if b <= at:
            continue  # inside a span that is already replaced
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text_col: str = "text", rule: Rule = PLAIN) -> DataFrame:
    """``docs`` with entities and disclosing terms replaced in the text; a column ``n_chars`` follows its text.

    One pass over the texts writes all rows with what was found in them.  Rows without an entity are read back from there as
    they are, without Python and without a shuffle; only the others meet their terms and are rewritten.
    """
    at, schema = docs.columns.index(text_col), docs.schema
    others = [c for k, c in enumerate(docs.columns) if k != at]
    found = materialize(detect(docs, text_col, [docs[c] for c in others], rule.groups, all_texts=True), "entities")
    hit, clean = found.where(F.size("base") > 0), found.where(F.size("base") == 0)
    names = [f"k{k}" for k in range(len(others))]
    names.insert(at, "text")
    terms = disclosing_terms(hit, docs, text_col, rule)

    def rewrite(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, _SLICE):
                b = whole.slice(first, _SLICE)
                cols = b.columns[3:]
                texts, base = as_texts(cols[at]), b.column(0).to_pylist()
                terms = map(term_spans, texts, base, b.column(1).to_pylist(), b.column(2).to_pylist())
                done = list(map(_rewrite, texts, base, terms))
                cols[at] = pa.array(done, pa.string())
                if "n_chars" in schema.names:
                    cols[schema.names.index("n_chars")] = pa.array([len(t) for t in done], pa.int64())
                yield pa.RecordBatch.from_arrays(cols, schema.names)
            release()

    changed = map_batches(hit.join(terms, "uid", "left").select("base", "removed", "generalised", *names), rewrite, schema)
    return changed.unionAll(clean.select(*[F.col(n).cast(f.dataType).alias(f.name) for n, f in zip(names, schema.fields)]))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document, and in ``actions`` what becomes of each term: ``remove`` or ``generalise``, start and end."""
    found = find_personal_data(read(spark, sf_dir, "documents"), rule=PRODUCTION)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b, rows = whole.slice(at, _SLICE), []
                for base, terms in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    spans = [(s["start"], s["kind"], s["end"]) for s in base or ()]
                    said = lambda spans: ",".join(f"{(*KINDS, 'term')[k]}:{a}:{e}" for a, k, e in sorted(spans))
                    rows.append((*[sum(k == n for _, k, _ in spans) for n in range(4)], hashlib.sha256(said(spans).encode()).hexdigest(),
                                 said(spans + [(s["start"], 4, s["end"]) for s in terms or ()]),
                                 ",".join(f"{ACTIONS[s['action']]}:{s['start']}:{s['end']}" for s in terms or ())))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], pa.int64() if k < 4 else pa.string()) for k in range(7)]],
                                                 ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "actions"])

    return map_batches(found, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, actions string")
