"""Token ids of whole text columns through a per-process cache of words.

Texts are cut at white space, where the tokenizer's own word split must cut anyway; the different
words of a group of texts are looked up once, those missing from the cache go to the tokenizer, and
the ids are put together by array operations.  Texts with two white-space characters in a row are
encoded whole, so the ids are always the tokenizer's.
"""
from __future__ import annotations

import os
import string
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_DOUBLE = r"[\s\x0b\x1c-\x1f\x85\pZ]{2}"
_CACHED = 250_000  # words in each of the cache's two generations; bounds a worker's memory
_CACHED_MARKS = 10_000
_MARKS = "".join(c for c in string.punctuation if c != "'")
_GROUP_BYTES = 5_000_000
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}

# byte-level vocabularies write a byte as a character: printable Latin-1 stands for itself, the
# others follow from 256 on
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b if b in set(_SELF) else 256 + n - sum(s < b for s in _SELF)
               for n, b in enumerate(range(256))}
_SPACE = chr(_BYTE_CHARS[32])
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("token ids are written as little-endian 32-bit integers")


class Encoder:
    """Ids as little-endian unsigned 32-bit integers.

    ``words=True`` is for a tokenizer that drops white space and lower-cases, so its words stand bare.
    Otherwise a word carries the space or line feed before it; a line feed is a token of its own, and a
    text is taken as if it followed one.
    """

    def __init__(self, path: str, words: bool):
        from tokenizers import Tokenizer
        self.tok, self.words = Tokenizer.from_file(path), words
        self.model = self.tok.model
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.lf = self.whole("\n")
        self.marks: dict[str, bytes] = {}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, w: str) -> bytes:
        """The ids of a word with its leading space or line feed."""
        ids = self.old.get(w)
        if ids is None:
            ids = self._encode(w)
        self.new[w] = ids
        return ids

    def _encode(self, w: str) -> bytes:
        # a letter and a mark (the apostrophe aside) never share a token, so trailing marks are encoded by themselves; the word before them may be known
        if w[-1:] in _MARKS and (stem := w.rstrip(_MARKS))[-1:].isalpha() and not any(t in w for t in self.special):
            run = w[len(stem):]
            if (marks := self.marks.get(run)) is None:
                marks = self.whole(run)
                if len(self.marks) < _CACHED_MARKS:
                    self.marks[run] = marks
            return (self.new.get(stem) or self._word(stem)) + marks
        if not self.words and w[:1] == "\n":
            return self.lf + self._piece(w[1:]) if len(w) > 1 else self.lf
        return self._piece(w if self.words else " " + w)

    def _piece(self, p: str) -> bytes:
        letters = p[1:] if p[:1] == " " else p
        if not letters.isalpha():
            return self.whole(p) if p else b""
        plain = letters.isascii()
        if self.words:
            if not plain and (max(letters) >= "ɐ" or "İ" in letters):
                return self.whole(p)
            p = p.lower() if plain else unicodedata.normalize("NFC", p).lower()
        # letters alone are one word to the tokenizer: straight to its merges
        if not plain:
            p = p.encode().decode("latin-1").translate(_BYTE_CHARS)
        elif p[0] == " ":
            p = _SPACE + letters
        return array("I", [t.id for t in self.model.tokenize(p)]).tobytes()

    def encode_all(self, texts: pa.Array, group_bytes: int = _GROUP_BYTES) -> Iterator[bytes]:
        """The ids of each text of a string column (null: none), a bounded group of texts at a time.

        A group takes a multiple of ``group_bytes`` while it is put together.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // group_bytes
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield from self._group(texts.slice(a, b - a))

    def _group(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.match_substring_regex(texts, _DOUBLE)
        odd_texts = iter(texts.filter(odd).to_pylist())
        plain = pc.if_else(odd, "", texts)
        if self.words:
            plain = pc.replace_substring(plain, "\n", " ")
        else:
            plain = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(plain, "\n", " \n"),
                                                pa.scalar("", pa.large_string()))
        cut = pc.split_pattern(plain, " ")
        coded = cut.flatten().dictionary_encode()
        if len(self.new) > _CACHED:
            self.new, self.old = {}, self.new
        known, word = self.new.get, self._word
        found = [known(w) or word(w) for w in coded.dictionary.to_pylist()]
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = coded.indices.to_numpy()
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        # a group has far fewer than 2**31 ids
        place = np.repeat(((np.cumsum(sizes) - sizes)[at] - (ends - lengths)).astype(np.int32), lengths)
        place += np.arange(len(place), dtype=np.int32)
        raw = memoryview(ids[place]).cast("B") if len(place) else memoryview(b"")
        bounds = np.r_[0, ends][np.asarray(cut.offsets)].tolist()
        del plain, cut, coded, found, ids, at, lengths, ends, place  # the caller may hold the generator for long
        skip = 0 if self.words else len(self.lf)
        for a, b, whole in zip(bounds, bounds[1:], odd.to_pylist()):
            yield self.whole(next(odd_texts)) if whole else bytes(raw[4 * a + skip:4 * b])


def encoder(path: str, words: bool) -> Encoder:
    """The process's encoder for a tokenizer file; Python workers that are reused keep it warm."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = Encoder(path, words)
    return _ENCODERS[path, words]
