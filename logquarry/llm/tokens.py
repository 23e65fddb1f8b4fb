"""Token ids of whole texts by the tokenizers library, with a cache of short stretches of text.

The vocabularies used here divide text into words before merging, so a text's ids are the ids of its
stretches between blanks, put one after the other.  Arrow divides the texts of a batch and tells equal
stretches apart, so Python looks each distinct one up once; a worker keeps the ids of those it has seen.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stretches that a worker remembers: twice so many at most, the older half goes when the newer is full.
#: Long ones, which hardly come again, are not kept, and a stretch counts by its bytes as so many usual ones.
CACHE = 400_000
LONG, USUAL = 64, 32
_STRETCH = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_BLANK = re.compile(r"[^\S \n]")
#: Other blanks, or blanks in a row: these belong together, so cutting at single ones is not enough.
_ODD = "[" + "".join(c for c in map(chr, range(1 << 16)) if c.isspace() and c not in " \n") + "]| [ \n]|\n "
#: Latin letters, and ASCII signs behind them: these begin a new word, but for an apostrophe.
_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
#: Byte-level vocabularies write each byte as a character: printable ones as themselves, the others,
#: in order, as those from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_encoders: dict[tuple[str, int], "Encoder"] = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Ids of stretches after a prefix, computed when first asked for."""

    def __init__(self, owner: "Encoder", prefix: str):
        super().__init__()
        self.owner, self.prefix, self.older, self.size = owner, prefix, {}, 0
        #: The prefix as the vocabulary writes it, before a word of ASCII letters.
        self.written = prefix.translate(_BYTE_CHARS)

    def age(self) -> None:
        """Keep what has been asked for lately."""
        if self.size > USUAL * self.owner.cache:
            self.older, self.size = dict(self), 0
            self.clear()

    def __missing__(self, stretch: str) -> bytes:
        return self.all([stretch])[0]

    def all(self, stretches: list[str]) -> list[bytes]:
        """Ids of each of the stretches."""
        out, older, written, folds = list(map(self.get, stretches)), self.older, self.written, self.owner.folds
        tokenize, rest = self.owner.tokenizer.model.tokenize, self.owner.stretch
        for i, ids in enumerate(out):
            if ids is None:
                s = stretches[i]
                ids = older.get(s)
                if ids is None:
                    if s.isascii() and s.isalpha():  # one word to the vocabulary, so its model can be asked directly
                        ids = array("I", [p.id for p in tokenize(written + (s.lower() if folds else s))]).tobytes()
                    else:
                        ids = rest(self.prefix, s, self)
                if len(s) <= LONG and ("\n" not in s or s == "\n"):  # others hardly come again
                    self[s] = ids
                    self.size += max(USUAL, len(s) + len(ids))
                out[i] = ids
        return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, for the vocabulary file at path."""

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: With a normaliser, case and blanks do not matter; without, a blank belongs to the next word.
        self.folds = self.tokenizer.normalizer is not None
        self.bare, self.spaced = _Known(self, ""), _Known(self, " ")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def stretch(self, prefix: str, text: str, known: _Known) -> bytes:
        """Ids of prefix + text.  A word of Latin letters is one word to the vocabulary; signs after
        one begin a new word."""
        if text.isalpha() and max(text) < "İ":
            word = prefix + text.lower() if self.folds else prefix + text
            pieces = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_CHARS))
            return np.array([p.id for p in pieces], "<u4").tobytes()
        if parts := _SIGNS.fullmatch(text):
            return known[parts[1]] + self.bare[parts[2]]
        if text.count("\n") == 1 and " " not in text and text[0] != "\n" != text[-1]:
            before, after = text.split("\n")
            return known[before] + self.bare["\n"] + self.bare[after]
        return self._whole(prefix + text)

    def lists(self, texts: pa.Array, end_id: int | None = None) -> pa.ListArray:
        """Each text's ids as 32-bit integers, with end_id behind them if it is given."""
        self.bare.age()
        self.spaced.age()
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        plain = np.ones(len(texts), bool) if self.folds else ~pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if plain.all():
            return self._divided(texts, end)
        odd = np.flatnonzero(~plain)
        found = [self._divided(texts.filter(pa.array(plain)), end), _as_lists([self._odd(t) + end for t in texts.take(pa.array(odd)).to_pylist()])]
        order = np.concatenate((np.flatnonzero(plain), odd))
        return pa.concat_arrays(found).take(pa.array(np.argsort(order)))

    def _odd(self, text: str) -> bytes:
        """Ids of a text with blanks in a row, or others than space and newline."""
        if _OTHER_BLANK.search(text):
            return self._whole(text)
        return b"".join([self.bare[s] for s in _STRETCH.findall(text)])

    def _divided(self, texts: pa.Array, end: bytes) -> pa.ListArray:
        """Ids of texts that can be cut at each space, each with end behind it."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " ") if self.folds else texts, " ")
        cuts = words.offsets.to_numpy().astype(np.int64)
        found = words.flatten().dictionary_encode()
        place, distinct = found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = (self.bare if self.folds else self.spaced).all(distinct)
        if not self.folds:  # no blank stands before a text's first word
            heads = cuts[:-1]
            firsts = [self.bare[distinct[i]] for i in place[heads].tolist()]
            place[heads] = len(ids) + np.arange(len(heads))
            ids += firsts
        if end:
            place = np.insert(place, cuts[1:], len(ids))
            cuts += np.arange(len(cuts))
            ids.append(end)
        each = _as_lists(ids).take(pa.array(place))
        return pa.ListArray.from_arrays(pa.array(each.offsets.to_numpy()[cuts]), each.values)

    def encode(self, texts: list[str]) -> list[bytes]:
        """lists() as bytes, one value for each text."""
        found = self.lists(pa.array(texts, pa.string()))
        return [np.asarray(x.values, "<u4").tobytes() for x in found]


def _as_lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def slices(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """batch (doc_id, text binary, ...) in runs of rows with size bytes of text or little more."""
    ends = np.cumsum(pc.binary_length(batch.column(1).fill_null(b"")).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)) + 1
        yield batch.slice(at, to - at)
        at = to


def as_texts(column: pa.Array) -> pa.Array:
    """A binary column as texts: null is empty, bytes that are no UTF-8 are replaced."""
    column = column.fill_null(b"")
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in column.to_pylist()], pa.string())


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """This worker's encoder for a vocabulary file, which remembers about twice cache stretches."""
    if (path, cache) not in _encoders:
        _encoders[path, cache] = Encoder(path, cache)
    return _encoders[path, cache]
