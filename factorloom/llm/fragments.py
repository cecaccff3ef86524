"""Encoding by certain cuts: a text falls into fragments no token can span, each distinct fragment is encoded once.

The byte pairs that occur inside some vocabulary token form a 256 x 256 table. A pair outside the table can't be
joined by any merge; where the pre-tokenizer ends a piece there as well, the pieces left and right are encoded
independently and their ids concatenated, with the same ids as for the whole text:

* ``words`` (end-of-word BPE, white space dropped): ASCII white space, and changes between ASCII letters, digits and
  other signs whose pair is not in the table. Apostrophes (contractions) and non-ASCII neighbours (normalisation)
  never mark a cut, nor do the pairs inside special tokens, as these are vocabulary tokens too.
* ``bytes`` (byte-level BPE, the white space before a word belongs to it): before ASCII white space after a character
  that is not white space itself.
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np
from tokenizers import Tokenizer

from .common import distinct_spans, lower_ascii

SPACE, LETTER, DIGIT, OTHER, WIDE = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[128:] = WIDE
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_MOST_CACHED, _MOST_BYTES = 1_000_000, 64 << 20  # fragments, some 150 bytes each, and bytes in them


def _byte_of_char() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies, back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pair_table(tokenizer: Tokenizer) -> tuple[np.ndarray, bool]:
    """Which byte pairs occur inside a token of the vocabulary, special ones too; whether the model marks word ends."""
    suffix, back, table = tokenizer.model.end_of_word_suffix or "", _byte_of_char(), np.zeros((256, 256), bool)
    for token in tokenizer.get_vocab(with_added_tokens=True):
        for form in {token, token.removesuffix(suffix)}:
            raw = [back[c] for c in form if c in back]
            table[raw[:-1], raw[1:]] = True
    return table, bool(suffix)


class FragmentEncoder:
    """Encodes many texts at once. The cache of distinct fragments is bounded and lives as long as the worker."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table, self.by_words = pair_table(self.tokenizer)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self._clear()

    def _clear(self) -> None:
        # the cache: each fragment's place in the arrays of first id and number of ids, and the ids one after another
        self.places: dict[bytes, int] = {}
        self.held = 0
        self.starts, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first fragment of each text)."""
        n = len(raw)
        if n == 0:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(offsets), np.int64)
        kind = _CLASS[raw]
        cuts = np.zeros(n + 1, bool)
        left, right = kind[:-1], kind[1:]
        if self.by_words:
            low = lower_ascii(raw)
            change = ((left != right) | (left == DIGIT)) & (left != WIDE) & (right != WIDE) & (raw[:-1] != 39) & (raw[1:] != 39)
            cuts[1:-1] = change & ~self.table[low[:-1], low[1:]] | (left == SPACE) | (right == SPACE)
        else:
            wide_space = np.zeros(n, bool)  # ends a character that may be white space beyond ASCII
            wide_space[1:] |= (raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0))
            wide_space[2:] |= (raw[:-2] >= 0xE1) & (raw[:-2] <= 0xE3)
            cuts[1:-1] = (right == SPACE) & (left != SPACE) & ~wide_space[:-1] & ~self.table[raw[:-1], raw[1:]]
        cuts[offsets] = True
        cuts[[0, n]] = True
        at = np.flatnonzero(cuts)
        starts, ends = at[:-1], at[1:]
        if self.by_words:
            keep = kind[starts] != SPACE
            starts, ends = starts[keep], ends[keep]
        return starts, ends, np.searchsorted(starts, offsets)

    def lookup(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each fragment in the cache, and the first fragment of each text. Fragments are known by their bytes."""
        starts, ends, first = self.cut(raw, offsets)
        distinct, number = distinct_spans(raw, starts, ends)
        if len(self.places) + len(distinct) > _MOST_CACHED or self.held > _MOST_BYTES:
            self._clear()
        places = np.fromiter(map(self.places.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            fresh = [distinct[i] for i in missing.tolist()]
            places[missing] = np.arange(len(self.lens), len(self.lens) + len(fresh))
            ids: list[list[int]] = []
            for i in range(0, len(fresh), 4096):  # the library's results are large
                ids += [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in fresh[i : i + 4096]], add_special_tokens=False)]
            lens = np.fromiter(map(len, ids), np.int32, len(ids))
            self.places.update(zip(fresh, places[missing].tolist()))
            self.held += sum(map(len, fresh))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens, dtype=np.int64) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum()))])
        return places[number], first

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, first id of each text)."""
        numbers, first = self.lookup(raw, offsets)
        lens = self.lens[numbers]
        ends = np.concatenate([[0], np.cumsum(lens)])
        at = np.repeat(self.starts[numbers] - ends[:-1], lens) + np.arange(int(ends[-1]))
        return self.flat[at], ends[first]


class TextEncoder(FragmentEncoder):
    """Also knows how a tokenizer without a decoder writes ids and tokens: joined by a space."""

    def __init__(self, path: str):
        super().__init__(path)
        assert self.by_words and self.tokenizer.decoder is None, "decoding joins tokens by a space"
        self.id_text = [str(i) for i in range(self.vocabulary)]
        self.token_text = [self.tokenizer.id_to_token(i) or "" for i in range(self.vocabulary)]


_encoders: dict[tuple[type, str], FragmentEncoder] = {}


def encoder(path: str, kind: type[FragmentEncoder] = FragmentEncoder) -> FragmentEncoder:
    """One encoder for each worker process, so that its cache serves all tasks there. Spark has a task for each core already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]
