r"""A Katz backoff language model over words, and the score of every text under it (operator 3).

Tokens are runs of ``[^\x20\x09-\x0D]+`` after A-Z are lower-cased, then one end per text; before a text stand starts
that are no tokens. For a word w after a history h of up to ``order - 1`` tokens, h' being h without its first,

    p(w | h) = d(c(h, w)) c(h, w) / c(h)       if c(h, w) in training is at least the cutoff of its order
             = alpha(h) p(w | h')              else (alpha is 1 if h has no such w)
    p(w)     = d(c(w)) c(w) / N                if w was seen; all unseen words together have what is left

with Good-Turing discounts d_r for counts r up to 5, and alpha(h) = (1 - sum of the p(w | h) of the first kind) / (1 -
sum of their p(w | h')): a distribution for every history, exactly. The usual cutoffs are 1, 1 and 2: a triple seen
once says nothing.

Nothing the size of the vocabulary or of an n-gram table is in one place. Texts form blocks of some 1.5 million tokens,
kept as files in the shared folder. Order by order, each block sends its distinct n-grams to buckets, where counts are
summed, and what is sent back is stored as Parquet partitioned by kind, with a number for each n-gram that may go on as
a history. From the second order on an n-gram is a pair of such numbers, of history and word, so only words are ever
told apart by a hash (64 bits, see ``hash_spans``). An n-gram can't reach its cutoff unless its history and its
suffix do; those below 2 stay in their block, as a single one is known to be single. N-grams are dealt by history; a history seen more than ``SALT_AT`` times is
dealt in parts by word, so that none fills a task, and what alpha needs are whole numbers that are added up at the
history's home. These sums go back to the blocks that ask for them, where texts are evaluated from the first order up.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, hash_spans, lower_ascii, mix, pieces, scratch, text_view, words

ORDER, CUTOFFS = 3, (1, 1, 2)  # least count of an n-gram that counts, by order
TOP = 5  # counts up to this are discounted
BLOCK_TOKENS = 1_500_000
SALT_AT = 1 << 20  # occurrences of a history in one bucket
END = np.uint64(0x454E44)
U64 = np.uint64
SCHEMA = "kind int, bucket long, block long, a binary, b binary, c binary"
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
FILE, COUNTS, TOTALS, CONTEXT, ASK, ALPHA = range(6)


def _zstd(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of bits, word of 64 bits, place in it) of the bits below the first one, one after the other; those that go on in the next word."""
    bits = size - (size > 0)
    end = np.cumsum(bits, dtype=np.int64)
    start = end - bits
    place = (start & 63).astype(np.uint8)
    return bits, start >> 6, place, np.flatnonzero(place + bits > 64)


def _pack_sizes(x: np.ndarray) -> bytes:
    """Numbers from 0 on: how many bits each has, two in a byte and compressed, then the bits below the first one of each."""
    size = np.frexp(x.astype(np.float64))[1].astype(np.uint8)
    pair = np.minimum(size, 15)
    pair = np.append(pair, np.zeros(len(pair) % 2, np.uint8)).reshape(-1, 2)
    more = size > 1
    bits, word, place, over = _places(size[more])
    low = x[more].astype(U64)
    low ^= U64(1) << bits.astype(U64)
    words = np.zeros(int(word[-1]) + 2 if len(word) else 0, U64)
    if len(word):
        at = _runs(word)
        words[word[at]] = np.add.reduceat(low << place.astype(U64), at)
        words[word[over] + 1] += low[over] >> (64 - place[over]).astype(U64)
    return _join(_zstd((pair[:, 0] | pair[:, 1] << 4).tobytes()), _zstd(size[size >= 15].tobytes()), words.astype("<u8").tobytes()[: (int(bits.sum(dtype=np.int64)) + 7) // 8])


def _unpack_sizes(data: bytes, n: int) -> np.ndarray:
    pair, large, raw = _parts(data)
    pair = np.frombuffer(pa.decompress(pair, (n + 1) // 2, codec="zstd", asbytes=True), np.uint8)
    size = np.stack([pair & 15, pair >> 4], axis=1).ravel()[:n]
    most = np.flatnonzero(size == 15)
    if len(most):
        size[most] = np.frombuffer(pa.decompress(large, len(most), codec="zstd", asbytes=True), np.uint8)
    out, more = (size > 0).astype(np.int64), size > 1
    bits, word, place, over = _places(size[more])
    words = np.frombuffer(raw + bytes(16 + -len(raw) % 8), "<u8")
    low = words[word] >> place.astype(U64)
    low[over] |= words[word[over] + 1] << (64 - place[over]).astype(U64)
    first = U64(1) << bits.astype(U64)
    out[more] = low & (first - U64(1)) | first
    return out


def pack(x: np.ndarray) -> bytes:
    """Compressed bytes of an array, byte planes apart."""
    return len(x).to_bytes(8, "little") + (b"\0" + _zstd(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()) if len(x) else b"")


def pack_sizes(x: np.ndarray) -> bytes:
    """The same for numbers that are small for the most part, with sizes and bits apart: takes less where they follow no order."""
    if len(x) == 0 or int(x.min()) < 0 or int(x.max()) >= 1 << 40:
        return pack(x)
    return len(x).to_bytes(8, "little") + b"\1" + _pack_sizes(x)


def unpack(data: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if n == 0:
        return np.zeros(0, dtype)
    if data[8]:
        return _unpack_sizes(data[9:], n).astype(dtype)
    raw = pa.decompress(data[9:], n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).reshape(n)


def steps(x: np.ndarray) -> bytes:
    """An ascending array, packed as differences."""
    return pack(np.diff(x, prepend=x[:1] * 0)) if len(x) else pack(x)


def from_steps(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def _join(*parts: bytes) -> bytes:
    """Packed arrays in one column, each behind its length."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], ["kind", "bucket", "block", "a", "b", "c"])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)])


def _range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each hash; ascending with it."""
    return ((hashes >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _cuts(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    starts = _runs(x).tolist()
    return list(zip(starts, [*starts[1:], len(x)]))


def _pair_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order of pairs of numbers from 0 on; one sort where both fit 63 bits together."""
    width = int(b.max(initial=0)) + 1
    if len(a) and int(a.max()) < (1 << 62) // width:
        return np.argsort(a * width + b, kind="stable")
    return np.lexsort((b, a))


def pack_pairs(a: np.ndarray, b: np.ndarray) -> bytes:
    """Pairs in ascending order, packed: the distinct a, how many b each has, the b as differences within an a."""
    at = _runs(a)
    delta = np.diff(b, prepend=b[:1] * 0)
    delta[at] = b[at]
    return _join(pack_sizes(np.diff(a[at], prepend=0)), pack_sizes(np.diff(np.append(at, len(a)))), pack_sizes(delta))


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, number of the run of each)"""
    head, lens, delta = _parts(data)
    lens, delta = unpack(lens, np.int64), unpack(delta, np.int64)
    start, total = np.cumsum(lens) - lens, np.cumsum(delta)
    run = np.repeat(np.arange(len(lens)), lens)
    return from_steps(head, np.int64)[run], total - (total[start] - delta[start])[run], run


def _falling(counts: np.ndarray) -> np.ndarray:
    """Stable order by falling counts; those of 65,535 and more are one class."""
    return np.argsort((65535 - np.minimum(counts, 65535)).astype(np.uint16), kind="stable")


def _rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in ascending order."""
    out = np.empty(len(x), np.int64)
    out[np.argsort(x, kind="stable")] = np.arange(len(x))
    return out


_LOW, _HIGH = [1, 2, 4, 8, 10], [7, 3, 5, 9, 11]  # columns of numbers of counts that share a byte, four bits each


def pack_sums(sums: np.ndarray) -> bytes:
    """Sums of histories by column: numbers of counts up to 15 two in a byte, then what is left of them, and of the
    two columns of counts what the numbers of counts 1..TOP don't tell already."""
    rest = sums.copy()
    for at in (0, TOP + 1):
        rest[:, at] -= rest[:, at + 1 : at + 1 + TOP] @ np.arange(1, TOP + 1)
    low, high = np.minimum(sums[:, _LOW], 15), np.minimum(sums[:, _HIGH], 15)
    rest[:, _LOW] -= low
    rest[:, _HIGH] -= high
    return _join(pack((low | high << 4).astype(np.uint8).T.ravel()), pack_sizes(rest.T.ravel()))


def unpack_sums(data: bytes) -> np.ndarray:
    small, rest = _parts(data)
    sums, small = unpack(rest, np.int64).reshape(_SUMS, -1).T.copy(), unpack(small, np.uint8).reshape(len(_LOW), -1).T
    sums[:, _LOW] += small & 15
    sums[:, _HIGH] += small >> 4
    for at in (0, TOP + 1):
        sums[:, at] += sums[:, at + 1 : at + 1 + TOP] @ np.arange(1, TOP + 1)
    return sums


class Curve:
    """The count to expect of a word from its number, as numbers rise while counts fall: from how many words have which
    count, single below 32 and in 16 classes for each doubling from there on. Whole numbers, so that all expect the same."""

    CLASSES = 32 + 16 * 59

    def __init__(self, words: np.ndarray):
        i = np.arange(self.CLASSES)
        low = np.where(i < 32, i, 16 + i % 16 << np.maximum(i // 16 - 1, 0))
        width = np.where(i < 32, 1, 1 << np.maximum(i // 16 - 1, 0))
        by = np.flatnonzero(words)[::-1]
        self.words, self.low, self.width = words[by], low[by], width[by]
        self.end = np.cumsum(self.words)

    @staticmethod
    def tally(counts: np.ndarray) -> np.ndarray:
        """How many counts each class has."""
        up = np.maximum(np.frexp(counts.astype(np.float64))[1].astype(np.int64) - 5, 0)
        return np.bincount(16 * up + (counts >> up), minlength=Curve.CLASSES)

    def at(self, numbers: np.ndarray) -> np.ndarray:
        if len(self.end) == 0:
            return np.zeros(len(numbers), np.int64)
        x = np.minimum(numbers, self.end[-1] - 1)
        k = np.searchsorted(self.end, x, side="right")
        left = self.end[k] - x
        return self.low[k] + self.width[k] * (2 * left - 1) // (2 * self.words[k])

    def pack(self, numbers: np.ndarray, counts: np.ndarray) -> bytes:
        """Counts of words as what they are above or below the expected ones."""
        off = counts.astype(np.int64) - self.at(numbers)
        return pack_sizes(off << 1 ^ off >> 63)

    def unpack(self, numbers: np.ndarray, data: bytes) -> np.ndarray:
        off = unpack(data, np.int64)
        return (off >> 1 ^ -(off & 1)) + self.at(numbers)


class Discounts:
    """Good-Turing ratios d_1..d_TOP from counts of counts n_1..n_(TOP+1), renormalised so that counts above TOP stay.

    Where the counts are too few for Katz's formula to give ratios in (0, 1), d_r = (r - b) / r with b = n1 / (n1 + 2 n2).
    """

    def __init__(self, n: list[int], cutoff: int = 1):
        k, d = TOP, []
        if all(n) and (k + 1) * n[k] < n[0]:
            cut = (k + 1) * n[k] / n[0]
            d = [((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) for r in range(1, k + 1)]
        if not d or not all(0 < x < 1 for x in d[cutoff - 1 :]):
            b = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
            d = [(r - b) / r for r in range(1, k + 1)]
        self.d = np.array([1.0, *d])  # d[0] unused

    def ratio(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts <= TOP, self.d[np.minimum(counts, TOP)], 1.0)

    def freed(self, some: np.ndarray) -> np.ndarray:
        """Mass in counts that the ratios take away, from numbers of counts 1..TOP (last axis)."""
        return (some * ((1 - self.d[1:]) * np.arange(1, TOP + 1))).sum(axis=-1)


@dataclass
class Level:
    """What the whole corpus says of one order: its discounts, its cutoff, and how many numbers a bucket has."""

    discounts: Discounts
    cutoff: int
    stride: int


class Model:
    """Totals of the training: tokens N, distinct words V, texts, and the levels learned so far."""

    def __init__(self, buckets: int, cutoffs: tuple[int, ...], totals: np.ndarray, words: np.ndarray):
        self.buckets, self.cutoffs, self.curve = buckets, cutoffs, Curve(words)
        self.n, self.v, self.texts = int(totals[0]), int(totals[1]), int(totals[-2])
        self.levels = [Level(Discounts(totals[2 : 3 + TOP].tolist()), cutoffs[0], max(1, int(totals[-1])))]
        freed = float(self.levels[0].discounts.freed(totals[2 : 2 + TOP]))
        self.whole = self.n if freed > 0 else self.n + 1  # if nothing is freed, unseen words get one count
        self.unseen = freed / max(self.n, 1) if freed > 0 else 1.0 / (self.n + 1)

    def learn(self, totals: np.ndarray) -> None:
        """Add an order; tokens of training that no block sent have n-grams seen once."""
        some = totals[2 : 3 + TOP].tolist()
        some[0] += self.n - int(totals[0])
        cutoff = self.cutoffs[len(self.levels)]
        self.levels.append(Level(Discounts(some, cutoff), cutoff, max(1, int(totals[-1]))))

    def least(self, level: int) -> int | None:
        """The count below which the history or the suffix of an n-gram of this order leaves it in its block: 1 or 2."""
        return min(self.cutoffs[level], 2) if level < len(self.cutoffs) else None

    def word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.levels[0].discounts.ratio(c) * c / self.whole, self.unseen)

    def history(self, level: int, sums: np.ndarray, count: np.ndarray, lower_whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of its count in its denominator, alpha) of histories from their sums, counts and suffixes' denominators.

        Where nothing is freed, the denominator is one count larger, and that count is what is freed.
        """
        own, lower = self.levels[level].discounts, self.levels[level - 1].discounts
        count = count.astype(np.float64)
        freed = count - sums[:, 0] + own.freed(sums[:, 1 : 1 + TOP])
        whole = np.where(freed > 0, count, count + 1)
        seen = (sums[:, TOP + 1] - lower.freed(sums[:, TOP + 2 : TOP + 2 + TOP])) / lower_whole
        return count / whole, np.where(freed > 0, freed, 1.0) / whole / np.maximum(1 - seen, 1e-300)


class Grams:
    """One order within a block: distinct n-grams in the order they are dealt in, two more for the start and for none."""

    def __init__(self, size: int, token: np.ndarray):
        self.size, self.token = size, token  # n-gram of each token

    def told(self, counts: np.ndarray, ids: np.ndarray, texts: int, start: int) -> None:
        """Counts over the whole training, and numbers of those that may be histories (else -1)."""
        self.counts = np.concatenate([counts, [texts, 0]]).astype(np.int64)
        self.ids = np.concatenate([ids, [start, -1]])


class Block:
    """Texts of a block: ``tokens`` (numbers of words by ascending hash), ``size`` (words), ``first`` token of each text.

    ``vocabulary`` (the hashes) is there until the block is saved: its words get numbers then that are told by all blocks.
    """

    def __init__(self, size, tokens, first, ids, valid, learn, vocabulary=None):
        self.size, self.tokens, self.first, self.ids, self.valid, self.learn, self.vocabulary = size, tokens, first, ids, valid, learn, vocabulary

    @staticmethod
    def of(hashes: np.ndarray, first: np.ndarray, ids: list, learn: np.ndarray) -> Block:
        vocabulary, tokens = np.unique(hashes, return_inverse=True)
        return Block(len(vocabulary), tokens.astype(np.uint32), first, np.array([x or 0 for x in ids], np.int64), np.array([x is not None for x in ids], np.uint8), learn.astype(np.uint8), vocabulary)

    def save(self, folder: str) -> str:
        path = f"{folder}/{uuid.uuid4().hex}"
        system, at = fs.FileSystem.from_uri(path)
        counts = np.bincount(self.tokens, minlength=self.size)
        place = np.empty(self.size, np.uint32)
        place[_falling(counts)] = np.arange(self.size)  # frequent words get small numbers, which take less
        parts = [pack(counts.astype(np.uint32)), pack(place[self.tokens]), steps(self.first), pack(self.ids), pack(self.valid), pack(self.learn)]
        with system.open_output_stream(at) as f:
            f.write(_join(*parts))
        return path

    @staticmethod
    def load(path: str) -> Block:
        system, at = fs.FileSystem.from_uri(path)
        with system.open_input_stream(at) as f:
            c, t, first, ids, valid, learn = _parts(f.read())
        by = _falling(unpack(c, np.uint32)).astype(np.uint32)
        return Block(len(by), by[unpack(t, np.uint32)], from_steps(first, np.int64), unpack(ids, np.int64), unpack(valid, np.uint8), unpack(learn, np.uint8))

    def number(self, model: Model, words: Grams) -> None:
        """Numbers of the words over all buckets that rise as counts fall, so that most are small; and their order here."""
        stride = model.levels[0].stride
        self.numbers = np.where(words.ids < 0, -1, words.ids % stride * model.buckets + words.ids // stride)[: words.size]
        self.rank = _rank(self.numbers)

    def per_token(self, per_text: np.ndarray) -> np.ndarray:
        return np.repeat(per_text, np.diff(self.first))

    def histories(self, below: Grams) -> np.ndarray:
        """The n-gram of the order below that stands before each token; the start before the first of a text."""
        out = np.empty(len(self.tokens), np.int64)
        out[1:] = below.token[:-1]
        out[self.first[:-1]] = below.size
        return out

    def grams(self, model: Model, level: int, below: Grams) -> Grams:
        """The n-grams of this order that may reach its cutoff, with ``history``, ``word``, ``bucket`` and a ``token`` of each."""
        history, stride, least = self.histories(below), model.levels[level - 1].stride, model.least(level)
        sent = np.flatnonzero((below.counts[history] >= least) & (below.counts[below.token] >= least))
        width = self.size
        codes, at, back = np.unique(_rank(below.ids)[history[sent]] * width + self.rank[self.tokens[sent]], return_index=True, return_inverse=True)
        h, w = history[sent[at]], self.tokens[sent[at]].astype(np.int64)
        bucket = np.minimum(below.ids[h] // stride, model.buckets - 1)
        parts = -(-below.counts[h] // SALT_AT)
        if (parts > 1).any():
            bucket = (bucket + (mix(self.numbers[w].astype(U64)) % parts.astype(U64)).astype(np.int64)) % model.buckets
        order = np.argsort(bucket.astype(np.uint16 if model.buckets < 1 << 16 else np.int64), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        token = np.full(len(self.tokens), len(codes) + 1, np.int64)
        token[sent] = place[back]
        out = Grams(len(codes), token)
        out.history, out.word, out.bucket, out.sample = h[order], w[order], bucket[order], sent[at[order]]
        out.before, out.suffix = history, np.append(below.token[out.sample], [below.size, below.size + 1])
        return out


def make_blocks(folder: str, n: int, folds: int, held_out: int):
    """Texts to block files, and every block's distinct words with their training counts to the words' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        hashes, lens, ids, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            learn = np.array([zlib.crc32(str(x).encode() if x is not None else b"") % folds != held_out for x in ids], bool)
            b = Block.of(np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype(np.int64), ids, learn)
            block = (part << 24) + number
            counts = np.bincount(b.tokens[b.per_token(learn)], minlength=len(b.vocabulary)).astype(np.uint32)
            bounds = np.searchsorted(_range_of(b.vocabulary, n), np.arange(n + 1))
            rows = [(FILE, n + block % n, block, b.save(folder).encode(), np.array([learn.sum()], "<i8").tobytes(), b"")]
            rows += [(COUNTS, i, block, steps(b.vocabulary[x:y]), pack_sizes(counts[x:y]), b"") for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if x < y]
            return _rows(rows)

        for piece in pieces(batches, "text"):
            raw, offsets = text_view(piece.column("text"))
            low = lower_ascii(raw)
            starts, ends, first = words(low, offsets)
            hashes.append(np.insert(hash_spans(low, starts, ends), first[1:], END))
            lens.append(np.diff(first) + 1)
            ids += piece.column("id").to_pylist()
            held += len(hashes[-1])
            if held >= BLOCK_TOKENS:
                yield close()
                number, hashes, lens, ids, held = number + 1, [], [], [], 0
        if ids:
            yield close()

    return run


def _stats(total: np.ndarray, numbered: int, texts: int = 0) -> bytes:
    """Sum of the counts, distinct ones, counts of counts 1..TOP+1, texts, how many have a number."""
    some = np.bincount(np.minimum(total[total > 0], TOP + 2), minlength=TOP + 3)[1 : TOP + 2]
    return np.array([total.sum(), (total > 0).sum(), *some, texts, numbered], "<i8").tobytes()


def _numbers(total: np.ndarray, least: int | None) -> np.ndarray:
    """A number for each n-gram that may be a history, by falling counts and in their order; -1 for the others."""
    number = np.full(len(total), -1, np.int64)
    may = np.flatnonzero(total >= least) if least is not None else np.zeros(0, np.int64)
    number[may[_falling(total[may])]] = np.arange(len(may))
    return number


def _answer(total: np.ndarray, number: np.ndarray) -> tuple[bytes, bytes]:
    """Counts for a block, in the order it sent its n-grams, and the numbers of those that have one, by falling counts."""
    return pack_sizes(total.astype(np.uint32)), steps(np.sort(number[number >= 0]))


def count_words(n: int, least: int | None):
    """A bucket's words: total counts and numbers to each block, and counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        if bucket >= n:  # the blocks' files pass through
            learned = sum(int(np.frombuffer(r["b"], "<i8")[0]) for r in rows)
            return _table([*((FILE, bucket, r["block"], r["a"], b"", b"") for r in rows), (TOTALS, bucket, -1, _stats(np.zeros(0, np.int64), 0, learned), b"", b"")])
        keys = [from_steps(r["a"], U64) for r in rows]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, np.concatenate([unpack(r["b"], np.uint32) for r in rows]), len(distinct)).astype(np.int64)
        number = _numbers(total, least)
        out, end = [], 0
        for r, k in zip(rows, keys):
            own = back[end : end + len(k)]
            out.append((COUNTS, bucket, r["block"], *_answer(total[own], number[own]), b""))
            end += len(k)
        return _table([*out, (TOTALS, bucket, -1, _stats(total, int(number.max(initial=-1)) + 1), pack(Curve.tally(total[number >= 0])), b"")])

    return run


def _told(model: Model, level: int, grams: Grams, rows: list[dict]) -> None:
    """Give a block's n-grams the counts and numbers that the buckets sent back, in the order the block sent them."""
    stride, least = model.levels[level].stride, model.least(level + 1)
    own = sorted((r for r in rows if r["kind"] == COUNTS and r["level"] == level), key=lambda r: r["bucket"])
    counts = [unpack(r["a"], np.uint32) for r in own]
    ids = []
    for r, c in zip(own, counts):
        x = np.full(len(c), -1, np.int64)
        if least is not None:
            may = np.flatnonzero(c >= least)
            x[may[_falling(c[may])]] = from_steps(r["b"], np.int64) + r["bucket"] * stride
        ids.append(x)
    none = [np.zeros(0, np.int64)]
    grams.told(np.concatenate(counts or none), np.concatenate(ids or none), model.texts, model.buckets * stride)


def _backoff(model: Model, level: int, rows: list[dict], grams: list[Grams], lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, share) of each history of a block; 1 where none was asked for or told. ``lower``: denominators of their suffixes."""
    below = grams[level - 1]
    alpha, share = np.ones(len(below.ids)), np.ones(len(below.ids))
    told = [(from_steps(r["a"], np.int64), unpack_sums(r["b"])) for r in rows if r["kind"] == ALPHA and r["level"] == level]
    if told:
        keys, sums = (np.concatenate(x) for x in zip(*told))
        order = np.argsort(keys)
        at = order[np.minimum(np.searchsorted(keys, below.ids, sorter=order), len(keys) - 1)]
        hit = keys[at] == below.ids
        share[hit], alpha[hit] = model.history(level, sums[at[hit]], below.counts[hit], lower[hit])
    return alpha, share


def _rebuilt(model: Model, levels: int, rows: list[dict]) -> tuple[Block, list[Grams], list[tuple], list[np.ndarray]]:
    """A block from its file: its n-grams of the orders counted so far, and for each order (alpha, share) by history.

    Last, the denominators of the histories' suffixes, up to the order that comes next.
    """
    b = Block.load(next(r["a"] for r in rows if r["kind"] == FILE).decode())
    grams, backoff, lower = [Grams(b.size, b.tokens.astype(np.int64))], [()], [np.zeros(0)]
    _told(model, 0, grams[0], rows)
    b.number(model, grams[0])
    lower.append(np.full(grams[0].size + 2, model.whole, np.int64))
    for level in range(1, levels):
        grams.append(b.grams(model, level, grams[-1]))
        _told(model, level, grams[-1], rows)
        backoff.append(_backoff(model, level, rows, grams, lower[level]))
        lower.append((grams[-2].counts + (backoff[-1][1] < 1))[grams[-1].suffix])
    return b, grams, backoff, lower


def send(model: Model, level: int):
    """A block's n-grams of an order to their buckets: numbers of history and word, own count, counts of suffix and history."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        b, known, _, _ = _rebuilt(model, level, rows)
        below, block = known[-1], rows[0]["block"]
        g = b.grams(model, level, below)
        own = np.bincount(g.token[b.per_token(b.learn) > 0], minlength=g.size + 2)[: g.size].astype(np.uint32)
        suffix = below.counts[below.token[g.sample]]
        h, w = below.ids[g.history], b.numbers[g.word]
        out = []
        for x, y in _cuts(g.bucket):
            at = x + _runs(h[x:y])
            lows = suffix[x:y]
            if level == 1:  # a pair's suffix is its word: told once for each word
                lasts, one = np.unique(w[x:y], return_index=True)
                lows = model.curve.pack(lasts, lows[one])
            else:
                lows = pack_sizes(lows.astype(np.uint32))
            out.append((COUNTS, int(g.bucket[x]), block, pack_pairs(h[x:y], w[x:y]), _join(pack_sizes(own[x:y]), lows), _join(pack(below.counts[g.history[at]]))))
        # what was not sent is below its cutoff here: its history is asked at once
        unsent = g.before[g.token > g.size]
        asked = np.unique(below.ids[unsent])
        asked = asked[asked >= 0]
        return _table(out + _asks(model, level, asked, np.full(len(asked), block, np.int64)))

    return run


def _asks(model: Model, level: int, ids: np.ndarray, blocks: np.ndarray) -> list[tuple]:
    """Questions for histories' alphas, to their homes."""
    home = np.minimum(ids // model.levels[level - 1].stride, model.buckets - 1)
    by = np.lexsort((blocks, ids, home))
    home, ids, blocks = home[by], ids[by], blocks[by]
    return [(ASK, int(home[x]), -1, steps(ids[x:y]), pack(blocks[x:y]), b"") for x, y in _cuts(home)]


_SUMS = 2 * (TOP + 1)  # of a history: the counts that reach the cutoff, how many by count 1..TOP, the same of the suffixes


def count_grams(model: Model, level: int):
    """A bucket's n-grams: total counts and numbers to each block, sums of histories and questions for alphas."""
    cutoff, least = model.cutoffs[level], model.least(level + 1)

    def run(table: pa.Table) -> pa.Table:
        rows, bucket = table.to_pylist(), table.column("bucket")[0].as_py()
        out = [(ASK, bucket, -1, r["a"], r["b"], b"") for r in rows if r["kind"] == ASK]
        rows = [r for r in rows if r["kind"] == COUNTS]
        if not rows:
            return _table([*out, (TOTALS, bucket, -1, _stats(np.zeros(0, np.int64), 0), b"", b"")])
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        for r in rows:
            h, w, run_ = unpack_pairs(r["a"])
            own, suffix = _parts(r["b"])
            own = unpack(own, np.uint32)
            if level == 1:
                lasts, back = np.unique(w, return_inverse=True)
                suffix = model.curve.unpack(lasts, suffix)[back]
            else:
                suffix = unpack(suffix, np.uint32)
            for c, x in zip(columns, (h, w, own, suffix, unpack(_parts(r["c"])[0], np.int64)[run_])):
                c.append(x)
        sizes = [len(x) for x in columns[0]]
        h, w, own, suffix, count = map(np.concatenate, columns)
        del columns
        order = _pair_order(h, w)
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])])
        gram = np.empty(len(h), np.int64)
        gram[order] = np.cumsum(new) - 1
        first = order[new]
        total = np.bincount(gram, own, len(first)).astype(np.int64)
        number = _numbers(total, least)
        kept = total >= cutoff
        h1, kept_total = h[first][kept], total[kept]
        # where something is surely freed: a discounted count is here, or the whole history is and part of it is below the cutoff
        starts, count1 = _runs(h1), count[first][kept]
        whole = np.add.reduceat(kept_total, starts) if len(starts) else kept_total
        freed = (np.add.reduceat((kept_total <= TOP).astype(np.int64), starts) > 0) if len(starts) else np.zeros(0, bool)
        freed = h1[starts][freed | (whole < count1[starts]) & (count1[starts] <= SALT_AT)]
        discounted = np.isin(h, freed)
        alone = ~np.isin(h, h1) & (count <= SALT_AT)  # no n-gram of this history counts: its alpha is 1
        asks, askers, end = [], [], 0
        for r, size in zip(rows, sizes):
            mine = gram[end : end + size]
            out.append((COUNTS, bucket, r["block"], *_answer(total[mine], number[mine]), b""))
            # an n-gram below the cutoff needs its history's alpha; where nothing is discounted here, perhaps nothing is at all
            asks.append(np.unique(h[end : end + size][((total[mine] < cutoff) | ~discounted[end : end + size]) & ~alone[end : end + size]]))
            askers.append(np.full(len(asks[-1]), r["block"], np.int64))
            end += size
        out += _asks(model, level, np.concatenate(asks), np.concatenate(askers))
        sums = np.zeros((len(starts), _SUMS), np.int64)
        if len(starts):
            lows = suffix[first][kept].astype(np.int64)
            add = lambda x: np.add.reduceat(x.astype(np.int64), starts)
            sums[:, 0], sums[:, TOP + 1] = add(kept_total), add(lows)
            for r in range(1, TOP + 1):
                sums[:, r], sums[:, TOP + 1 + r] = add(kept_total == r), add(lows == r)
        ids = h1[starts]
        home = np.minimum(ids // model.levels[level - 1].stride, model.buckets - 1)
        by = np.argsort(home, kind="stable")
        out += [(CONTEXT, int(home[by[x]]), -1, steps(ids[by[x:y]]), pack_sums(sums[by[x:y]]), b"") for x, y in _cuts(home[by])]
        return _table([*out, (TOTALS, bucket, -1, _stats(total, int(number.max(initial=-1)) + 1), b"", b"")])

    return run


def answer(table: pa.Table) -> pa.Table:
    """The sums of the histories that each block asks for; those without n-grams above the cutoff are left out (alpha 1)."""
    rows = table.to_pylist()
    told, asks = [r for r in rows if r["kind"] == CONTEXT], [r for r in rows if r["kind"] == ASK]
    if not told or not asks:
        return _table([])
    ids = np.concatenate([from_steps(r["a"], np.int64) for r in told])
    keys, back = np.unique(ids, return_inverse=True)
    sums = np.zeros((len(keys), _SUMS), np.int64)
    np.add.at(sums, back, np.concatenate([unpack_sums(r["b"]) for r in told]))
    key, block = np.concatenate([from_steps(r["a"], np.int64) for r in asks]), np.concatenate([unpack(r["b"], np.int64) for r in asks])
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = keys[at] == key
    at, block = at[hit], block[hit]
    by = np.lexsort((at, block))
    by = by[np.concatenate([[True], (at[by][1:] != at[by][:-1]) | (block[by][1:] != block[by][:-1])])] if len(by) else by
    at, block = at[by], block[by]
    return _table([(ALPHA, rows[0]["bucket"], int(block[x]), steps(keys[at[x:y]]), pack_sums(sums[at[x:y]]), b"") for x, y in _cuts(block)])


def evaluate(model: Model):
    """Scores of a block's texts from its file, its n-grams' counts and the alphas it asked for, order by order."""

    def run(table: pa.Table) -> pa.Table:
        b, grams, backoff, _ = _rebuilt(model, len(model.levels), table.to_pylist())
        counts = grams[0].counts[b.tokens]
        p = model.word(counts)
        for level, (below, g, (alpha, share)) in enumerate(zip(grams, grams[1:], backoff[1:]), 1):
            c, h = g.counts[g.token], g.before
            seen = c >= model.levels[level].cutoff
            p = np.where(seen, share[h] * model.levels[level].discounts.ratio(c) * c / np.maximum(below.counts[h], 1), alpha[h] * p)
        base, known = np.log10((counts + 1) / (model.n + model.v + 1)), (counts > 0).astype(np.int64)
        total = lambda x: np.add.reduceat(x, b.first[:-1]) if len(x) else np.zeros(0)
        return pa.table({"id": pa.array(b.ids, mask=b.valid == 0), "held_out": pa.array(b.learn == 0), "n_tokens": pa.array(np.diff(b.first)), "n_known": pa.array(total(known)), "base_score": pa.array(total(base)), "score": pa.array(total(np.log10(p)))})

    return run


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    df.write.partitionBy("kind").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def _totals(stored: DataFrame) -> np.ndarray:
    """Sums over the buckets' few numbers, a row a bucket; of the last, the largest."""
    rows = [np.frombuffer(r.a, "<i8") for r in stored.filter(F.col("kind") == TOTALS).select("a").collect()]
    rows = np.array(rows or [np.zeros(TOP + 5, np.int64)])
    return np.append(rows[:, :-1].sum(axis=0), rows[:, -1].max())


def _tally(stored: DataFrame) -> np.ndarray:
    """Words by class of counts, from the buckets' tallies."""
    return sum((unpack(r.b, np.int64) for r in stored.filter((F.col("kind") == TOTALS) & (F.length("b") > 0)).select("b").collect()), np.zeros(Curve.CLASSES, np.int64))


def score_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, order: int = ORDER, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    The model learns from the rows whose crc32 of the id as text mod ``folds`` is not ``held_out``. ``score`` is the
    log10 probability of the whole text, end included; ``base_score`` that of add-one counts of single tokens.
    ``cutoffs``: the least count of n-grams of each order, not falling; the last one holds for further orders.

    Cases: null text counts as empty and is one token, the end; a null id counts as "" for the fold; repeated rows are
    learned as often as they occur; rows of one id with different texts are texts of their own; an empty table gives
    no rows; without training rows every token is unseen; other columns are ignored, whatever their names.
    """
    cutoffs = (cutoffs + cutoffs[-1:] * order)[:order]
    if cutoffs[0] != 1 or list(cutoffs) != sorted(cutoffs):
        raise ValueError("cutoffs begin with 1 and don't fall")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = buckets(spark, rows)
    folder = scratch(spark, "blocks")
    system, at = fs.FileSystem.from_uri(folder)
    system.create_dir(at, recursive=True)
    by_word = rows.mapInArrow(make_blocks(folder, n, folds, held_out), SCHEMA).groupBy("bucket").applyInArrow(count_words(n, min(cutoffs[1], 2) if order > 1 else None), SCHEMA)
    by_word = _stored(spark, by_word, "order1")
    model = Model(n, cutoffs, _totals(by_word), _tally(by_word))
    level_of = lambda df, level: df.withColumn("level", F.lit(level))
    known = level_of(by_word.filter(F.col("kind").isin(FILE, COUNTS)), 0)
    answers = []  # alphas go to the blocks once, when texts are scored: they are not stored between
    for level in range(1, order):
        sent = known.repartition(n, "block").groupBy("block").applyInArrow(send(model, level), SCHEMA).repartition(n, "bucket")
        found = _stored(spark, sent.groupBy("bucket").applyInArrow(count_grams(model, level), SCHEMA), f"order{level + 1}")
        model.learn(_totals(found))
        answers.append(level_of(found.filter(F.col("kind").isin(CONTEXT, ASK)).groupBy("bucket").applyInArrow(answer, SCHEMA), level))
        known = known.unionByName(level_of(found.filter(F.col("kind") == COUNTS), level))
    for alphas in answers:
        known = known.unionByName(alphas)
    out = known.repartition(n, "block").groupBy("block").applyInArrow(evaluate(model), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
