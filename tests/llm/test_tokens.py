import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from factorloom.llm import bpe, token_files
from factorloom.llm.common import scratch, text_view
from factorloom.llm.fragments import FragmentEncoder

from .conftest import LONG, ODD

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_fragments_encode_like_the_library(path):
    rnd = random.Random(5)
    bits = ["a", "B", "the", "ing", " ", "  ", "\n", "\t", "'s", "'", "’", "1", "23", "é", "é", "́", "É", "ß", "Σ", "ΑΣ", " ", "　", " ", "中", "あ", "!", "?!", "$", "<|endoftext|>", "<|", "|>", "\x00", "\x1c", "\x85", "=", "̸", "😀", "İ", "don't", "'LL", "_"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(4000)] + [LONG, ""]
    enc, lib = FragmentEncoder(path), Tokenizer.from_file(path)
    for _ in range(2):  # cold and from the cache
        ids, first = enc.encode(*text_view(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_bpe_on_odd_rows(odd, none):
    lib = Tokenizer.from_file(WORDS)
    got = bpe.encode(odd, WORDS).collect()
    want = []
    for r in ODD:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.encode(none, WORDS).count() == 0


def test_token_files_round_trip(spark, odd, none):
    lib = Tokenizer.from_file(BYTES)
    path = scratch(spark, "store")
    store = token_files.write(spark, odd, path, BYTES, 2)
    assert store.width == 2
    got = sorted((r.asDict() for r in token_files.read(spark, store, with_ids=True).collect()), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    ids = lambda t: lib.encode(t or "", add_special_tokens=False).ids + [2]
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(r[0]), ids(r[1])) for r in ODD)
    assert token_files.round_trip(spark, none, BYTES, 2).count() == 0
