"""Words built so that polynomial hashes modulo a power of two can't tell them apart."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from factorloom.llm import jaccard, katz
from factorloom.llm.common import distinct_spans, hash_spans, text_view, words
from factorloom.llm.fragments import FragmentEncoder


def twins(size: int) -> tuple[str, str]:
    """A Thue-Morse word and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


PAIRS = [twins(1024), twins(4096)]


def test_spans_are_told_apart():
    texts = [w for p in PAIRS for w in p] + ["a b  a\tb", "", "ab", "é a"]
    raw, offsets = text_view(pa.array(texts))
    starts, ends, _ = words(raw, offsets)
    got = [raw[s:e].tobytes() for s, e in zip(starts, ends)]
    distinct, number = distinct_spans(raw, starts, ends)
    assert [distinct[i] for i in number] == got
    hashes = hash_spans(raw, starts, ends)
    assert len(set(hashes.tolist())) == len(set(got)) and {w: h for w, h in zip(got, hashes.tolist())} == dict(zip(got, hashes.tolist()))
    assert len(hash_spans(raw, starts[:0], ends[:0])) == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(name):
    enc, lib = FragmentEncoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    texts = [w for p in PAIRS for w in p]
    ids, first = enc.encode(*text_view(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_different_words_do_not_link_nor_count_together(spark):
    rows = [(i, w) for i, w in enumerate(w for p in PAIRS for w in p)] + [(9, PAIRS[0][0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark, docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 9: 0}
    scored = katz.score_texts(spark, docs.filter("doc_id < 2"), folds=7, held_out=-1).collect()
    # each word once and the end twice among 4 tokens of 3 kinds
    assert all(abs(r.base_score - (np.log10(2 / 8) + np.log10(3 / 8))) < 1e-9 for r in scored)
