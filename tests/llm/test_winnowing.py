import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from factorloom.llm import winnowing

from .conftest import ODD


def brute_marks(text, k=winnowing.K, w=winnowing.WINDOW):
    """(position, hash) of the grams chosen: of each window the least by its upper 51 bits, the rightmost on ties."""
    grams = [text[i : i + k] for i in range(max(len(text) - k + 1, min(1, len(text))))]
    hashes = [int.from_bytes(xxhash.xxh64_digest(g.encode("utf-32-be"), 42), "big", signed=False) for g in grams]
    hashes = [h - (1 << 64) if h >> 63 else h for h in hashes]
    out = {}
    for i in range(max(len(hashes) - w + 1, min(1, len(hashes)))):
        at = min(range(i, min(i + w, len(hashes))), key=lambda j: (hashes[j] >> 13, -j))
        out[at] = hashes[at]
    return sorted(out.items())


def jaccard(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


EXTRA_TEXTS = ["", "a", "ab" * 300, "x" * 5000, "中文字符没有空格" * 40, "😀é" * 30, "".join(random.Random(4).choice("abcd") for _ in range(9000))]


@pytest.mark.parametrize("k,w,stretch", [(12, 8, 4096), (5, 8, 16), (3, 5, 7), (2, 1, 64)])
def test_selection(spark, corpus, odd, k, w, stretch, monkeypatch):
    monkeypatch.setattr(winnowing, "STRETCH", stretch)
    extra = spark.createDataFrame([(t,) for t in EXTRA_TEXTS], "text string")
    for df in (corpus.select("text").limit(30), odd.select("text").filter("doc_id is null or doc_id <> 6"), extra):
        for r in df.select("text", winnowing.fingerprint(F.col("text"), k, w).alias("f")).collect():
            assert [(m["position"], m["hash"]) for m in r.f] == brute_marks(r.text or "", k, w)


def test_shared_runs_share_a_hash(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    run = winnowing.K + winnowing.WINDOW - 1
    rows = [(word(rnd.randint(0, 60)) + (x := word(run)) + word(rnd.randint(0, 60)), word(rnd.randint(0, 60)) + x + word(rnd.randint(0, 60))) for _ in range(200)]
    got = spark.createDataFrame(rows, "a string, b string").select(winnowing.marks(F.col("a"))["hashes"].alias("a"), winnowing.marks(F.col("b"))["hashes"].alias("b")).collect()
    assert all(set(r.a) & set(r.b) for r in got)


@pytest.mark.parametrize("parts", [1, 2, 7, 200])
def test_next_document(spark, corpus, parts):
    got = {r.doc_id: r for r in winnowing.with_next(corpus.select("doc_id", "text"), "doc_id", {"text": "text", "n": "n"}, parts, {"n": F.length("text")}).collect()}
    rows = sorted(((r.doc_id, r.text) for r in corpus.collect()), reverse=True)
    assert len(got) == len(rows)
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        assert (got[key].text, got[key].next_text, got[key].next_n) == (text, after, len(after))


def test_compare(spark, corpus, odd, none):
    texts = [t for t in EXTRA_TEXTS] + ["short text", "tiny", "", "a text of some twenty chars", "ab", "abc"]
    df = corpus.select("doc_id", "text").unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), reverse=True)
    got = {r.doc_id: r for r in winnowing.compare(spark, df).collect()}
    by_marks = {}
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, other, following = brute_marks(text), brute_marks(edited), brute_marks(after)
        r = got[key]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_marks == len(own)
        assert r.near_edited == pytest.approx(jaccard(own, other), abs=1e-12) and r.near_next == pytest.approx(jaccard(own, following), abs=1e-12)
        for digest, m in ((r.fingerprint, own), (r.edited_fingerprint, other)):
            assert by_marks.setdefault(tuple(m), digest) == digest
    assert len(set(by_marks.values())) == len(by_marks)
    strange = winnowing.compare(spark, odd).collect()
    assert sorted(str(r.doc_id) for r in strange) == sorted(str(r[0]) for r in ODD)
    twins = [r for r in strange if r.doc_id == 1]
    assert len(twins) == 2 and twins[0].fingerprint == twins[1].fingerprint and max(t.near_next for t in twins) == 1
    assert winnowing.compare(spark, none).count() == 0
    alone = winnowing.compare(spark, odd.filter("doc_id = 5")).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"ono").hexdigest()
