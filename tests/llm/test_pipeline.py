import hashlib
import re
import shutil
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factorloom.llm import quality, queries

from .conftest import ODD, rows_of
from .test_mixing import water
from .test_text_models import brute_lines

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def brute_representatives(rows):
    """Ids that are the smallest of their class; the class of a set is what its links reach."""
    sets = {}
    for r in rows:
        w = words(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] < label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[b], changed = label[a], True
    return {k for k in sets if label[k] == k}


def brute_mix(rows, seed=7):
    """Copies of each id: offers of all sources by finish time, cut at the total of all sizes."""
    size = {r["doc_id"]: len(words(r["text"])) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += size[r["doc_id"]]
    target, ran, offers = water(dict(sizes)), Counter(), []
    order = lambda r: hashlib.md5(":".join(str(x) for x in (seed, r["doc_id"], size[r["doc_id"]], r["source"]) if x is not None).encode()).hexdigest()
    for r in sorted(rows, key=order):
        ran[r["source"]] += size[r["doc_id"]]
        if size[r["doc_id"]]:
            offers += [((e * sizes[r["source"]] + ran[r["source"]]) / target[r["source"]], order(r), r["doc_id"]) for e in range(3)]
    out, queued = Counter(), 0
    for _, _, key in sorted(offers):
        queued += size[key]
        if queued > sum(size.values()):
            break
        out[key] += 1
    return out


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    """The corpus as a folder of tables, with some junk that its labels tell apart."""
    root = str(tmp_path_factory.mktemp("pipeline"))
    junk = spark.createDataFrame([(1000 + i, " ".join(["$$$", "!!!"] * (5 + i)), "en", "s1", 10) for i in range(40)], corpus.schema)
    docs = corpus.unionByName(junk)
    docs.write.parquet(f"{root}/documents.parquet")
    docs.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality")).write.parquet(f"{root}/labels.parquet")
    return root


def test_every_stage_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name: corpus_pipeline.materialize(spark, stages[name](spark, docs, folder), name.replace(" ", "_"))
    good = {r.doc_id for r in quality.classify(spark, docs, labels).filter("score >= 0.7").collect()}
    before, docs = rows_of(docs), step("quality classifier")
    assert sorted(map(str, rows_of(docs))) == sorted(str(r) for r in before if r["doc_id"] in good)
    assert good and all(k < 1000 for k in good) and len(good) > 0.9 * (len(before) - 40)
    before, docs = rows_of(docs), step("line dedup")
    text = {k: t for k, t, _, _ in brute_lines([(r["doc_id"], r["text"]) for r in before])}
    assert sorted(map(str, rows_of(docs))) == sorted(str(r | {"text": text[r["doc_id"]], "n_chars": len(text[r["doc_id"]])}) for r in before)
    before, docs = rows_of(docs), step("n-gram Jaccard join")
    kept = brute_representatives(before)
    assert sorted(map(str, rows_of(docs))) == sorted(str(r) for r in before if r["doc_id"] in kept)
    before, docs = rows_of(docs), step("mixing sources")
    copies = brute_mix(before)
    assert sorted(map(str, rows_of(docs))) == sorted(str(r) for r in before for _ in range(copies[r["doc_id"]]))
    before, lib = rows_of(docs), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in before:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)), ids))
    assert sorted(map(tuple, stages["BPE encoding"](spark, docs, folder).collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(want)


def test_stages_on_odd_and_empty_tables(spark, odd, none, folder, tmp_path):
    """Null ids and texts, repeated rows, long texts, columns named like inner ones: columns stay, and rows as stated."""
    shutil.copytree(f"{folder}/labels.parquet", tmp_path / "labels.parquet")
    texts = Counter(r[1] for r in ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        rows = rows_of(out)
        assert out.columns == odd.columns and [t for _, t in out.dtypes] == [t for _, t in odd.dtypes], name
        if name == "quality classifier":
            assert not Counter(r["text"] for r in rows) - texts
        elif name == "line dedup":
            assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
        elif name == "n-gram Jaccard join":
            # 1 twice and 8 alike: one row of 1 stays; null ids link with nothing
            assert Counter(r["doc_id"] for r in rows) == Counter({None: 2} | {k: 1 for k in (1, 2, 3, 4, 5, 6, 7, 9)} | ({8: 1} if 8 in {r["doc_id"] for r in rows} else {}))
        else:
            assert all(words(r["text"]) for r in rows)
        empty = stage(spark, none, str(tmp_path))
        assert empty.columns == none.columns and empty.count() == 0, name
    assert corpus_pipeline.encoded(spark, odd, str(tmp_path)).count() == len(ODD)
    assert corpus_pipeline.encoded(spark, none, str(tmp_path)).count() == 0


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.good_quality(spark, docs, SF).collect()}
    good, bad = [k for k in labels if labels[k] == 1], [k for k in labels if labels[k] == 0]
    assert sum(k in kept for k in good) >= 0.95 * len(good) and sum(k in kept for k in bad) <= 0.3 * len(bad)
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
