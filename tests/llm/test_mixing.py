import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factorloom.llm import mixing

from .conftest import ODD


def water(sizes, repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not over:
            return full | share
        full |= {s: repeats * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5, "c": 1, "B": 300}, {"a": 5}, {"x": 100, "y": 1, "z": 1, "é": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(water(sizes))


def test_mix(spark, corpus):
    got = mixing.plan(spark, corpus).collect()
    again = mixing.plan(spark, corpus.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in corpus.collect()}
    sizes = {}
    for r in got:
        assert r["size"] == words[r.doc_id] and r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want, longest = water(sizes), max(words.values())
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sizes[s] and own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= 2 * longest
        times = [r.copies for r in own if r["size"]]
        assert max(times) - min(times) <= 1  # none comes again before all have come
    assert sum(r.taken for r in got) <= sum(sizes.values())
    out = mixing.mix(spark, corpus)
    assert out.columns == corpus.columns and out.count() == sum(r.copies for r in got)


def test_odd(spark, odd, none):
    got = mixing.plan(spark, odd).collect()
    assert len(got) == len(ODD) and sum(r.taken for r in got) > 0
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.plan(spark, none).count() == 0 and mixing.mix(spark, none).count() == 0
    blank = odd.withColumn("text", F.lit(" "))
    assert {(r.taken, r.target) for r in mixing.plan(spark, blank).collect()} == {(0, 0.0)}


def test_mix_of_odd_rows(spark, odd):
    """Null ids over different texts, repeated rows: as many copies of each as planned, within the budget."""
    schema = "doc_id long, text string, source string, m map<string,array<int>>, a long, b long"
    rows = [(None, f"null id {'abcdefgh'[i]}", "x", {"k": [None, i]}, None, i) for i in range(8)]
    rows += [(7, "one row many times", "x", None, 1, None)] * 20 + [(i, f"own text {'pqrstuvw'[i % 8]}", "y", {}, i, None) for i in range(100, 140)]
    rows += [(None, "same text", None, None, 3, None), (None, "same text", None, None, None, 3)]
    for df in (odd, spark.createDataFrame(rows, schema).repartition(3)):
        planned, out = mixing.plan(spark, df).collect(), mixing.mix(spark, df)
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
        got = out.collect()
        assert out.columns == df.columns and len(got) == sum(r.copies for r in planned)
        assert sum(size(r.text) for r in got) == sum(r.taken for r in planned) <= sum(r["size"] for r in planned)
        held, taken = Counter(map(str, df.collect())), Counter(map(str, got))
        assert all(taken[r] <= 3 * held[r] for r in taken)
        per_id = Counter()
        for r in planned:
            per_id[r.doc_id] += r.copies
        assert Counter(r.doc_id for r in got) == +per_id
