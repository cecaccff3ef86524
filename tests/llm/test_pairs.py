"""Near-duplicate operators and connected components against brute force."""

import random
import re
import string

import numpy as np
import pytest

from factorloom.llm import embeddings, graph, jaccard
from factorloom.llm.signature_tree import SignatureTree, windowed_links

from .conftest import ODD

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, percent=75):
    sets = {}
    links = []
    for key, text in rows:
        s = shingles(text)
        for other, t in sets.items():
            if key is not None and s and t and 100 * len(s & t[0]) >= percent * len(s | t[0]):
                links.append((key, other[0]))
        if key is not None:
            sets[key, len(sets)] = (s,)
    return closure({k for k, _ in rows if k is not None}, links)


@pytest.mark.parametrize("seed", range(30))
def test_signature_tree(seed):
    rng = np.random.default_rng(seed)
    base = [rng.choice(3000, rng.integers(1, 80), replace=False) for _ in range(4)]
    sets = []
    for _ in range(rng.integers(1, 90)):
        own = set(base[rng.integers(4)].tolist())
        for _ in range(rng.integers(0, 9)):
            if rng.random() < 0.5 and len(own) > 1:
                own.pop()
            else:
                own.add(int(rng.integers(3000)))
        sets.append(np.sort(np.array(list(own), np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 175 * len(np.intersect1d(a, b)) >= 75 * (len(a) + len(b))]
    for found in (SignatureTree(sets, 75).links(), windowed_links(sets, 75, np.arange(len(sets)))):
        assert set(map(frozenset, found)) <= set(map(frozenset, links)) | {frozenset()}
        assert closure(range(len(sets)), found) == closure(range(len(sets)), links)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(i, i ^ 1) for i in range(20)] + [(5, None), (None, 3)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r.node: r.component for r in graph.components(spark, df).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == closure({x for e in real for x in e}, real)


def test_random_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    got = {r.node: r.component for r in graph.components(spark, spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == closure({x for e in real for x in e}, real)


def test_classes(spark, corpus, odd, none):
    got = jaccard.classes(spark, corpus).collect()
    want = brute([(r.doc_id, r.text) for r in corpus.collect()])
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) < len(want)
    texts = {r.doc_id: r.text for r in corpus.collect()}
    assert all(r.n_shingles == len(shingles(texts[r.doc_id])) for r in got)
    kept = jaccard.representatives(corpus, jaccard.classes(spark, corpus))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == corpus.columns
    strange = jaccard.classes(spark, odd).collect()
    assert len(strange) == len(ODD)
    want = brute([(r[0], r[1]) for r in ODD])
    assert all(r.component_id == want.get(r.doc_id) for r in strange)
    assert want[8] == 1  # 6 of 7 shingles
    assert jaccard.representatives(odd, jaccard.classes(spark, odd)).count() == len(set(want.values())) + 2
    assert jaccard.classes(spark, none).count() == 0


@pytest.mark.parametrize("block", [60, 400])
def test_groups_cut_into_blocks(spark, monkeypatch, block):
    """Groups far larger than a task's share, with near copies that only reach each other through others."""
    rnd = random.Random(9)
    words = [f"t{i}" for i in range(40)]
    rows, text = [], list(words)
    for i in range(50):
        rows.append((i * 2, " ".join(text)))
        if i % 10 == 9:
            text = [f"u{i}_{j}" for j in range(rnd.randint(6, 40))]
        else:
            text = list(text)
            text[-1 - (i % 3)] = f"x{i}"
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = jaccard.saved_sets(df.selectExpr("doc_id id", "text"), 5)
    groups = graph.components(spark, jaccard.group_edges(sets, 8, 75))
    links = jaccard.set_links(spark, sets, groups, 8, 75, block=block)
    got = {k: k for k, _ in rows} | {r.node: r.component for r in graph.components(spark, links).collect()}
    assert got == want


def cosines(rows, least=0.98):
    ok = [(k, np.array(v, float), lab) for k, v, lab in rows if k is not None and v and lab is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = []
    for i, (a, x, p) in enumerate(ok):
        for b, y, q in ok[:i]:
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links.append((a, b))
    return links


def check_vectors(spark, rows):
    df = spark.createDataFrame([(*r, "id", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, times int").repartition(3)
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark, df).collect()}
    links = cosines(rows)
    want = closure([r[0] for r in rows], links)
    count = {}
    for a, b in links:
        count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
    for k in want:
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (count.get(k, 0), want[k], want[k] == k), k
    return links


def clustered(n, labels, seed, spread=0.03, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + spread * rng.normal(size=dim) * rng.integers(0, 4)
        rows.append((i * 5 + 2, np.float32(v).tolist(), int(rng.integers(labels))))
    return rows


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1000001, None, 0), (1000002, [0.0] * 6, 0), (1000003, [nan] + [1.0] * 5, 0), (1000004, [inf] * 6, 0), (1000005, [None] + [1.0] * 5, 0), (1000006, [1.0] * 6, None), (1000007, [1.0] * 5, 0), (1000008, [2.0] * 6, 1), (1000009, [3.0] * 6, 1), (1000010, [], 1)]
    assert check_vectors(spark, clustered(120, 2, 1) + odd)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(spark, empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_many_cells_and_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(embeddings, "CELL", 20)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rows = clustered(300, 2, seed)
    rows += [(5000 + i, rows[0][1], rows[0][2]) for i in range(70)]  # one vector many times
    assert len(check_vectors(spark, rows)) > 300
