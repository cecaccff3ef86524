"""Classifier, line dedup and language model."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factorloom.llm import katz, lines, quality

from .conftest import ODD


def test_features_by_brute_force():
    texts = ["the the cat", "", "a", "é É", "x y x y"]
    for text, got in zip(texts, quality.features(pa.array(texts))):
        raw = text.encode()
        grams = {raw[i : i + k] for k in (1, 2, 3) for i in range(len(raw) - k + 1)}
        w = text.split()
        rough = len(grams) + len(set(w)) + len(set(zip(w, w[1:])))
        assert rough <= len(got) <= rough + 3 if text else len(got) == 0  # and the repeats of a word


def test_same_text_same_features_anywhere():
    texts = ["one two two three", "x" * 50, "", "one two two three", "b\nc"]
    both = list(quality.features(pa.array(texts)))
    for t, x in zip(texts, both):
        assert (next(quality.features(pa.array([t]))) == x).all()


def test_classifier_on_held_out(spark, odd, none):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    rows = []
    for i in range(600):
        w = [word() for _ in range(rnd.randint(5, 60))]
        good = i % 3 > 0
        text = " ".join(w) + "." if good else rnd.choice([" ".join(x + "$$$" for x in w), " ".join(w).upper() + "!!", " ".join([w[0]] * 30)])
        rows.append((i, text, int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(spark, docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 100 and all(got[r[0]].held_out == (r in held) for r in rows)
    assert np.mean([got[r[0]].predicted == r[2] for r in held]) > 0.97
    assert all(got[k].predicted == int(got[k].score >= 0.7) and 0 <= got[k].score <= 1 for k in got)
    flipped = spark.createDataFrame([(r[0], 1 - r[2] if r in held else r[2]) for r in rows], "doc_id long, quality int")
    assert all(got[r.doc_id].score == r.score for r in quality.classify(spark, docs, flipped).collect())
    model = quality.train(spark, quality.training_rows(docs, labels))
    strange = quality.score(spark, odd, model, keep=odd.columns)
    assert strange.count() == len(ODD) and set(odd.columns) <= set(strange.columns)
    assert quality.score(spark, none, model).count() == 0
    assert quality.classify(spark, odd, labels.limit(0)).count() == len(ODD)
    assert quality.classify(spark, docs, labels.filter("quality = 1")).filter("predicted = 0").count() == 0


def tokens_of(line):
    return ["<*>" if re.search("[0-9]", t) else t for t in re.split(r"[ \t\n\x0b\x0c\r]+", line) if t]


def brute_keys(t, depth):
    """Contents of the runs of a masked line."""
    n, out = len(t), []
    for j in range(lines.RUNS):
        if n >= lines.LONG:
            a, b = n * j // lines.RUNS, n * (j + 1) // lines.RUNS
            at = max(range(a, b), key=lambda i: (len(t[i]), -i))
            out.append((-1, *t[max(at - 2, 0) : max(at - 2, 0) + 5]))
        elif n > depth:
            a, b = (n - depth) * j // lines.RUNS, (n - depth) * (j + 1) // lines.RUNS
            if a < b:
                out.append((n, *t[:depth], j, *t[depth + a : depth + b]))
    return out


def brute_lines(rows, depth=lines.DEPTH):
    """Texts without the lines of recurring templates, from the rule as it is stated."""
    order = lambda t: hashlib.md5(" ".join(t).encode()).hexdigest()[:15]
    every = {tuple(t) for _, text in rows for ln in (text or "").split("\n") if (t := tokens_of(ln))}
    runs = {t: brute_keys(t, depth) for t in every}
    head = {}
    for t, keys in runs.items():
        for k in keys:
            head[k] = min(head.get(k, t), t, key=order)
    template = {t: {t} for t in every}
    joined = set()
    for t, keys in runs.items():
        met = Counter(head[k] for k in keys)
        fit = [h for h, c in met.items() if h != t and 100 * c >= lines.SHARE * len(keys)]
        if fit:
            template[t] = {min(fit, key=order)}
            joined |= template[t]
    for h in joined:
        template[h].add(h)
    docs = {}
    for key, text in rows:
        for t in {tuple(tokens_of(ln)) for ln in (text or "").split("\n")} - {()}:
            for x in template[t]:
                docs.setdefault(x, set()).add(key)
    recurs = lambda x: len(docs[x] - {None}) >= (lines.LONG_DOCS if max(map(len, (t for t in every if x in template[t]))) >= lines.LONG else lines.MIN_DOCS)
    dropped = {x: min(docs[x] - {None}) for x in docs if recurs(x)}
    out = []
    for key, text in rows:
        every_line = [] if text is None else text.split("\n")
        kept = [ln for ln in every_line if not (t := tuple(tokens_of(ln))) or not any(x in dropped and key != dropped[x] for x in template[t])]
        out.append((key, text if len(kept) == len(every_line) else "\n".join(kept), len(every_line), len(every_line) - len(kept)))
    return out


def test_lines(spark, corpus, odd, none):
    notice = "Order 17 of 2021 was shipped to you"
    rnd = random.Random(8)
    passage = " ".join("paa" + "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(1, 9))) for _ in range(56))
    names = ["anna", "boris", "carla", "dora", "emil", "frida", "gustav"]
    more = [(2000 + i, f"own words of text number {'abcdefg'[i]}\nOrder {i} of 20{i} was shipped to you\n{passage} {'xyz'[i % 3]}\nab\nWritten by {name} for the daily news desk today\nShare this page\nuser {name} logged in from {name[::-1]}\n\nab") for i, name in enumerate(names)]
    more += [(1999, notice), (2010, passage.replace(passage.split()[20], "new " + passage.split()[20], 1)), (2011, "new " + passage)]  # a word more within or before
    df = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    for frame in (df, odd.select("doc_id", "text"), odd.select("doc_id", "text").unionByName(odd.select("doc_id", "text").filter("doc_id in (1, 8)").selectExpr("doc_id + 50 doc_id", "text"))):
        want = brute_lines([(r.doc_id, r.text) for r in frame.collect()])
        got = lines.dedup(spark, frame).collect()
        assert sorted(map(str, ((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got))) == sorted(map(str, want))
    out = {r.doc_id: r for r in lines.dedup(spark, df).collect()}
    assert passage in out[2000].text and all("paa" not in out[k].text for k in [*range(2001, 2007), 2010, 2011])
    for part in ("own words", "Written by", "Share this", "logged in"):
        assert part in out[2000].text and not any(part in out[2000 + i].text for i in range(1, 7))
    assert all("shipped" not in out[2000 + i].text for i in range(7)) and "shipped" in out[1999].text
    assert all("\n\n" in f"\n{out[2000 + i].text}\n" for i in range(7))  # blank lines stay
    kept = lines.dedup(spark, odd)
    assert kept.columns == [*odd.columns, "n_lines", "n_dropped"] and lines.dedup(spark, none).count() == 0


def test_templates_and_depth(spark):
    rows = [(i, f"Written by {name} for the daily news desk today\n{name} was here on day {i} again then") for i, name in enumerate("anna boris carla dora".split())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = lambda depth: {(r.template, r.n_docs, r.first) for r in lines.templates(spark, docs, depth=depth).collect()}
    written = ("Written by <*> for the daily news desk today", 4, 0)
    assert at(1) == {written}
    assert at(0) == {written, ("<*> was here on day <*> again then", 4, 0)}  # no leading token parts the names
    assert at(3) == set()  # the name is on the path
    for depth in (0, 1, 3):
        want = brute_lines(rows, depth)
        assert sorted(want) == sorted(map(tuple, lines.dedup(spark, docs, depth=depth).collect()))


def test_line_rules_on_small_lines(spark):
    """Two documents are enough for a long line, three for a short one; what stands twice in one document is no recurrence."""
    long, short = " ".join(f"w{chr(97 + i)}" for i in range(lines.LONG)), "to whom it may concern"
    rows = [(1, f"{long}\n{short}\nx\nx"), (2, f"{long}\n{short}"), (3, "y"), (None, f"{long}\nx"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, map(tuple, lines.dedup(spark, docs).collect())))
    assert got == sorted(map(str, [(1, rows[0][1], 4, 0), (2, short, 2, 1), (3, "y", 1, 0), (None, "x", 2, 1), (None, None, 0, 0)]))


def good_turing(counts, cutoff):
    """Ratios by count, from the textbook formula; absolute discounting where that gives none in (0, 1)."""
    n = Counter(counts)
    k = 5
    ratio = {}
    if all(n[r] for r in range(1, k + 2)) and (k + 1) * n[k + 1] < n[1]:
        for r in range(1, k + 1):
            better = (r + 1) * n[r + 1] / n[r]
            ratio[r] = (better / r - (k + 1) * n[k + 1] / n[1]) / (1 - (k + 1) * n[k + 1] / n[1])
    if not ratio or not all(0 < ratio[r] < 1 for r in range(cutoff, k + 1)):
        less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        ratio = {r: (r - less) / r for r in range(1, k + 1)}
    return lambda c: ratio.get(c, 1.0)


class Brute:
    """The model as it is stated, over tuples."""

    def __init__(self, rows, order, cutoffs, folds=7, out=2):
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        self.texts = [(k, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None]) for k, t in rows]
        self.held = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % folds == out
        self.order, self.cutoffs = order, cutoffs
        self.grams = [Counter() for _ in range(order)]
        self.before = [Counter() for _ in range(order)]
        self.after = [defaultdict(set) for _ in range(order)]
        for k, t in self.texts:
            if not self.held(k):
                padded = [0] * (order - 1) + t
                for i in range(order - 1, len(padded)):
                    for m in range(order):
                        h, w = tuple(padded[i - m : i]), padded[i]
                        self.grams[m][h, w] += 1
                        self.before[m][h] += 1
                        self.after[m][h].add(w)
        self.d = [good_turing(g.values(), c) for g, c in zip(self.grams, cutoffs)]
        self.n = sum(self.grams[0].values())
        self.words = {w for _, w in self.grams[0]}
        self.cache = {}

    def p(self, h, w):
        if (h, w) not in self.cache:
            self.cache[h, w] = self._p(h, w)
        return self.cache[h, w]

    def _p(self, h, w):
        m = len(h)
        if m == 0:
            freed = sum((1 - self.d[0](c)) * c for c in self.grams[0].values())
            whole = self.n if freed > 0 else self.n + 1
            c = self.grams[0][(), w]
            return self.d[0](c) * c / whole if c else (freed or 1) / whole
        kept = [x for x in self.after[m][h] if self.grams[m][h, x] >= self.cutoffs[m]]
        if not kept:
            return self.p(h[1:], w)
        mass = sum(self.d[m](self.grams[m][h, x]) * self.grams[m][h, x] for x in kept)
        whole = self.before[m][h] if any(self.grams[m][h, x] <= 5 for x in kept) or len(kept) < len(self.after[m][h]) else self.before[m][h] + 1
        if w in kept:
            return self.d[m](self.grams[m][h, w]) * self.grams[m][h, w] / whole
        if (h, 0) not in self.cache:
            self.cache[h, 0] = (1 - mass / whole) / (1 - sum(self.p(h[1:], x) for x in kept))
        return self.cache[h, 0] * self.p(h[1:], w)


@pytest.mark.parametrize("order,cutoffs", [(3, (1, 1, 2)), (3, (1, 1, 1)), (2, (1, 1)), (4, (1, 2, 2, 3)), (1, (1,))])
def test_katz(spark, corpus, odd, none, monkeypatch, order, cutoffs):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(katz, "SALT_AT", 7)
    frames = [corpus.select("doc_id", "text"), odd.select("doc_id", "text").filter("doc_id is null or doc_id <> 6")]
    frames.append(spark.createDataFrame([(i, "a b a b " * 20) for i in range(12)], "doc_id long, text string"))  # no count is small
    for frame in frames if order == 3 else frames[:1]:
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        brute = Brute(rows, order, cutoffs)
        for m in range(order):  # a distribution at each order
            for h in sorted(brute.before[m], key=str)[:: max(1, len(brute.before[m]) // 5)][:6]:
                assert math.isclose(sum(brute.p(h, w) for w in brute.words) + brute.p(h, "\x01never"), 1, rel_tol=1e-9)
        want = []
        for k, t in brute.texts:
            base = sum(math.log10((brute.grams[0][(), w] + 1) / (brute.n + len(brute.words) + 1)) for w in t)
            padded = [0] * (order - 1) + t
            score = sum(math.log10(brute.p(tuple(padded[i - order + 1 : i]), padded[i])) for i in range(order - 1, len(padded)))
            want.append((str(k), brute.held(k), len(t), sum(w in brute.words for w in t), brute.n, round(base, 6), round(score, 6)))
        got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in katz.score_texts(spark, frame, order=order, cutoffs=cutoffs).collect()]
        for g, w in zip(sorted(got), sorted(want)):
            assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-5)
        assert len(got) == len(want)


def test_katz_on_odd_rows(spark, corpus, odd, none):
    assert katz.score_texts(spark, odd).count() == len(ODD)
    assert katz.score_texts(spark, none).count() == 0
    assert katz.score_texts(spark, corpus, folds=1, held_out=0).filter("n_known > 0 or train_tokens > 0 or not held_out").count() == 0
    with pytest.raises(ValueError):
        katz.score_texts(spark, none, cutoffs=(1, 3, 2))


def test_packing():
    rng = np.random.default_rng(0)
    for x in (np.zeros(0, np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64), np.arange(5, dtype=np.uint32)):
        assert (katz.unpack(katz.pack(x), x.dtype) == x).all()
        assert (katz.from_steps(katz.steps(np.sort(x)), x.dtype) == np.sort(x)).all()
    assert hashlib.sha256(katz.pack(np.arange(3))).hexdigest() == hashlib.sha256(katz.pack(np.arange(3))).hexdigest()


def test_sums_and_numbers_of_ngrams():
    """Sums of histories come back whole, large ones too; numbers rise as counts fall; a pair's suffix is told once a word."""
    rng = np.random.default_rng(1)
    for top in (3, 40, 2**40):
        sums = rng.integers(0, top, (500, katz._SUMS))
        assert (katz.unpack_sums(katz.pack_sums(sums)) == sums).all()
    few = rng.integers(0, 3, (5000, katz._SUMS))
    few[:, 0], few[:, 6] = few[:, 1:6] @ np.arange(1, 6), few[:, 7:] @ np.arange(1, 6)
    assert len(katz.pack_sums(few)) < 0.75 * len(katz.pack(few.T.ravel()))
    total = np.array([1, 70_000, 0, 5, 5, 90_000, 2])
    number = katz._numbers(total, 2)
    assert number.tolist() == [-1, 0, -1, 2, 3, 1, 4]
    may = np.flatnonzero(total >= 2)
    assert (number[may[katz._falling(total[may])]] == np.arange(5)).all()


def test_sizes_and_bits_apart():
    """Numbers of any size come back; sizes and bits apart take a tenth less than byte planes where numbers follow no order."""
    rng = np.random.default_rng(3)
    for dtype in (np.uint8, np.uint32, np.int64):
        for x in ([], [0], [1], [0, 2], rng.integers(0, 200, 1001), *(2.0 ** rng.uniform(0, min(top, np.iinfo(dtype).bits - 1), 5001) for top in (38, 62))):
            x = np.asarray(x).astype(dtype)
            assert katz.unpack(katz.pack_sizes(x), dtype).tolist() == x.tolist()
    assert katz.unpack(katz.pack_sizes(np.array([-5, 3, 2**62])), np.int64).tolist() == [-5, 3, 2**62]
    gaps = (2.0 ** rng.uniform(3, 20, 20_000)).astype(np.int64)
    assert len(katz.pack_sizes(gaps)) < 0.92 * len(katz.pack(gaps))


def test_counts_expected_of_words():
    """Any counts come back from what they are off the curve, which takes less than the counts; words of a few counts lie on it."""
    rng = np.random.default_rng(4)
    counts, buckets = np.maximum(1, 3e5 / np.arange(1, 300_001) ** 1.05).astype(np.int64), 12
    bucket, number, tally = rng.integers(0, buckets, len(counts)), np.zeros(len(counts), np.int64), np.zeros(katz.Curve.CLASSES, np.int64)
    for i in range(buckets):
        own = np.flatnonzero(bucket == i)
        number[own] = katz._numbers(counts[own], 1) * buckets + i
        tally += katz.Curve.tally(counts[own])
    curve, some = katz.Curve(tally), np.argsort(number)[:5000]
    assert tally.sum() == len(counts) and (curve.unpack(number[some], curve.pack(number[some], counts[some])) == counts[some]).all()
    assert len(curve.pack(number[some], counts[some])) < 0.8 * len(katz.pack(counts[some].astype(np.uint32)))
    odd = np.array([0, 1, 31, 32, 2**31, 2**45])
    for c in (curve, katz.Curve(katz.Curve.tally(odd)), katz.Curve(np.zeros(katz.Curve.CLASSES, np.int64))):
        assert (c.unpack(odd * 7, c.pack(odd * 7, odd)) == odd).all()
    flat = katz.Curve(katz.Curve.tally(np.repeat([3, 2, 1], 10)))
    assert flat.at(np.arange(30)).tolist() == [3] * 10 + [2] * 10 + [1] * 10 and flat.at(np.array([10**9])).tolist() == [1]


def test_only_what_is_read_again_is_stored(spark, corpus, monkeypatch):
    """Every kind of rows that an order stores is read by a later step."""
    stored, kinds = katz._stored, []

    def watched(spark, df, name):
        out = stored(spark, df, name)
        kinds.append({r.kind for r in out.select("kind").distinct().collect()})
        return out

    monkeypatch.setattr(katz, "_stored", watched)
    assert katz.score_texts(spark, corpus).count() == corpus.count()
    later = {katz.COUNTS, katz.TOTALS, katz.CONTEXT, katz.ASK}
    assert len(kinds) == 3 and kinds[0] <= {katz.FILE, katz.COUNTS, katz.TOTALS} and all(k <= later for k in kinds[1:])


def test_blocks_keep_their_texts(tmp_path):
    """A block's file gives its tokens back in about one byte a token where words are as frequent as in texts, without their hashes."""
    rng = np.random.default_rng(2)
    hashes = katz.mix((rng.zipf(1.5, 50_000) % 3000).astype(np.uint64))
    first = np.arange(0, 50_001, 50)
    block = katz.Block.of(hashes, first, [None, *range(999)], np.arange(1000) % 2 == 0)
    path = block.save(f"file://{tmp_path}")
    again = katz.Block.load(path)
    assert again.size == len(np.unique(hashes)) and (again.tokens == np.unique(hashes, return_inverse=True)[1]).all()
    assert (again.first == first).all() and (again.ids[1:] == range(999)).all() and again.valid.tolist() == [0] + [1] * 999
    assert (tmp_path / path.rpartition("/")[2]).stat().st_size < 50_000


def test_log_count_ratios():
    """From documents' feature sets counted one by one."""
    texts, y = ["good good words here", "bad words", "good", "bad bad BAD!!", ""], [1, 0, 1, 0, 1]
    sets = list(quality.features(pa.array(texts)))
    sums = np.zeros((2, quality.DIM), np.int64)
    for s, k in zip(sets, y):
        for f in s.tolist():
            sums[k, f] += 1
    got = quality.log_count_ratios(sums)
    totals = [sum(len(s) for s, k in zip(sets, y) if k == c) + quality.DIM for c in (0, 1)]
    for f in {*sets[0].tolist(), *sets[1].tolist()}:
        p, q = (1 + sum(f in s.tolist() for s, k in zip(sets, y) if k == c) for c in (1, 0))
        assert got[f] == pytest.approx(math.log(p / totals[1]) - math.log(q / totals[0]), abs=1e-12)


def test_dual_coordinate_descent_finds_the_optimum(monkeypatch):
    """Its primal objective comes to what plain subgradient steps with averaging reach on the same rows, and no higher."""
    monkeypatch.setattr(quality, "DIM", 6)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 6))
    y = np.where(x[:, 0] - 0.5 * x[:, 3] + 0.3 * rng.normal(size=80) > 0.2, 1, -1)
    rows = [(np.arange(6), r) for r in x]
    w = quality.dual_coordinate_descent(rows, y, cost=0.5, rounds=500)
    full = np.hstack([x, np.ones((80, 1))])
    primal = lambda v: 0.5 * v @ v + 0.5 * np.maximum(0, 1 - y * (full @ v)).sum()
    v, best = np.zeros(7), np.inf
    for t in range(1, 20001):
        hit = y * (full @ v) < 1
        v = v - (v - 0.5 * (y[hit, None] * full[hit]).sum(axis=0)) / (t + 10)
        best = min(best, primal(v))
    assert primal(w) <= best * 1.002
    assert abs(primal(w) - best) < 0.01 * best


def test_sigmoid_fit_is_the_likeliest():
    rng = np.random.default_rng(6)
    m = rng.normal(size=500) * 2
    y = np.where(rng.random(500) < 1 / (1 + np.exp(-(1.7 * m - 0.4))), 1, -1)
    a, b = quality.sigmoid_fit(m, y)
    up, n = (y > 0).sum(), len(y)
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (n - up + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * m + b)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum()

    assert all(loss(a, b) <= loss(a + s, b + t) + 1e-3 for s in (-0.05, 0, 0.05) for t in (-0.05, 0, 0.05))
