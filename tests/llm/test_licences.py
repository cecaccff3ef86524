import math
import re
import string

from factorloom.llm import licences

from .conftest import ODD

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text):
    w = words_of(text)
    places = []
    for n in licences.NOTICES:
        key = n.key.split()
        places += [(n.label, n.base, i) for i in range(len(w)) if w[i : i + len(key)] == key]
    return len(w), sorted(places)


def test_scores_by_brute_force(spark, odd):
    """The IDF-weighted part of the usual wording that stands around the key phrase."""
    texts = ["Released under the MIT license", "used under the mit license", "Licensed under the Apache License, Version 2.0 (the License)", "mit", "", "all rights reserved", "of the mozilla public license v 2", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = [words_of(t) for t in texts]
    df_of = lambda v: sum(v in w for w in split)
    idf = lambda v: math.log((len(texts) + 1) / (df_of(v) + 1)) + 1e-6
    want = []
    for k, w in enumerate(split):
        for n in licences.NOTICES:
            key, text = n.key.split(), n.text.split()
            off = next(i for i in range(len(text)) if text[i : i + len(key)] == key)
            for s in range(len(w) - len(key) + 1):
                if w[s : s + len(key)] == key:
                    hit = [off <= j < off + len(key) or 0 <= s - off + j < len(w) and w[s - off + j] == v for j, v in enumerate(text)]
                    want.append((k, n.label, s, sum(idf(v) for v, h in zip(text, hit) if h) / sum(map(idf, text))))
    got = sorted((r.doc_id, p.label, p.start, p.score) for r in licences.scan(spark, df).collect() for p in r.places)
    assert len(got) == len(want)
    for g, x in zip(got, sorted(want)):
        assert g[:3] == x[:3] and math.isclose(g[3], x[3], rel_tol=1e-9)


def test_keys_stand_in_their_texts_and_start_apart():
    for n in licences.NOTICES:
        assert f" {n.key} " in f" {n.text} "
    for n in licences.NOTICES:
        for m in licences.NOTICES:
            a, b = sorted((n.key.split(), m.key.split()), key=len)
            assert n is m or n.label != m.label or b[: len(a)] != a  # places of one label are told apart by their start


def test_places(spark, odd, none):
    texts = ["Licensed under CC BY-NC 4.0.", "mit mit under the mit mit license under the MIT licensé under the mit license", "GNU General Public License, version 3. All rights reserved.", "apache license version 2 apache license version", "cc by nc cc by nc", "K under the mit license"]
    df = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = licences.scan(spark, df)
    want = sorted((str(k), *brute(t)) for k, t in [*((100 + i, t) for i, t in enumerate(texts)), *((r[0], r[1]) for r in ODD)])
    assert sorted((str(r.doc_id), r.n_words, sorted((p.label, p.base, p.start) for p in r.places)) for r in got.collect()) == want
    rows = {r.doc_id: r for r in licences.summary(got).collect()}
    assert rows[100].labels == "cc-by-nc" and rows[100].score == 1 and rows[100].first_word == 2
    assert rows[102].base_labels == "" and rows[102].labels == "all-rights-reserved,gpl-3" and rows[102].first_word is None
    assert rows[104].n_base == 2 and rows[104].last_word == 3 and 0 < rows[104].score < 1
    assert rows[3].score == 0
    assert licences.summary(licences.scan(spark, none)).count() == 0


def test_headers_and_bodies(spark):
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software",
        "gpl-3": "the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 3 of the License",
        "gpl-2": "GNU General Public License as published by the Free Software Foundation, either version 2",
        "apache-2": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n1. Definitions.",
        "bsd": "Redistributions of source code must retain the above copyright notice, this list",
        "mpl-2": "SPDX-License-Identifier: MPL-2.0",
        "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    assert {r.doc_id: r.labels for r in licences.summary(licences.scan(spark, df)).collect()} == {k: k for k in texts}


def test_short_names(spark):
    rows = [("Apache-2.0", "apache-2"), ("SPDX-License-Identifier: MIT", "mit"), ("The MIT License (MIT)", "mit"), ("GPL-3.0-or-later", "gpl-3"), ("BSD-3-Clause", "bsd"), ("Permit apache helicopters, 2 of them", "")]
    got = {r.doc_id: r.labels for r in licences.summary(licences.scan(spark, spark.createDataFrame([(t, t) for t, _ in rows], "doc_id string, text string"))).collect()}
    assert got == dict(rows)


def test_more_words_than_a_byte(spark):
    w = [f"w{1000 + i}" for i in range(300)]
    df = spark.createDataFrame([(1, "x " + " ".join(w[290:])), (2, " ".join(w[34:44]))], "doc_id long, text string")
    got = {r.doc_id: r.places for r in licences.scan(spark, df, notices=[licences.Notice("n", " ".join(w), " ".join(w[290:294]))]).collect()}
    assert [p.start for p in got[1]] == [1] and got[2] == []
