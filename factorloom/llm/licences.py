r"""License scans by a positional rare-token index (operator 9). DataFrame functions only.

The index keeps, for each text, the positions of the words that occur in any notice below. A notice is found by its
words of highest IDF first: the places where they stand, each shifted by its position in the notice, are
intersected, down to all words of the mandatory key phrase, which verifies the place. Words are runs of
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


class Notice(NamedTuple):
    label: str
    text: str  # the usual wording
    key: str  # the mandatory key phrase, a part of it
    base: bool = False


# Labels, usual wordings and key phrases of common public licence notices.
NOTICES = [
    Notice("mit", "released under the mit license", "under the mit license", True),
    Notice("apache-2", "licensed under the apache license version 2 0", "apache license version 2", True),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", True),
    Notice("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Notice("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Notice("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    Notice("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source and binary forms"),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Notice("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    Notice("all-rights-reserved", "all rights reserved", "all rights reserved"),
    # headers and bodies of licence files; notices of one label have keys that cannot start at one place
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Notice("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 3"),
    Notice("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 2"),
    Notice("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works", "general public license is a free copyleft license"),
    Notice("lgpl-3", "gnu lesser general public license as published by the free software foundation either version 3 of the license", "gnu lesser general public license as published by the free software foundation either version 3"),
    Notice("agpl-3", "gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero general public license as published by the free software foundation either version 3"),
    Notice("apache-2", "terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions", "terms and conditions for use reproduction and distribution"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee is hereby granted"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Notice("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "to deal in the software without restriction"),
    Notice("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies"),
    Notice("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "you may not use this file except in compliance with the license"),
    Notice("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    Notice("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    Notice("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "this source code form is subject to the terms of the mozilla public license"),
    Notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you can redistribute it and or modify it under the terms of the gnu"),
    Notice("warranty-disclaimer", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "is provided as is without warranty of any kind"),
    # names and short identifiers
    Notice("mit", "the mit license", "mit license"),
    Notice("mit", "spdx license identifier mit", "license identifier mit"),
    Notice("apache-2", "spdx license identifier apache 2 0", "apache 2 0"),
    Notice("apache-2", "the apache 2 license", "apache 2 license"),
    Notice("gpl-3", "spdx license identifier gpl 3 0", "gpl 3 0"),
    Notice("gpl-2", "spdx license identifier gpl 2 0", "gpl 2 0"),
    Notice("bsd", "spdx license identifier bsd 3 clause", "bsd 3 clause"),
    Notice("bsd", "spdx license identifier bsd 2 clause", "bsd 2 clause"),
    Notice("mpl-2", "spdx license identifier mpl 2 0", "mpl 2 0"),
    Notice("cc0", "creative commons zero cc0 1 0 universal", "cc0 1 0"),
]
BITS = 16  # of a word number, below its position


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD))


def index(docs: DataFrame, text_col: str, vocabulary: list[str]) -> DataFrame:
    """``docs`` without the text, with ``n_words`` and ``hits``: (position << BITS | word number) of each notice word."""

    def scan(w: Column) -> Column:
        spots = F.filter(F.transform(w, lambda x, i: F.when(x.isin(vocabulary), F.shiftleft(i.cast("long"), BITS) + F.array_position(F.lit(vocabulary), x))), lambda x: x.isNotNull())
        return F.struct(F.size(w).cast("long").alias("n_words"), spots.alias("hits"))

    keep = [c for c in docs.columns if c != text_col]
    return docs.select(*keep, F.inline(F.transform(F.array(words(F.col(text_col))), scan)))


def _constant(values: list, kind: str) -> Column:
    """A constant array, as one literal however long it is."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _starts(hits: Column, notice: list[int], order: list[int]) -> Column:
    """Starts of a run of word numbers; ``order`` has its positions from the rarest word on."""

    def of(word: Column, j: Column) -> Column:
        own = F.filter(hits, lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1).cast("long")) == word)
        return F.transform(own, lambda h: F.shiftright(h, BITS) - j)

    rest, words_ = _constant(order[1:], "bigint"), _constant(notice, "bigint")
    first = of(F.lit(notice[order[0]]).cast("long"), F.lit(order[0]).cast("long"))
    return F.aggregate(rest, first, lambda found, j: F.when(F.size(found) == 0, found).otherwise(F.array_intersect(found, of(F.get(words_, j.cast("int")), j))))


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[Notice] = NOTICES) -> DataFrame:
    """Licence notices in each row of ``docs``: ``id_col, n_words, places array<struct<label, base, start, score>>``.

    All places of every notice are found. ``score``: the IDF-weighted part of the usual wording that stands around
    the key phrase. IDF counts the documents of the whole table.

    Cases: null text counts as empty and has no words; texts without notices have an empty array; repeated rows and
    null ids are rows like others; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    vocabulary = sorted({w for n in notices for w in n.text.split()})
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = materialize(spark, index(rows, "text", vocabulary), "licence_words")
    df = found.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))))).alias("w")).groupBy("w").count()
    n, df = found.count(), {r["w"]: r["count"] for r in df.collect()}  # a row for each word of the notices at most
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in number.values()}

    def places(hits: Column) -> Column:
        parts = []
        for notice in notices:
            key, text = [number[w] for w in notice.key.split()], [number[w] for w in notice.text.split()]
            at = next(i for i in range(len(text)) if text[i : i + len(key)] == key)
            order = sorted(range(len(key)), key=lambda j: (-idf[key[j]], j))
            whole = sum(idf[w] for w in text)
            outside = [j for j in range(len(text)) if not at <= j < at + len(key)]
            inner = sum(idf[w] for w in key)

            around = [_constant(x, kind) for x, kind in ((outside, "bigint"), ([text[j] for j in outside], "bigint"), ([idf[text[j]] for j in outside], "double"))]

            def score(start: Column, around=around, at=at, inner=inner, whole=whole) -> Column:
                near = F.transform(around[0], lambda j, i: F.when(F.array_contains(hits, F.shiftleft(start - at + j, BITS) + F.get(around[1], i)), F.get(around[2], i)).otherwise(0.0))
                return F.aggregate(near, F.lit(inner), lambda a, b: a + b) / whole

            def place(start: Column, notice=notice, score=score) -> Column:
                return F.struct(F.lit(notice.label).alias("label"), F.lit(notice.base).alias("base"), start.alias("start"), score(start).alias("score"))

            parts.append(F.transform(_starts(hits, key, order), _unary(place)))
        return F.concat(*parts)

    return found.select(F.col("id").alias(id_col), "n_words", places(F.col("hits")).alias("places"))


def _unary(f):
    return lambda x: f(x)


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest of ``scan``'s places: counts and bounds of the base notices, labels and the best score to 6 decimals.

    Cases: without places the bounds are null, the labels "" and the score 0; rows come out as often as they go in.
    """
    base = F.filter("places", lambda p: p["base"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    return found.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.round(F.least(F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)), F.lit(1.0)), 6).alias("score"),
    )
