import random

import pytest

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (1, "a b c d e f g h i j", "en", "x", 19),
    (1, "a b c d e f g h i j", "en", "x", 19),
    (2, None, None, None, None),
    (3, "", "en", "", 0),
    (4, " \t\n ", "en", "x", 4),
    (None, "a b c d e f g h i j", None, "x", 19),
    (None, None, None, None, None),
    (5, "one", "de", "ÿ", 3),
    (6, LONG, "en", "x", len(LONG)),
    (7, "Ünder the MIT license\nunder the MIT license, under the mit License", "en", "y", 60),
    (8, "a b c d e f g h i j k", "en", "y", 21),
    (9, "x\x00y   İ ß <|endoftext|> don't  12,3", "en", "y", 30),
]
EXTRA = ", id string, size int, bucket long, `order` string, `range` int, part int, component_id long, score double, label string, key long, kind int"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in every column, empty, blank and long texts, repeated rows, and columns named like internal ones."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + EXTRA
    return spark.createDataFrame([(*r, "i", 1, 2, "o", 3, 4, 5, 0.5, "l", 6, 7) for r in ODD], schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    """Random texts with exact and near copies, shared lines and some noise; the seed is fixed."""
    rnd = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "ab cd ef gh ij kl mn op".split() for b in "qu rst vw xyz é".split()]
    line = lambda: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 30)))
    shared = [line() for _ in range(3)]
    texts = ["\n".join([line() for _ in range(rnd.randint(1, 5))] + [s for s in shared if rnd.random() < 0.15]) for _ in range(60)]
    for t in texts[:12]:
        words = t.split(" ")
        for _ in range(rnd.randint(1, 3)):
            w = list(words)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            texts.append(" ".join(w))
    rnd.shuffle(texts)
    rows = [(i * 3 + 1, t, "en", f"s{i % 4 if i % 3 else 0}", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def rows_of(df):
    return [r.asDict() for r in df.collect()]
