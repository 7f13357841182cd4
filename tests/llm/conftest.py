import random

import pytest

#: Columns whose names operators use for themselves.
CLASHES = ("size", "h", "fp", "score", "piece", "shard", "hits", "copies", "node", "old", "v", "k")


def frame(spark, rows, clash=True):
    """Documents of (doc_id, text, source) with more columns, some of clashing names."""
    names = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, None if i is None else "en", s, None if t is None else len(t)) for i, t, s in rows]
    if clash:
        names += "".join(f", `{c}` string" for c in CLASHES)
        full = [(*r, *(None if n % 3 else f"x{n}" for n in range(len(CLASHES)))) for r in full]
    return spark.createDataFrame(full, names)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, ties, repeats and a long text."""
    long = prose(1, 20_000)
    rows = [
        (1, prose(2, 60), "a"), (2, prose(2, 60), "a"), (3, None, "b"), (4, "", None), (5, " \n\t ", "b"), (6, long, "c"), (7, "Ünïcode ÄÖ ß   K", "a"),
        (8, prose(3, 30), None), (8, prose(3, 30), None), (9, "one", "c"), (None, prose(4, 40), "a"), (None, None, None), (10, prose(2, 59) + " other", "a"),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


def same_rows(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
