"""Running values in pieces against a plain walk."""

import random

from ledgerloom.operators import proof
from ledgerloom.operators.joins import as_of_each
from ledgerloom.operators.proof import merged_ranges
from ledgerloom.operators.running import running_max
from pyspark.sql import functions as F

DICE = random.Random(11)


def test_running_max(spark):
    rows = [(DICE.choice([1, 2, None]), i, DICE.choice([None, DICE.randrange(50)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, at int, v int")
    for before in (False, True):
        want, most = {}, {}
        for k, at, v in rows:
            now = max((x for x in (most.get(k), v) if x is not None), default=None)
            want[at] = most.get(k) if before else now
            most[k] = now
        for piece in (None, F.floor(F.col("at") / 9), F.col("at"), F.lit(0)):
            assert {r["at"]: r["m"] for r in running_max(df, ["k"], ["at"], F.col("v"), "m", piece, before).collect()} == want


def test_ranges_in_pieces(spark):
    rows = [(DICE.randrange(3), lo, lo + DICE.randrange(6)) for lo in (DICE.randrange(300) for _ in range(150))]
    df = spark.createDataFrame([*rows, *rows[:20], (9, 0, 299), (9, 5, 6), (9, 250, 310)], "k int, lo long, hi long")
    whole = sorted(merged_ranges(df, ["k"], "lo", "hi").collect())
    assert any(r["pieces"] > 1 for r in whole) and (9, 0, 310, 3) in [tuple(r) for r in whole]
    for width in (1, 7, 1000):
        assert sorted(merged_ranges(df, ["k"], "lo", "hi", F.floor(F.col("lo") / width)).collect()) == whole


def test_ranges_whatever_the_order_of_ties(spark, monkeypatch):
    """Each pass gets its rows in an order of its own, as after a merge of spilled files."""
    passes = []

    def dealt(rows, *a, **k):
        passes.append(1)
        return running_max(rows.repartition(1).sortWithinPartitions(F.rand(len(passes))), *a, **k)

    monkeypatch.setattr(proof, "running_max", dealt)
    df = spark.createDataFrame([(k, lo, lo + 1) for k in range(5) for lo in range(0, 200, 10) for _ in range(4)], "k int, lo long, hi long")
    for piece in (None, F.floor(F.col("lo") / 30)):
        got = sorted(tuple(r) for r in merged_ranges(df, ["k"], "lo", "hi", piece).collect())
        assert got == [(k, lo, lo + 1, 4) for k in range(5) for lo in range(0, 200, 10)]


def test_as_of_in_pieces(spark):
    left = [(DICE.randrange(3), DICE.randrange(100), i) for i in range(80)]
    right = [(DICE.randrange(2), DICE.randrange(100), DICE.randrange(9)) for _ in range(40)]
    a, b = spark.createDataFrame(left, "k int, at int, id int"), spark.createDataFrame(right, "k int, since int, v int")
    want = {i: max(((s, v) for rk, s, v in right if rk == k and s <= at), default=(None, None)) for k, at, i in left}
    for piece in (None, lambda c: F.floor(c / 10), lambda c: c):
        got = as_of_each(a, b, "k", "at", "since", ["v"], piece)
        assert got.columns == ["k", "at", "id", "since", "v"] and {r["id"]: (r["since"], r["v"]) for r in got.collect()} == want
