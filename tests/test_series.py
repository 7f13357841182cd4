"""Signing modes against a plain walk over the observations."""

import random

from ledgerloom.operators.series import mode_changes
from pyspark.sql import functions as F


def walked(modes):
    mode, count, flips = None, {"single": 0, "multisig": 0}, 0
    for m in modes:
        if m not in count:
            continue
        count[m] += 1
        if m != mode and count[m] >= 2:
            flips += mode is not None
            mode, count = m, {"single": 0, "multisig": 0}
    return mode, flips


def test_modes_as_walked_whatever_the_pieces(spark):
    dice = random.Random(5)
    lives = {k: [dice.choice(["single", "multisig", "multisig" if k % 2 else "single", None, "other"]) for _ in range(dice.randrange(1, 60))] for k in range(40)}
    rows = [(k, i, m) for k, life in lives.items() for i, m in enumerate(life)]
    dice.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, at int, mode string")
    want = {k: (len(life), *walked(life)) for k, life in lives.items()}
    assert max(f for _n, _m, f in want.values()) > 3
    for piece in (None, F.floor(F.col("at") / 7), F.col("at")):
        assert {r["k"]: (r["n"], r["mode"], r["flips"]) for r in mode_changes(df, "k", ["at"], "mode", piece).collect()} == want
    assert mode_changes(df.limit(0), "k", ["at"], "mode").count() == 0
