import random

import pytest
from ledgerloom.llm import common
from ledgerloom.llm.common import components, prefix_sums
from pyspark.sql import functions as F


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    pairs = {"random": [(rng.randrange(-50, 80), rng.randrange(-50, 80)) for _ in range(70)], "path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 90)] + [(5, 5)], "none": []}[kind]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == roots([(a, b) for a, b in pairs if a != b])


def test_prefix_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(5), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, b long, i long, x long")
    got = {r["i"]: (r["s"], r["n"]) for r in prefix_sums(df, ["k"], "b", [F.col("i")], {"s": F.col("x"), "n": F.lit(1)}).collect()}
    for key in "ab":
        s = n = 0
        for _, _, i, x in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            s, n = s + x, n + 1
            assert got[i] == (s, n)


def test_texts_come_in_pieces_of_bounded_size():
    import pyarrow as pa
    from ledgerloom.llm.common import pieces

    texts = pa.array(["a" * 100, None, "", "b" * 5_000, "c" * 10, "ü" * 400, *["d"] * 30])
    runs = list(pieces(texts, 1_000))
    assert [first for first, _ in runs] == [0, *[sum(n for _, n in runs[: k + 1]) for k in range(len(runs) - 1)]] and sum(n for _, n in runs) == len(texts)
    for first, n in runs:
        assert n == 1 or sum(len((t or "").encode()) + 64 for t in texts[first : first + n].to_pylist()) <= 1_000
    assert list(pieces(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, few):
    """Few edges make two jobs' shuffles, not those of rounds; either way the roots are the same."""
    monkeypatch.setattr(common, "FEW", few)
    rng = random.Random(11)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (-(1 << 63), (1 << 63) - 1)]
    jobs, checkpointed = [], common.checkpointed
    monkeypatch.setattr(common, "checkpointed", lambda df: jobs.append(1) or checkpointed(df))
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = roots([p for p in pairs if p[0] != p[1]])
    assert got == {n: want.get(n, n) for p in pairs if p[0] != p[1] for n in p}
    assert (len(jobs) <= 2) == (few > 0)


@pytest.mark.parametrize("few", [0, 250_000])
def test_short_lists_are_joined_without_a_shuffle(spark, monkeypatch, few):
    """Whatever size Spark guesses for the product of lists; no row is lost, and longer lists stay dealt out."""
    monkeypatch.setattr(common, "FEW", few)
    a = common.gathered(spark.range(900).selectExpr("id as u", "id % 7 as v").repartition(5, "u"))
    for _ in range(4):
        a = common.gathered(a.join(a.select(F.col("u").alias("w")), F.expr("u = w")).select("u", "v"))
    both = a.join(a.select(F.col("u").alias("w")), F.expr("v = w"), "left").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    assert ("Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()) == (few > 0)
    assert {r["w"]: r["n"] for r in both.collect()} == {w: sum(i % 7 == w for i in range(900)) for w in range(7)}
    assert common.gathered(a.where("false")).count() == 0
