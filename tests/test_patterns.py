import random
from datetime import datetime, timedelta

import pytest
from ledgerloom.operators import patterns as P
from ledgerloom.operators import series as S
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def route(spark, gaps):
    at, rows = START, [("a", "b", None, 0, START)]
    for n, g in enumerate(gaps, 1):
        at += timedelta(seconds=g)
        rows.append(("a", "b", None, n, at))
    return spark.createDataFrame(rows, "src string, dst string, tag long, ledger long, ts timestamp")


@pytest.mark.parametrize("gaps, found", [([600] * 5, 600), ([600, 600, 720, 600, 600], None), ([600] * 4, None), ([5] * 5, None), ([600, 606, 594, 612, 600], 600), ([600, 613, 600, 600, 600], None)])
def test_regular_interval_at_the_defaults(spark, gaps, found):
    got = P.regular_intervals(route(spark, gaps), ["src", "dst", "tag"], [F.col("ledger")], "ts").collect()
    assert [r["interval_seconds"] for r in got] == ([found] if found else [])


def test_the_median_is_the_upper_one(spark):
    row = spark.range(1).select(P.upper_median(F.array(*map(F.lit, (4, 1, 3, 2)))).alias("m")).first()
    assert row["m"] == 3


def test_burst_against_two_pointers(spark):
    rng = random.Random(1)
    rows = [(g, START + timedelta(seconds=rng.choice([0, 3600, rng.randrange(20_000)]))) for g in range(20) for _ in range(rng.randrange(1, 30))]
    got = {r["g"]: r["burst"] for r in P.burst_share(spark.createDataFrame(rows, "g long, ts timestamp"), "g", "ts").collect()}
    for g in range(20):
        ts = sorted(t for k, t in rows if k == g)
        most = max(sum(1 for u in ts[: i + 1] if (t - u).total_seconds() <= 3600) for i, t in enumerate(ts))
        assert got[g] == (most / len(ts) if len(ts) >= 4 else 0.0)


def test_concentration_counts_missing_counterparties(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("a", None), ("a", None), ("b", None)], "e string, c string")
    assert {r["e"]: r["concentration"] for r in P.concentration(df, "e", "c").collect()} == {"a": 0.4, "b": 0.0}


def test_a_pair_with_itself_counts_twice(spark):
    df = spark.createDataFrame([(1, "a", "a"), (1, "b", "b"), (1, "b", "b"), (1, "a", "b"), (2, "b", "a")], "k long, a string, b string")
    got = {(r["k"], r["a"], r["b"]): r["reciprocal"] for r in P.reciprocal(df, ["k"], "a", "b").collect()}
    assert got == {(1, "a", "a"): False, (1, "b", "b"): True, (1, "a", "b"): False, (2, "b", "a"): False}


def test_flows_at_the_defaults(spark):
    rows = [(f"t{i}", "a", f"r{i % 2}", 400_000.0) for i in range(4)] + [("u", "z", "r0", 400_000.0)]
    df = spark.createDataFrame(rows, "h string, s string, r string, amount double")
    g = P.flow_groups(P.mid_band(df, "amount", 100_000, 1_000_000), "s", "r", "amount")
    assert g["route"].count() == 0 and [r["s"] for r in g["fan_out"].collect()] == ["a"] and [r["r"] for r in g["fan_in"].collect()] == ["r0"]
    assert P.clustered(df, "h", "s", "r", "amount").count() == 5


def test_next_hop_needs_later_ledger_and_time(spark):
    rows = [("x", "n", 5.0e6, 10, 100), ("x", "n", 5.0e6, 12, 120), ("n", "o", 2.0e6, 10, 130), ("n", "o", 3.0e6, 11, 99), ("n", "o", 1.5e6, 11, 100)]
    df = spark.createDataFrame(rows, "s string, r string, a double, l long, t long")
    got = {r["node"]: (r["at_ledger"], r["forwards"], r["status"]) for r in P.next_hops(df, "s", "r", "a", "l", "t").collect()}
    assert got["n"] == (10, 1, "NEXT_HOP_FORWARDING_DETECTED") and got["o"][1:] == (0, "UNPROVEN")


def test_constant_series_have_no_correlation(spark):
    rows = [(0, START + timedelta(days=i), 1.0, float(i % 3 + 1)) for i in range(10)]
    r = S.lead_lag(spark.createDataFrame(rows, "k long, day timestamp, flow double, price double"), ["k"], "day", "flow", "price").first()
    assert r["same"] is None and r["leads"] is None
    assert S.verdict(S.lead_lag(spark.createDataFrame(rows, "k long, day timestamp, flow double, price double"), ["k"], "day", "flow", "price")).first()["relation"] == "none"


def test_lead_lag_by_hand(spark):
    rng = random.Random(3)
    flow, price = [rng.random() for _ in range(12)], [rng.random() + 1 for _ in range(12)]
    chg = [None] + [(price[i] - price[i - 1]) / price[i - 1] * 100 for i in range(1, 12)]
    import numpy as np

    want = {"same": (flow[1:], chg[1:]), "leads": (flow[1:-1], chg[2:]), "lags": (flow[2:], chg[1:-1])}
    r = S.lead_lag(spark.createDataFrame([(0, i, flow[i], price[i]) for i in range(12)], "k long, day long, flow double, price double"), ["k"], "day", "flow", "price").first()
    for k, (a, b) in want.items():
        assert r[k] == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_signing_mode_flips(spark):
    modes = "single single multisig single multisig single single".split()
    df = spark.createDataFrame([("a", i, m) for i, m in enumerate(modes)] + [("b", 0, "single")], "k string, i long, m string")
    got = {r["k"]: (r["n"], r["mode"], r["flips"]) for r in S.mode_changes(df, "k", ["i"], "m").collect()}
    assert got["a"][1:] == ("single", 2) and got["b"][1:] == (None, 0)


@pytest.mark.parametrize("last, want", [(50_000.0, "DRAINED"), (600_000.0, "BLEEDING"), (2_000_000.0, "OK"), (1_300_000.0, "OK")])
def test_drain_state(spark, last, want):
    df = spark.createDataFrame([("a", 0, 2_000_000.0), ("a", 1, last)], "k string, t long, b double")
    assert S.drain(df, "k", "t", "b", F.lit(None).cast("double")).first()["state"] == want
