"""Collection runs, page walks, ledger scans and archive listings on hand-made rows."""

from ledgerloom.operators import collection as C
from ledgerloom.operators import proof as I
from ledgerloom.sources import shards
from pyspark.sql import functions as F


def run(spark, rows, start, end, **limits):
    df = spark.createDataFrame(rows, "ledger long, problem string, bytes long, requests long, ms long")
    receipts, outcome = C.collected(df, start, end, limits, width=3)
    return [tuple(r) for r in receipts.orderBy("ledger").collect()], tuple(outcome.first())


def whole(*ledgers, **problems):
    return [(i, problems.get(f"l{i}"), 10, 2, 5) for i in ledgers]


def test_run_to_the_end(spark):
    receipts, outcome = run(spark, whole(*range(5, 15)), 5, 14)
    assert [r[0] for r in receipts] == list(range(5, 15))
    assert receipts[-1] == (14, 10, 100, 20, 50)
    assert outcome == (15, 0, None, True)


def test_run_stops(spark):
    assert run(spark, whole(5, 6, 8, 9), 5, 9)[1] == (7, 3, "LEDGER_MISSING", False)
    assert run(spark, whole(6, 7), 5, 9)[1] == (5, 5, "LEDGER_MISSING", False)
    assert run(spark, whole(5, 6), 5, 9)[1] == (7, 3, "LEDGER_MISSING", False)
    assert run(spark, [], 5, 9) == ([], (5, 5, "LEDGER_MISSING", False))
    receipts, outcome = run(spark, whole(*range(5, 10), l8="CHAIN_MISMATCH"), 5, 9)
    assert [r[0] for r in receipts] == [5, 6, 7] and outcome == (8, 2, "CHAIN_MISMATCH", False)


def test_run_budgets(spark):
    rows = whole(*range(1, 11))
    for limits, taken in (({"ledgers": 4}, 4), ({"bytes": 35}, 3), ({"bytes": 30}, 3), ({"requests": 5}, 3), ({"requests": 6}, 3), ({"ms": 1}, 1), ({"ms": 11}, 3)):
        receipts, outcome = run(spark, rows, 1, 10, **limits)
        assert len(receipts) == taken and outcome == (taken + 1, 10 - taken, "RUN_BUDGET_STOP", False), limits
    assert run(spark, rows, 1, 10, object=9)[1] == (1, 10, "OBJECT_SIZE_STOP", False)
    # a run goes on where the last one ended
    assert run(spark, rows, 4, 10, ledgers=100)[1] == (11, 0, None, True)


def test_backward_walk(spark):
    rows = [
        ("boundary", 1, 1, 90, True), ("boundary", 1, 1, 70, True), ("boundary", 1, 2, 50, True), ("boundary", 1, 3, 60, True),
        ("exhausted", 1, 1, 90, True), ("exhausted", 1, 2, None, False),
        ("truncated", 1, 1, 90, True), ("truncated", 1, 2, 85, True), ("truncated", 1, 3, 84, True), ("truncated", 1, 4, 10, True),
        ("running", 1, 1, 90, True),
        ("restarted", 1, 1, 95, True), ("restarted", 2, 1, 40, True),
        ("changing", 5, 1, 40, True),
    ]
    df = spark.createDataFrame(rows, "k string, attempt int, page int, close long, more boolean")
    walks = C.backward_walk(df, ["k"], F.lit(50), 3)
    assert {r["k"]: (r["through_page"], r["state"]) for r in walks.collect()} == {
        "boundary": (2, "BOUNDARY"), "exhausted": (2, "EXHAUSTED"), "truncated": (3, "TRUNCATED"), "running": (1, "RUNNING"), "restarted": (1, "BOUNDARY"), "changing": (1, "UNPROVEN"),
    }
    kept = C.walked_rows(df, walks, ["k"], F.lit(50), F.lit(90))
    assert sorted((r["k"], r["close"]) for r in kept.collect()) == [("boundary", 50), ("boundary", 70), ("boundary", 90), ("exhausted", 90), ("running", 90), ("truncated", 84), ("truncated", 85), ("truncated", 90)]


def test_ledger_scan_reasons(spark):
    expanded = [(1, "a", "z", "h1"), (2, "b", "a", "h2"), (3, None, "b", "h3"), (4, "d", "c", "h4"), (5, "e", "x", "h5"), (6, "f", "e", "h6"), (7, "g", "f", "h7"), (8, "h", "g", "h8"), (9, "i", "h", "h9"), (10, "j", "i", "h")]
    listed = [(1, "a", "h1"), (2, "b", "other"), (3, "c", "h3"), (4, "d", "h4"), (5, "e", "h5"), (6, "f", "h6"), (7, "g", "h7"), (8, "h", "h8"), (9, "i", "h9")]
    txs = [(1, "aa", 0), (1, "BB", 1), (4, "x", 0), (6, "p", 0), (7, "q", 0), (7, "r", 2), (8, "s", 0), (8, "S", 1)]
    hashes = [(1, "AA"), (1, "bb"), (4, "x"), (6, "p"), (6, "more"), (7, "q"), (7, "r"), (8, "s")]
    make = spark.createDataFrame
    got = C.ledger_scan(make(expanded, "ledger long, hash string, parent string, header string"), make(listed, "ledger long, hash string, header string"), make(txs, "ledger long, tx_hash string, index long"), make(hashes, "ledger long, tx_hash string"))
    assert {r["ledger"]: r["problem"] for r in got.collect()} == {
        1: None, 2: "HEADER_MISMATCH", 3: "LEDGER_UNPROVEN", 4: "CHAIN_MISMATCH", 5: "CHAIN_MISMATCH", 6: "TRANSACTION_SET_MISMATCH", 7: "TRANSACTION_INDEX_GAP", 8: "TRANSACTION_SET_MISMATCH", 9: None, 10: "LEDGER_UNPROVEN",
    }


def test_escrow_position(spark):
    objects = [("a", "a", 1, 10), ("a", "a", 1, 10), ("a", "b", 2, 99), ("b", "b", 3, None), ("c", "c", 4, 5)]
    o = spark.createDataFrame(objects, "asked string, owner string, key long, amount long")
    asked = spark.createDataFrame([("a", True), ("b", True), ("c", None)], "address string, answered boolean")
    r = C.escrow_position(o, asked).first()
    assert (float(r["locked"]), r["objects"], r["owners"], r["other_assets"], r["asked"], r["answered"], r["complete"]) == (15.0, 2, 2, 1, 3, 2, False)
    assert C.escrow_position(o, asked.where("answered")).first()["complete"]
    empty = C.escrow_position(o.limit(0), asked).first()
    assert (float(empty["locked"]), empty["objects"]) == (0.0, 0)


def test_widened(spark):
    names = ("from", "through", "from_close", "through_close")
    schema = "id int, " + ", ".join(f"s_{n} long" for n in (*names, "kept_from", "kept_through", "kept_from_close")) + ", " + ", ".join(f"p_{n} long" for n in names)
    rows = [
        (1, 100, 200, 1, 2, 150, 200, 3, 201, 300, 8, 9),  # touches at the end
        (2, 100, 200, 1, 2, 150, 200, 3, 202, 300, 8, 9),  # one ledger between
        (3, 100, 200, 1, 2, 150, 200, 3, 50, 149, 8, 9),  # touches at the beginning
        (4, None, None, None, None, None, None, None, 5, 6, 8, 9),
        (5, 100, 200, 1, 2, None, None, None, 120, 180, 8, 9),  # pruned before
    ]
    c = F.col
    x = I.widened({n: c(f"s_{n}") for n in (*names, "kept_from", "kept_through", "kept_from_close")}, {n: c(f"p_{n}") for n in names})
    got = {r["id"]: tuple(r["x"]) for r in spark.createDataFrame(rows, schema).select("id", x.alias("x")).collect()}
    assert got == {
        1: (100, 300, 1, 9, 150, 300, 3), 2: (100, 300, 1, 9, 202, 300, 8), 3: (50, 200, 8, 2, 50, 200, 8), 4: (5, 6, 8, 9, 5, 6, 8), 5: (100, 200, 1, 2, 120, 180, 8),
    }


def test_archive_problems(spark):
    files = [("1/e", "1", "events", 5, 5), ("1/p", "1", "payloads", 7, 7), ("2/e", "2", "events", 4, 3), ("3/e", "3", "events", 2, 2)]
    f = spark.createDataFrame(files, "file string, day string, kind string, rows long, found long")
    totals = spark.createDataFrame([("events", 11), ("payloads", 7), ("participants", 1)], "kind string, rows long")
    live = spark.createDataFrame([("1", 5), ("2", 3), ("4", 6)], "day string, n long")
    got = sorted(tuple(r) for r in shards.archive_problems(f, totals, live).fillna("-", ["day"]).collect())
    assert got == [("-", "TOTALS_DIFFER", 1), ("1", "PAYLOADS_EXCEED_EVENTS", 2), ("2", "DATABASE_DIFFERS", 1), ("2", "ROW_COUNT", 1), ("3", "DATABASE_DIFFERS", 2), ("4", "DATABASE_DIFFERS", 6)]


def test_manifest_digest(spark):
    m = spark.createDataFrame([("a", 1), ("b", None)], "file string, bytes long")
    d = lambda df: tuple(shards.manifest_digest(df).first())
    assert d(m) == d(m.orderBy(F.col("file").desc()).repartition(2))
    assert d(m) != d(m.fillna(0)) and d(m) != d(m.limit(1)) and d(m)[0] == 2


def test_book_problem(spark):
    rows = [("a", 5, None, 2), ("a", 5, True, 200), ("a", 5, False, 2), ("b", 5, True, 2), ("a", 6, True, 2), ("a", 5, True, 201), (None, 5, True, 2), ("a", None, True, 2), ("a", 5, True, None)]
    df = spark.createDataFrame(rows, "hash string, at long, validated boolean, offers long")
    got = [r[0] for r in df.select(C.book_problem(F.col("hash"), F.col("at"), F.col("validated"), F.col("offers"), F.lit("a"), F.lit(5))).collect()]
    assert got == [None, None, *["UNPROVEN_BOOK"] * 7]
