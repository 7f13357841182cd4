import json
from datetime import datetime

import pytest
from ledgerloom.operators import events as E
from ledgerloom.operators import journal as J
from ledgerloom.operators import merge as M
from ledgerloom.operators import patterns as P
from ledgerloom.operators import records as R
from ledgerloom.operators import rollups
from pyspark.sql import functions as F


def rows(spark, *entries):
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    df = spark.createDataFrame([(n, text(t), text(m), f"w{n}") for n, (t, m) in enumerate(entries)], "n int, raw_tx string, raw_meta string, seen string")
    return E.event_rows(df, validated=None, observed_via="seen")


def events(spark, *entries):
    return [r.asDict(recursive=True) for r in rows(spark, *entries).orderBy("n").collect()]


ESCROW = {"LedgerEntryType": "Escrow", "FinalFields": {"Account": "rOwner", "Destination": "rTo", "Amount": "500"}}


def test_a_missing_tag_is_not_tag_zero(spark):
    a, b, c = events(spark, ({"DestinationTag": 0, "Sequence": 5}, {}), ({"SourceTag": ""}, {}), ({"Flags": True, "Fee": "-1"}, {}))
    assert (a["destination_tag"], a["source_tag"], a["sequence"]) == (0, None, 5)
    assert b["source_tag"] is None and b["destination_tag"] is None
    assert c["tx_flags"] is None and c["fee_drops"] is None


def test_the_delivered_amount_counts_and_the_claim_is_kept(spark):
    claim, same, unavailable = events(spark, ({"Amount": "100000000000000000"}, {"delivered_amount": "12"}), ({"Amount": "12"}, {"delivered_amount": "12"}), ({"Amount": "9"}, {"delivered_amount": "unavailable"}))
    assert int(claim["amount_drops"]) == 12 and claim["evidence"]["raw_amount_overridden"] == "100000000000000000" and claim["evidence"]["delivered_amount_used"]
    assert same["evidence"]["raw_amount_overridden"] is None and same["evidence"]["delivered_amount_used"]
    assert int(unavailable["amount_drops"]) == 9 and not unavailable["evidence"]["delivered_amount_used"]


def test_issued_amounts(spark):
    a, b = events(spark, ({"Amount": {"currency": "USD", "issuer": "rI", "value": "1.50"}}, {}), ({"Amount": {"value": "3"}}, {}))
    assert (a["currency"], a["issuer"], a["amount_value"], a["amount_drops"]) == ("USD", "rI", "1.50", None)
    assert (b["currency"], b["issuer"]) == ("TOKEN", None)


def test_an_escrow_belongs_to_its_node(spark):
    finish, blind, create, two = events(
        spark, ({"TransactionType": "EscrowFinish", "Account": "rTrigger"}, {"AffectedNodes": [{"ModifiedNode": {"LedgerEntryType": "AccountRoot"}}, {"DeletedNode": ESCROW}]}),
        ({"TransactionType": "EscrowFinish", "Account": "rTrigger"}, {}), ({"TransactionType": "EscrowCreate", "Account": "rMaker"}, {"AffectedNodes": []}),
        ({"TransactionType": "EscrowCancel"}, {"AffectedNodes": [{"CreatedNode": {"LedgerEntryType": "Escrow", "NewFields": {}}}, {"DeletedNode": ESCROW}]}),
    )
    assert (finish["escrow_owner"], finish["escrow_destination"], int(finish["escrow_amount_drops"])) == ("rOwner", "rTo", 500)
    assert blind["escrow_owner"] is None and create["escrow_owner"] == "rMaker"
    assert two["escrow_owner"] == "rOwner" and two["evidence"]["escrow_nodes_seen"] == 2


def test_signatures_and_balances(spark):
    node = {"LedgerEntryType": "AccountRoot", "FinalFields": {"Account": "rA", "Balance": "5"}, "PreviousFields": {"Balance": "17"}}
    still = {"LedgerEntryType": "AccountRoot", "FinalFields": {"Account": "rB", "Balance": "5"}, "PreviousFields": {}}
    multi, single, none = events(
        spark, ({"Signers": [{"Signer": {"Account": "rS1"}}, {"Signer": {}}]}, {"AffectedNodes": [{"ModifiedNode": node}, {"ModifiedNode": still}]}), ({"TxnSignature": "AB", "SigningPubKey": ""}, {}), ({"Signers": []}, {})
    )
    assert (multi["sig_mode"], multi["signer_count"], multi["evidence"]["signer_accounts"]) == ("multisig", 2, ["rS1"])
    assert multi["evidence"]["balance_deltas"] == [{"account": "rA", "prev": "17", "final": "5"}]
    assert (single["sig_mode"], single["signer_count"]) == ("single", 1) and (none["sig_mode"], none["signer_count"]) == ("unknown", 0)


def test_entries_that_are_null_or_no_json(spark):
    for r in events(spark, (None, None), ("", "{"), ("[1]", "nonsense")):
        assert r["hash"] is None and r["close_time_ms"] is None and r["currency"] == "XRP" and r["validated"] is False
        assert r["signer_count"] == 0 and r["evidence"]["signer_accounts"] == [] and r["evidence"]["balance_deltas"] == []
    assert len(E.event_rows(spark.createDataFrame([], "raw_tx string, raw_meta string"), validated=None).columns) == 30


def test_close_time(spark):
    (r,) = events(spark, ({"date": 0, "hash": "H"}, {}))
    assert (r["close_time_ms"], r["close_time_iso"]) == (946684800000, "2000-01-01T00:00:00.000Z")
    r, odd = events(spark, ({"date": 700000000}, {}), ({"date": "9e18"}, {}))
    assert r["close_time_iso"] == "2022-03-07T20:26:40.000Z" and odd["close_time_iso"] is None


def test_participants(spark):
    tx = {"hash": "H", "Account": "rA", "Destination": "rA", "TransactionType": "EscrowFinish", "Signers": [{"Signer": {"Account": "rS"}}, {"Signer": {"Account": "rS"}}]}
    e = rows(spark, (tx, {"AffectedNodes": [{"DeletedNode": ESCROW}]}), (tx, {}), ({"Account": "rX"}, {}))
    got = sorted((r["address"], r["role"]) for r in E.participants(e).collect())
    assert got == sorted([("rA", "submitter"), ("rA", "destination"), ("rOwner", "escrow_owner"), ("rTo", "escrow_destination"), ("rS", "signer"), ("w0", "observed_via"), ("w1", "observed_via")])
    merged = e.where("n = 0").withColumn("observed_via", F.array(F.lit("w0"), F.lit("w9")))
    assert {r["address"] for r in E.participants(merged).where("role = 'observed_via'").collect()} == {"w0", "w9"}


def test_signers_of_all_sightings(spark):
    df = spark.createDataFrame([("h", 1, "a", 1, 2, "x", ["s2"]), ("h", 2, "b", 1, 1, "y", ["s1", "s2"]), ("h", 3, "b", 1, 1, "y", None)], "h string, at int, who string, v int, nodes int, raw string, sig array<string>")
    (r,) = M.merge_sightings(df, "h", ["at"], "who", [], ["v"], "nodes", "raw", ("sig",)).collect()
    assert r["sig"] == ["s1", "s2"] and r["payload"] == "x"


LEG = "wallet string, at int, proven_from long, proven_through long, rows long, reconciliation string"


def test_journal(spark):
    first = spark.createDataFrame([("a", 1, 10, 50, 3, "PROVEN"), ("b", 2, 1, 100, 5, "PROVEN"), ("c", 3, 1, None, 5, "PROVEN"), ("d", 4, 1, 101, 5, "PROVEN"), (None, 5, 1, 9, 5, "PROVEN")], LEG)
    j = J.judged(first, None, 100, "at")
    assert {r["wallet"]: r["refused"] for r in j.collect()} == {"a": None, "b": None, "c": "WRONG_ANCHOR", "d": "WRONG_ANCHOR", None: "WALLET_MISSING"}
    journal = J.merged(None, j.where("refused is null"))
    second = spark.createDataFrame([("a", 1, 5, 50, 9, "PROVEN"), ("a", 2, 5, 70, 2, "CONTRADICTION"), ("a", 3, 51, 60, 9, "PROVEN"), ("a", 4, 71, 100, 4, "PROVEN"), ("a", 5, 1, 99, 9, "PROVEN"), ("b", 6, 1, 100, 5, "PROVEN")], LEG)
    j = J.judged(second, journal, 100, "at")
    assert [r["refused"] for r in j.orderBy("at").collect()] == ["NOT_ADVANCED", None, "NOT_ADVANCED", None, "ALREADY_RECORDED", "ALREADY_RECORDED"]
    got = {r["wallet"]: tuple(r)[1:] for r in J.merged(journal, j.where("refused is null")).collect()}
    assert got == {"a": (5, 100, 9, "CONTRADICTION", 3), "b": (1, 100, 5, "PROVEN", 1)}


def test_stale_journals_are_anchored_anew(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(at, datetime(2024, 1, 1, 12), 1, 12_001), (at, datetime(2024, 1, 1, 12, 1), 1, 2), (at, at, 1, 12_002), (None, at, 1, 2)], "c timestamp_ntz, n timestamp_ntz, a long, l long")
    assert [r[0] for r in df.select(J.stale(F.col("c"), F.col("n"), F.col("a"), F.col("l"))).collect()] == [False, True, True, False]
    assert J.reanchored(5, 6) == 6
    for to in (None, 5, 4):
        with pytest.raises(ValueError):
            J.reanchored(5, to)


PAY = "h string, s string, r string, a long, l long, t timestamp_ntz, via array<string>"


def qualify(spark, *rows):
    known = spark.createDataFrame([("K",)], "node string")
    end = F.lit("2024-01-04").cast("timestamp_ntz")
    df = spark.createDataFrame(list(rows), PAY)
    out = P.qualified(df, known, "s", "r", "h", "a", "l", 10, 100, 50, high=1000, ts="t", end=end, observed_via="via", fingerprint=["s", "r", "a", "l", "t"])
    return [(r["candidate"], r["n"], r["total"]) for r in out.collect()]


def test_qualification(spark):
    first, last, early = datetime(2024, 1, 1), datetime(2024, 1, 4), datetime(2023, 12, 31, 23)
    assert qualify(spark, ("x", "K", "u", 100, 1, first, ["K"]), ("X", "K", "u", 100, 1, first, ["K"])) == [("u", 1, 100)]  # one hash in two cases
    assert qualify(spark, ("x", "K", "u", 100, 1, early, ["K"])) == [] and qualify(spark, ("x", "u", "K", 100, 1, last, ["K"])) == [("u", 1, 100)]
    assert qualify(spark, ("x", "K", "u", 100, 1, first, ["u"])) == [] and qualify(spark, ("x", "K", "u", 1001, 1, first, ["K"])) == []
    assert qualify(spark, ("x", "K", "u", 25, 1, first, ["K"]), ("y", "K", "u", 25, 2, first, ["K"]), ("z", "K", "v", 25, 1, first, ["K"])) == [("u", 2, 50)]
    with pytest.raises(Exception, match="conflicting rows"):
        qualify(spark, ("x", "K", "u", 100, 1, first, ["K"]), ("X", "K", "u", 101, 1, first, ["K"]))


def test_known_receivers_are_not_traced(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", "b", 9, 1, at), ("b", "c", 8, 2, at), ("b", "b", 7, 3, at)], "s string, r string, a long, l long, t timestamp_ntz")
    got = {r["node"]: r["forwards"] for r in P.next_hops(df, "s", "r", "a", "l", "t", 5, spark.createDataFrame([("c",), (None,)], "node string")).collect()}
    assert got == {"b": 1}


def test_daily_wallets(spark):
    df = spark.createDataFrame([("d", "a", "b", 5, "pay"), ("d", "a", "a", 7, "pay"), ("d", "a", "b", 0, "offer"), ("d", "b", "a", 0, "cancel"), ("d", "c", "a", 3, None)], "day string, s string, r string, a long, k string")
    flags = spark.createDataFrame([("d", "a", "a"), ("d", "a", "b"), ("e", "a", None)], "day string, account string, to string")
    k = F.col("k")
    got = {r["account"]: tuple(r)[2:] for r in rollups.daily_wallets(df, flags, "day", "s", "r", "a", k == "pay", k == "offer", k == "cancel").collect()}
    assert got == {"a": (7.0, 12.0, 1, 0, 3, 2), "b": (5.0, 0.0, 0, 1, 1, 1)}


def test_names_and_misses(spark):
    df = spark.createDataFrame([("r" + "p" * 30,), (" Bank ",), ("n" * 61,), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(M.usable_name(F.col("n"))).collect()] == [None, "Bank", None, None, None]
    now = F.lit("2024-01-08").cast("timestamp_ntz")
    misses = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2)), (3, None), (2, datetime(2023, 1, 1))], "k int, t timestamp_ntz")
    assert sorted(r[0] for r in M.lookups_due(spark.range(5).select(F.col("id").cast("int").alias("k")), misses, "k", "t", now).collect()) == [0, 1, 3, 4]


def test_roster_order_and_rejects(spark):
    a = spark.createDataFrame([("r2", "b", None), ("r1", None, "X"), (None, "n", None), ("bad", "m", None)], "k string, name string, cat string")
    good, bad = M.roster([("a", a)], "k", ["name", "cat"], F.col("k").startswith("r"), F.col("cat").isNotNull(), F.coalesce("name", "k"))
    assert [r["k"] for r in good.collect()] == ["r1", "r2"] and {r["k"] for r in bad.collect()} == {None, "bad"}


def test_freshness_of_runs(spark):
    df = spark.createDataFrame([("x", "COMPLETE"), ("x", "RECOVERED"), ("x", "ABANDONED"), ("y", None), ("z", "CONTRADICTION"), ("w", "ODD")], "run string, o string")
    got = {r["run"]: r.asDict() for r in R.run_freshness(df, ["run"], "o").collect()}
    assert got["x"]["advances"] and got["x"]["proven"] == 2 and got["x"]["recovered"] == 1 and got["x"]["abandoned"] == 1
    assert got["y"]["unavailable"] == 1 and got["w"]["unavailable"] == 1 and not (got["y"]["advances"] or got["z"]["advances"])
