import pytest
from ledgerloom.operators import evidence as E
from pyspark.sql import functions as F

STATE = "chain string, version long, previous string, own string, anchor long, wallet_count long"
WALLET = "chain string, version long, address string, proven long, horizon long, admitted long, balance string, balance_ledger long"
SHARD = [("days/1", "a" * 64)]


def sealed(spark, states, wallets):
    """``states`` with own as recomputed, and previous as the own of the version before."""
    w = spark.createDataFrame(wallets, WALLET)
    out, last = [], {}
    for chain, version, anchor, count in sorted(states):
        row = (chain, version, last.get(chain), None, anchor, count)
        own = E.with_digest(spark.createDataFrame([row], STATE), w).first()["digest"]
        last[chain] = own
        out.append((*row[:3], own, *row[4:]))
    return spark.createDataFrame(out, STATE), w


def wallet(address="a", proven=100, horizon=10, admitted=None, balance="5", balance_ledger=100):
    return address, proven, horizon, admitted, balance, balance_ledger


#: What a good run looks like, with what each refusal changes about it: (run fields, wallets of the run, state).
GOOD = {"anchor": 200, "target": 2, "complete": 2, "contradictions": 0, "shards": SHARD}
WALLETS = [(False, wallet(proven=200)), (False, wallet("b", proven=150))]
CASES = {
    None: ({}, WALLETS),
    "STATE_MISSING": ({}, WALLETS),
    "STATE_DIGEST_MISMATCH": ({}, WALLETS),
    "RUN_ANCHOR_MISSING": ({"anchor": None}, WALLETS),
    "RUN_ANCHOR_NOT_AHEAD": ({"anchor": 100}, WALLETS),
    "RUN_TARGET_UNKNOWN": ({"target": 0}, WALLETS),
    "RUN_INCOMPLETE": ({"complete": 1}, WALLETS),
    "RUN_CONTRADICTED": ({"contradictions": 1}, WALLETS),
    "RUN_SHARDS_MISSING": ({"shards": None}, WALLETS),
    "RUN_SHARD_UNHASHED": ({"shards": [*SHARD, ("days/2", "xyz")]}, WALLETS),
    "RUN_WALLET_COUNT_MISMATCH": ({}, WALLETS[:1]),
    "RUN_WALLET_ADDRESS_MISSING": ({}, [WALLETS[0], (False, wallet(None))]),
    "RUN_WALLET_NOT_IN_STATE": ({}, [WALLETS[0], (False, wallet("new"))]),
    "ADMISSION_NOT_AT_ANCHOR": ({}, [WALLETS[0], (True, wallet("new", 200, 50, 199))]),
    "ADMISSION_HORIZON_UNKNOWN": ({}, [WALLETS[0], (True, wallet("new", 200, None, 200))]),
    "ADMISSION_HORIZON_PAST_ANCHOR": ({}, [WALLETS[0], (True, wallet("new", 200, 201, 200))]),
    "ADMISSION_CHECKPOINT_UNEARNED": ({}, [WALLETS[0], (True, wallet("new", 199, 50, 200))]),
    "WALLET_ALREADY_IN_STATE": ({}, [WALLETS[0], (True, wallet("b", 150))]),
    "ADMISSION_LEDGER_REWRITTEN": ({}, [WALLETS[0], (False, wallet("b", 150, admitted=7))]),
    "HISTORY_HORIZON_REWRITTEN": ({}, [WALLETS[0], (False, wallet("b", 150, horizon=11))]),
    "RUN_WALLET_UNPROVEN": ({}, [WALLETS[0], (False, wallet("b", None))]),
    "CHECKPOINT_WOULD_MOVE_BACKWARDS": ({}, [WALLETS[0], (False, wallet("b", 99))]),
    "CHECKPOINT_PAST_ANCHOR": ({}, [WALLETS[0], (False, wallet("b", 201))]),
    "BALANCE_NOT_PINNED": ({}, [WALLETS[0], (False, wallet("b", 150, balance_ledger=None))]),
    "WALLET_DROPPED_FROM_STATE": ({}, [WALLETS[0], (True, wallet("new", 200, 50, 200))]),
}


def test_each_refusal(spark):
    assert set(CASES) - {None} == {*E.RUN_REFUSALS, *E.WALLET_REFUSALS, E.DROPPED} and len(CASES) == 25
    before = [(str(c), 1, *wallet(a)) for c in CASES for a in ("a", "b") if c != "STATE_MISSING"]
    states, wallets = sealed(spark, [(str(c), 1, 100, 2) for c in CASES if c != "STATE_MISSING"], before)
    states = states.withColumn("own", F.when(F.col("chain") == "STATE_DIGEST_MISMATCH", "0" * 64).otherwise(F.col("own")))
    run = [(str(c), *({**GOOD, **x}[k] for k in GOOD)) for c, (x, _) in CASES.items()]
    runs = spark.createDataFrame(run, "chain string, anchor long, target long, complete long, contradictions long, shards array<struct<path:string,sha256:string>>")
    found = [(str(c), k, ad, *w) for c, (_, ws) in CASES.items() for k, (ad, w) in enumerate(ws)]
    found = spark.createDataFrame(found, "chain string, position long, admitting boolean, address string, proven long, horizon long, admitted long, balance string, balance_ledger long")
    got = {r["chain"]: r for r in E.advanced(states, wallets, runs, found).collect()}
    for c in CASES:
        assert got[str(c)]["reason"] == c, c
    assert (got["None"]["advances"], got["None"]["next_version"], got["None"]["next_anchor"]) == (True, 2, 200)
    assert got["CHECKPOINT_PAST_ANCHOR"]["address"] == "b" and got["RUN_INCOMPLETE"]["address"] is None


CHAIN = [("c", 1, 100, 1), ("c", 2, 200, 1), ("c", 3, 300, 1)]


@pytest.mark.parametrize(
    "change, want",
    [
        (lambda s, w: (s, w), set()),
        (lambda s, w: (s, w.withColumn("balance", F.when(F.col("version") == 2, "6").otherwise(F.col("balance")))), {(2, "DIGEST_MISMATCH"), (3, "PREVIOUS_DIGEST_MISMATCH")}),
        (lambda s, w: (s.where("version <> 2"), w), {(3, "CHAIN_BROKEN"), (3, "VERSION_NOT_SEQUENTIAL")}),
        (lambda s, w: (s.withColumn("wallet_count", F.when(F.col("version") == 3, 2).otherwise(F.col("wallet_count"))), w), {(3, "WALLET_COUNT_MISMATCH"), (3, "DIGEST_MISMATCH")}),
    ],
)
def test_chains(spark, change, want):
    states, wallets = change(*sealed(spark, CHAIN, [("c", v, *wallet(proven=100 * v)) for v in (1, 2, 3)]))
    assert {(r["version"], r["problem"]) for r in E.chain_problems(states, wallets).collect()} == want


def test_wallets_of_a_chain(spark):
    rows = [("c", 1, *wallet(proven=100)), ("c", 2, *wallet(proven=90, horizon=11)), ("c", 3, *wallet(proven=300, horizon=11, admitted=5))]
    got = {(r["version"], r["problem"], r["address"]) for r in E.chain_problems(*sealed(spark, CHAIN, rows)).collect()}
    assert got == {(2, "CHECKPOINT_MOVED_BACKWARDS", "a"), (2, "HISTORY_HORIZON_CHANGED", "a"), (3, "ADMISSION_LEDGER_CHANGED", "a")}


def test_blocks(spark):
    ledgers = spark.createDataFrame([(1, "h1", None), (2, "h2", "h1"), (3, "h3", "hx"), (5, "h5", "h4"), (6, None, "h5")], "l long, own string, parent string")
    txs = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (3, 0), (5, 0), (5, 2)], "l long, i long")
    got = {(r["ledger"], r["problem"]) for r in E.block_problems(ledgers, txs, "l", "own", "parent", "i").collect()}
    assert got == {(2, "INDEX_NOT_CONTIGUOUS"), (3, "PARENT_HASH_MISMATCH"), (3, "INDEX_NOT_CONTIGUOUS"), (5, "INDEX_NOT_CONTIGUOUS"), (6, "HASH_MISSING")}
