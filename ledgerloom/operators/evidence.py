"""Checkpoint states: when a state may advance, and whether a chain of states holds.

A state is a row: chain, version, previous (the digest of the state before it), own (its recorded digest), anchor,
wallet_count. Its wallets are rows: chain, version, address, proven, horizon, admitted, balance, balance_ledger. A digest is the sha256
of a canonical text, here of the fields in a fixed order and of the wallets' digest, itself a sum over wallets, so no
chain's wallets have to meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WALLET = ("address", "proven", "horizon", "admitted", "balance", "balance_ledger")
#: Refusals of an advance, in the order in which they are looked for: of the run, then of each of its wallets.
RUN_REFUSALS = (
    "STATE_MISSING", "STATE_DIGEST_MISMATCH", "RUN_ANCHOR_MISSING", "RUN_ANCHOR_NOT_AHEAD", "RUN_TARGET_UNKNOWN", "RUN_INCOMPLETE", "RUN_CONTRADICTED",
    "RUN_SHARDS_MISSING", "RUN_SHARD_UNHASHED", "RUN_WALLET_COUNT_MISMATCH",
)
WALLET_REFUSALS = (
    "RUN_WALLET_ADDRESS_MISSING", "RUN_WALLET_NOT_IN_STATE", "ADMISSION_NOT_AT_ANCHOR", "ADMISSION_HORIZON_UNKNOWN", "ADMISSION_HORIZON_PAST_ANCHOR", "ADMISSION_CHECKPOINT_UNEARNED",
    "WALLET_ALREADY_IN_STATE", "ADMISSION_LEDGER_REWRITTEN", "HISTORY_HORIZON_REWRITTEN", "RUN_WALLET_UNPROVEN", "CHECKPOINT_WOULD_MOVE_BACKWARDS", "CHECKPOINT_PAST_ANCHOR", "BALANCE_NOT_PINNED",
)
DROPPED = "WALLET_DROPPED_FROM_STATE"


def _line(fields: list[Column]) -> Column:
    """A text in which null differs from any value."""
    return F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in fields))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def wallet_digests(wallets: DataFrame) -> DataFrame:
    """chain, version, n and wallets_digest: a digest that does not depend on the order of wallets."""
    h = F.conv(F.substring(_digest(_line([F.col(c) for c in WALLET])), 1, 15), 16, 10).cast("decimal(38,0)")
    return wallets.groupBy("chain", "version").agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("wallets_digest"))


def with_digest(states: DataFrame, wallets: DataFrame) -> DataFrame:
    """``states`` with n, the wallets there are, and digest, the digest recomputed from its fields."""
    s = states.join(wallet_digests(wallets), ["chain", "version"], "left")
    fields = [F.col(c) for c in ("chain", "version", "previous", "anchor", "wallet_count", "wallets_digest")]
    return s.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("digest", _digest(_line(fields))).drop("wallets_digest")


def chain_problems(states: DataFrame, wallets: DataFrame) -> DataFrame:
    """chain, version, problem, address: what is wrong with each state and with its step from the one before; no row, no problem.

    Windows hold one short row a state of a chain; wallets meet the same wallet of the state before by a join.
    """
    line = W.partitionBy("chain").orderBy("version")
    s = with_digest(states, wallets)
    for c in ("version", "own", "digest"):
        s = s.withColumn(f"_{c}", F.lag(c).over(line))
    after = F.col("_version").isNotNull()
    found = F.array_compact(F.array(
        F.when(~F.col("digest").eqNullSafe(F.col("own")), "DIGEST_MISMATCH"), F.when(~F.col("n").eqNullSafe(F.col("wallet_count")), "WALLET_COUNT_MISMATCH"),
        F.when(after & ~F.col("_digest").eqNullSafe(F.col("_own")), "PREVIOUS_DIGEST_MISMATCH"), F.when(after & ~F.col("previous").eqNullSafe(F.col("_own")), "CHAIN_BROKEN"),
        F.when(after & (F.col("version") != F.col("_version") + 1), "VERSION_NOT_SEQUENTIAL"),
    ))
    heads = s.select("chain", "version", F.explode(found).alias("problem"), F.lit(None).cast(wallets.schema["address"].dataType).alias("address"))
    steps = s.where(after).select("chain", "version", "_version")
    now = wallets.join(steps, ["chain", "version"])
    was = wallets.select("chain", F.col("version").alias("_version"), "address", *(F.col(c).alias(f"_{c}") for c in ("proven", "horizon", "admitted")))
    j = now.join(was, ["chain", "_version", "address"])
    found = F.array_compact(F.array(
        F.when(F.col("_proven").isNotNull() & (F.coalesce("proven", F.lit(0)) < F.col("_proven")), "CHECKPOINT_MOVED_BACKWARDS"),
        F.when(F.col("_horizon").isNotNull() & ~F.col("horizon").eqNullSafe(F.col("_horizon")), "HISTORY_HORIZON_CHANGED"),
        F.when(~F.col("admitted").eqNullSafe(F.col("_admitted")), "ADMISSION_LEDGER_CHANGED"),
    ))
    return heads.union(j.select("chain", "version", F.explode(found).alias("problem"), "address"))


def advanced(states: DataFrame, wallets: DataFrame, runs: DataFrame, found: DataFrame) -> DataFrame:
    """One row per run: chain, advances, reason (the first refusal; null if the state advances), address, next_version and next_anchor.

    ``states`` has the latest state of each chain and ``wallets`` its wallets. ``runs`` has chain, anchor, target, complete,
    contradictions and shards (array of struct<path, sha256>); ``found`` the wallets the run proved: chain, position, admitting and the
    columns of WALLET. A state advances as a whole or not at all.
    """
    latest = with_digest(states, wallets).select("chain", "version", F.col("own"), "digest", F.col("anchor").alias("_anchor"))
    counted = found.groupBy("chain").agg(F.count(F.lit(1)).alias("_found"))
    r = runs.join(latest, "chain", "left").join(counted, "chain", "left")
    valid = lambda c: F.when(F.col(c) > 0, F.col(c))
    unhashed = F.exists("shards", lambda x: x.isNull() | (F.coalesce(x["path"], F.lit("")) == "") | ~F.coalesce(x["sha256"].rlike("^[a-f0-9]{64}$"), F.lit(False)))
    refused = [
        F.col("own").isNull(), F.col("digest") != F.col("own"), valid("anchor").isNull(), valid("anchor") <= valid("_anchor"), valid("target").isNull(), ~F.col("complete").eqNullSafe(F.col("target")),
        F.coalesce("contradictions", F.lit(0)) > 0, F.col("shards").isNull(), unhashed, F.coalesce("_found", F.lit(0)) != F.col("target"),
    ]
    heads = r.select("chain", "version", "anchor", F.coalesce(*(F.when(c, F.lit(n)) for c, n in zip(refused, RUN_REFUSALS, strict=True))).alias("head"))
    was = wallets.select("chain", "address", F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in ("proven", "horizon", "admitted")))
    n = found.join(was, ["chain", "address"], "left").join(runs.select("chain", F.col("anchor").alias("_at")), "chain")
    new, known, admitting = F.col("_there").isNull(), F.col("_there").isNotNull(), F.coalesce("admitting", F.lit(False))
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    refused = [
        F.coalesce(F.col("address").cast("string"), F.lit("")) == "", new & ~admitting, new & differs("admitted", "_at"), new & F.col("horizon").isNull(), new & (F.col("horizon") > F.col("_at")), new & differs("proven", "_at"),
        known & admitting, known & differs("admitted", "_admitted"), known & F.col("_horizon").isNotNull() & differs("horizon", "_horizon"), F.col("proven").isNull(),
        F.col("proven") < F.col("_proven"), F.col("proven") > F.col("_at"), F.col("balance").isNull() != F.col("balance_ledger").isNull(),
    ]
    n = n.select("chain", "position", "address", F.coalesce(*(F.when(c, F.lit(k)) for c, k in zip(refused, WALLET_REFUSALS, strict=True))).alias("reason"))
    worst = n.where("reason is not null").groupBy("chain").agg(F.min(F.struct("position", "reason", "address")).alias("x")).select("chain", F.col("x.reason").alias("_wallet"), F.col("x.address").alias("_who"))
    gone = wallets.join(found.select("chain", "address"), ["chain", "address"], "left_anti").groupBy("chain").agg(F.min("address").alias("_gone"))
    j = heads.join(worst, "chain", "left").join(gone, "chain", "left")
    dropped = F.when(F.col("_gone").isNotNull(), DROPPED)
    reason = F.coalesce("head", "_wallet", dropped)
    who = F.when(F.col("head").isNotNull(), None).when(F.col("_wallet").isNotNull(), F.col("_who")).otherwise(F.col("_gone"))
    return j.select(
        "chain", reason.isNull().alias("advances"), reason.alias("reason"), who.alias("address"), F.when(reason.isNull(), F.col("version") + 1).alias("next_version"),
        F.when(reason.isNull(), F.col("anchor")).alias("next_anchor"),
    )


def block_problems(ledgers: DataFrame, transactions: DataFrame, ledger: str, own: str, parent: str, index: str) -> DataFrame:
    """ledger and problem: a parent hash that is not the hash of the ledger before (where that one is there), transaction
    indexes that do not run from 0 without a gap, and ledgers without a hash. No window: the ledger before is met by its number."""
    before = ledgers.select((F.col(ledger) + 1).alias(ledger), F.col(own).alias("_before"), F.lit(True).alias("_there"))
    g = transactions.groupBy(ledger).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(index).alias("_u"), F.min(index).alias("_lo"), F.max(index).alias("_hi"))
    j = ledgers.join(before, ledger, "left").join(g, ledger, "left")
    whole = (F.col("_lo") == 0) & (F.col("_hi") == F.col("_n") - 1) & (F.col("_u") == F.col("_n"))
    found = F.array_compact(F.array(
        F.when(F.col(own).isNull(), "HASH_MISSING"), F.when(F.col("_there") & ~F.col(parent).eqNullSafe(F.col("_before")), "PARENT_HASH_MISMATCH"), F.when(F.col("_n").isNotNull() & ~F.coalesce(whole, F.lit(False)), "INDEX_NOT_CONTIGUOUS"),
    ))
    return j.select(F.col(ledger).alias("ledger"), F.explode(found).alias("problem"))
