"""The journal of a run that may be resumed: what each wallet is proven through, merged leg by leg.

A leg is (wallet, from, through, rows, reconciliation) at a place in the order of recording. A journal is a table of the same columns, one row per wallet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMNS = ("wallet", "proven_from", "proven_through", "rows", "reconciliation")


def judged(legs: DataFrame, journal: DataFrame | None, anchor: int, order: str) -> DataFrame:
    """Legs with ``refused``: why a leg may not be recorded, null if it may.

    A leg must reach further than all before it, may not pass the anchor, and a wallet proven through the anchor is finished. What a wallet is
    proven through is a running maximum, so one window per wallet judges any number of legs.
    """
    through = F.col("proven_through")
    sound = F.col("wallet").isNotNull() & through.isNotNull() & (through <= anchor)
    w = W.partitionBy("wallet").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = legs
    if journal is None:
        rows = rows.withColumn("_stored", F.lit(None).cast("long"))
    else:
        rows = rows.join(journal.select("wallet", F.col("proven_through").alias("_stored")), "wallet", "left")
    before = F.greatest(F.max(F.when(sound, through)).over(w), F.col("_stored"))
    return rows.withColumn("_before", before).withColumn(
        "refused",
        F.when(F.col("wallet").isNull(), "WALLET_MISSING").when(through.isNull() | (through > anchor), "WRONG_ANCHOR")
        .when(F.col("_before") >= anchor, "ALREADY_RECORDED").when(through <= F.col("_before"), "NOT_ADVANCED"),
    ).drop("_before", "_stored")


def merged(journal: DataFrame | None, legs: DataFrame) -> DataFrame:
    """The journal with accepted legs in it: ranges widen, rows add up, and a contradiction on any leg stays.

    Else the reconciliation is that of the leg that reaches furthest.
    """
    new = legs.select(*COLUMNS, F.lit(1).alias("legs"))
    every = new if journal is None else journal.select(*COLUMNS, "legs").unionByName(new)
    bad = F.bool_or(F.coalesce(F.col("reconciliation") == "CONTRADICTION", F.lit(False)))
    return every.groupBy("wallet").agg(
        F.min("proven_from").alias("proven_from"), F.max("proven_through").alias("proven_through"), F.sum(F.coalesce("rows", F.lit(0))).alias("rows"),
        F.when(bad, "CONTRADICTION").otherwise(F.max_by("reconciliation", "proven_through")).alias("reconciliation"), F.sum("legs").cast("int").alias("legs"),
    )


def stale(anchor_close: Column, now: Column, anchor_ledger: Column, latest: Column, hours: int = 12, ledgers: int = 12_000) -> Column:
    """The anchor is so far behind that the journal has to be anchored anew. An unknown close leaves the ledgers to decide."""
    late = F.coalesce(now - anchor_close > F.expr(f"interval {hours} hours"), F.lit(False))
    return late | F.coalesce(latest - anchor_ledger > ledgers, F.lit(False))


def reanchored(anchor: int, to: int | None) -> int:
    """The new anchor. It may move forward only; wallets proven through the old one are partial progress toward the new."""
    if to is None or to <= anchor:
        raise ValueError("the anchor of a journal moves forward only")
    return to
