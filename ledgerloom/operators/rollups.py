"""Totals per wallet, day, status, cohort and cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def total(value: Column | str, where: Column | None = None) -> Column:
    """An exact sum as double, 0 where there is nothing."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(v if where is None else F.when(where, v)), F.lit(0)).cast("double")


def exchange_totals(rows: DataFrame, account: str, asset: str, sells: Column, amount: str, quantity: str) -> DataFrame:
    return rows.groupBy(account, asset).agg(
        total(amount, sells).alias("sell"), total(amount, ~sells).alias("buy"), total(quantity, sells).alias("received"),
        total(quantity, ~sells).alias("spent"), F.count(F.lit(1)).alias("legs"),
    )


def two_sided(rows: DataFrame, sender: str, receiver: str, amount: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sent and received per account; every transfer is credited on both sides, one to itself on both of its own."""
    zero = F.lit(0).cast(rows.schema[amount].dataType)
    out = rows.select(*keys, F.col(sender).alias("account"), F.col(amount).alias("sent"), zero.alias("received"))
    into = rows.select(*keys, F.col(receiver).alias("account"), zero.alias("sent"), F.col(amount).alias("received"))
    return out.union(into).groupBy(*keys, "account").agg(total("sent").alias("sent"), total("received").alias("received"), F.count(F.lit(1)).alias("legs"))


def daily_wallets(rows: DataFrame, flags: DataFrame, day: str, sender: str, receiver: str, amount: str, moved: Column, offer: Column, cancelled: Column) -> DataFrame:
    """Per day and wallet: received and sent, offers made, cancels confirmed, legs and flags.

    A moved transfer is a leg on both sides; offers and cancels are the sender's. ``flags`` has day, account and ``to`` (may be null): a flag
    counts once for either of its wallets. Wallets with flags only have no row.
    """
    zero, yes = F.lit(0).cast(rows.schema[amount].dataType), lambda c: F.coalesce(c, F.lit(False))
    m, o, x = yes(moved), yes(offer), yes(cancelled)
    side = lambda who, s, r, legs, offers, cancels: F.struct(F.col(who).alias("account"), s.alias("sent"), r.alias("received"), legs.cast("int").alias("legs"), offers.cast("int").alias("offers"), cancels.cast("int").alias("cancels"))
    no = F.lit(False)
    out = F.when(m | o | x, side(sender, F.when(m, F.col(amount)).otherwise(zero), zero, m, o, x))
    into = F.when(m, side(receiver, zero, F.col(amount), m, no, no))
    g = rows.select(F.col(day).alias("day"), F.inline(F.array_compact(F.array(out, into)))).groupBy("day", "account").agg(
        total("received").alias("received"), total("sent").alias("sent"), F.sum("offers").alias("offers"), F.sum("cancels").alias("cancels"), F.sum("legs").alias("legs"),
    )
    marked = flags.select("day", F.explode(F.array_distinct(F.array("account", "to"))).alias("account")).where("account is not null")
    n = marked.groupBy("day", "account").agg(F.count(F.lit(1)).alias("flags"))
    return g.join(n, ["day", "account"], "left").withColumn("flags", F.coalesce("flags", F.lit(0)))


def sealable(rows: DataFrame, keys: list[str], status: str, covers_start: Column) -> DataFrame:
    """Counts of wallets by proof status, and whether all of them are complete over the whole window.

    A missing status is a failure; an unknown one is counted apart; COMPLETE without a proven start is not complete.
    """
    s = F.coalesce(F.col(status), F.lit("FAILED"))
    covered = F.coalesce(covers_start, F.lit(False))
    n = lambda c: F.count_if(c)
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("target_wallets"), n((s == "COMPLETE") & covered).alias("complete_wallets"), n(s == "FAILED").alias("failed_wallets"),
        n(s == "TRUNCATED").alias("truncated_wallets"), n(s == "UNPROVEN").alias("unproven_wallets"),
        n((s == "COMPLETE") & ~covered).alias("unproven_start_wallets"), n(~s.isin("COMPLETE", "FAILED", "TRUNCATED", "UNPROVEN")).alias("unknown_status_wallets"),
    )
    return g.withColumn("full_window_complete", (F.col("target_wallets") > 0) & (F.col("complete_wallets") == F.col("target_wallets")))


def coverage(roster: DataFrame, checked: DataFrame, key: str, status: str, anchor_ok: Column) -> DataFrame:
    """Coverage of a roster: wallets never checked count as unproven, and nothing is complete without an anchor."""
    j = roster.select(key).join(checked.select(key, status), key, "left")
    c = F.coalesce(F.col(status), F.lit("UNPROVEN"))
    g = j.agg(F.count(F.lit(1)).alias("target"), F.count_if(c == "COMPLETE").alias("proven"), F.count_if(c == "FAILED").alias("failed"), F.count_if(~c.isin("COMPLETE", "FAILED")).alias("unproven"))
    return g.withColumn("complete", anchor_ok & (F.col("target") > 0) & (F.col("proven") == F.col("target")))


def failures(rows: DataFrame, cause: str, address: str, attempts: str) -> DataFrame:
    """Failures by cause; addresses are listed up to the roster's size."""
    return rows.groupBy(cause).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(address)).alias("addresses"), F.max(attempts).alias("attempts"))


def family_shares(rows: DataFrame, family: str) -> DataFrame:
    counts = rows.groupBy(family).agg(F.count(F.lit(1)).alias("n"))
    whole = rows.agg(F.count(F.lit(1)).alias("_all"))
    return counts.crossJoin(F.broadcast(whole)).select(family, "n", F.round(F.col("n") * 100.0 / F.col("_all"), 1).alias("pct"))  # one row


def adapter_health(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Whether an aggregator's day is plausible against its own trailing mean (7 days, else 30)."""
    mean = F.coalesce(F.col("total7d") / 7, F.col("total30d") / 30)
    ratio = F.when(mean > 0, F.col("total24h") / mean)
    return rows.select(
        *keys, mean.alias("trailing_mean"), ratio.alias("ratio"), (F.col("silent") > 0).alias("partial"),
        (F.coalesce(F.col("total24h"), F.lit(0)) > 0).alias("reported"), F.coalesce(ratio >= 0.20, F.lit(False)).alias("plausible"),
    )


def volume_decision(rows: DataFrame, ledger: str, aggregator: str, plausible: str) -> DataFrame:
    """The ledger's own sum first, the aggregator's only if it is plausible; a disagreement of over 5x is noted."""
    has = F.col(ledger) > 0
    value = F.when(has, F.col(ledger)).when(F.col(plausible) & (F.col(aggregator) > 0), F.col(aggregator))
    low, high = F.least(ledger, aggregator), F.greatest(ledger, aggregator)
    return rows.withColumn("volume", value).withColumn(
        "source", F.when(has, "LEDGER").when(F.col("volume").isNotNull(), "AGGREGATOR").otherwise("UNAVAILABLE")
    ).withColumn("disagree", F.coalesce(F.when(low > 0, high / low > 5), F.lit(False)))


def retention(day: Column, cutoff: Column, proof: Column, flagged: Column) -> Column:
    return F.when(proof, "KEEP_PROOF").when(day >= cutoff, "KEEP_RECENT").when(flagged, "KEEP_FLAGGED").otherwise("ARCHIVE_CANDIDATE")


def leaders(rows: DataFrame, keys: list[str], order: list[Column], label: str, most: int) -> DataFrame:
    """The keys and ``leaders``, the labels of each group's first rows in the order, as text. Rows beyond the limit go before the shuffle, so a group may be of any size."""
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most)
    listed = F.array_sort(F.collect_list(F.struct("_n", F.col(label).cast("string").alias("_v"))))
    return first.groupBy(*keys).agg(F.transform(listed, lambda x: x["_v"]).alias("leaders"))


def elevated(amount: str, large: float, most_large: int, most_total: float, both: bool = False) -> Column:
    """Aggregate: so many large amounts, or so much in all; with ``both`` either alone is not enough."""
    many, much = F.count_if(F.col(amount) >= large) >= most_large, F.sum(amount) >= most_total
    return (many & much) if both else (many | much)
