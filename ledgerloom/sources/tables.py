"""Readers and the adapter views that give the general tables the shape of ledger records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: The order in which sightings of one transaction arrive.
ARRIVAL = ("ts", "receiver", "tag", "amount", "quantity", "discount", "fee", "kind", "result")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers as observed; one transaction may be sighted several times."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("tx_hash"),
        F.col("o_custkey").alias("sender"), F.col("l_suppkey").alias("receiver"), F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.col("l_shipdate").alias("ts"), F.col("l_linestatus").alias("result"), F.col("l_returnflag").alias("kind"),
        F.col("l_orderkey").alias("ledger"), F.col("l_linenumber").alias("tx_index"), F.col("l_partkey").alias("tag"),
        F.col("l_tax").cast(MONEY).alias("fee"), F.col("l_discount").cast(MONEY).alias("discount"), F.col("l_quantity").cast(MONEY).alias("quantity"),
    )


def transfers(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, until: str | None = None) -> DataFrame:
    """One row per transaction: its first sighting.

    An aggregate by the ledger's own keys, so partial rows are merged before the shuffle, and the shuffle of the join with orders, where
    there is one, serves it too. ``columns`` names what is wanted of it; the order of arrival is then followed only as far as these need, and
    nothing else is read. ``until`` is a moment after which no wanted transaction was first seen: later sightings are never first then, and the
    bound reaches the scan.
    """
    s = sightings(spark, sf_dir)
    if until is not None:
        s = s.where(F.col("ts").isNull() | (F.col("ts") <= F.lit(until).cast("timestamp_ntz")))
    keys, wanted = ["ledger", "tx_index", "sender"], columns or s.columns
    order = ARRIVAL[: max([k + 1 for k, c in enumerate(ARRIVAL) if c in wanted], default=1)]
    first = s.groupBy(*keys).agg(F.min(F.struct(*order)).alias("x"))
    own = {c: F.col(c) for c in keys} | {c: F.col(f"x.{c}") for c in order} | {"tx_hash": F.concat_ws("-", F.col("ledger").cast("string"), F.col("tx_index").cast("string"))}
    return first.select(*(own[c].alias(c) for c in s.columns if c in wanted))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("account"), F.col("event_type").alias("type"), F.col("value").cast("decimal(18,4)").alias("value")
    )
