"""Pattern detection over transfers and activity. Columns are parameters; thresholds have the usual defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def repeated(rows: DataFrame, keys: list[str], at_least: int, where: Column | None = None) -> DataFrame:
    """Groups of at least so many rows; ``where`` says which rows count."""
    rows = rows if where is None else rows.where(where)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def upper_median(values: Column) -> Column:
    """The middle of an array, the upper one of two."""
    return F.element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1)


def regular_intervals(rows: DataFrame, keys: list[str], order: list[Column], ts: str, at_least: int = 6, least_gap: float = 10, slack: float = 2, tolerance: float = 0.02) -> DataFrame:
    """Routes whose gaps all lie within ``slack`` seconds or ``tolerance`` of their upper median.

    All lie near if the least and the largest do, so no route's gaps are collected: the median is an aggregate over counts of equal gaps.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    gaps = rows.withColumn("_gap", F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w)))
    upper = F.expr("percentile_disc(0.5) within group (order by _gap desc)").cast("long")  # of two in the middle the larger
    found = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_gap").alias("_lo"), F.max("_gap").alias("_hi"), upper.alias("mid")).where((F.col("n") >= at_least) & (F.col("mid") >= least_gap))
    near = lambda g: F.abs(F.col(g) - F.col("mid")) <= F.greatest(F.lit(slack), F.col("mid") * tolerance)
    return found.where(near("_lo") & near("_hi")).select(*keys, F.col("mid").alias("interval_seconds"), "n")


def mid_band(rows: DataFrame, amount: str, low: float, high: float) -> DataFrame:
    return rows.where((F.col(amount) >= low) & (F.col(amount) < high))


def flow_groups(rows: DataFrame, sender: str, receiver: str, amount: str, at_least: int = 3, total: float = 1_000_000) -> dict[str, DataFrame]:
    """Repeated routes, fan-out and fan-in: groups of enough transfers and total, fans with two counterparties or more."""

    # rows are read once, into one row a pair; all three follow from these
    pairs = rows.groupBy(sender, receiver).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))

    def enough(g: DataFrame) -> DataFrame:
        return g.where((F.col("n") >= at_least) & (F.col("total") >= total))

    def fan(own: str, others: str) -> DataFrame:
        return enough(pairs.groupBy(own).agg(F.sum("n").alias("n"), F.sum("total").cast(pairs.schema["total"].dataType).alias("total"), F.count(others).alias("others"))).where("others >= 2")

    return {"route": enough(pairs), "fan_out": fan(sender, receiver), "fan_in": fan(receiver, sender)}


def clustered(rows: DataFrame, key: str, sender: str, receiver: str, amount: str, at_least: int = 3, total: float = 1_000_000) -> DataFrame:
    """The transfers of any qualifying group, each once."""
    g = flow_groups(rows, sender, receiver, amount, at_least, total)
    tagged = (
        rows.join(g["route"].select(sender, receiver, F.lit(True).alias("_r")), [sender, receiver], "left")
        .join(g["fan_out"].select(sender, F.lit(True).alias("_o")), sender, "left")
        .join(g["fan_in"].select(receiver, F.lit(True).alias("_i")), receiver, "left")
    )
    return tagged.where("_r or _o or _i").drop("_r", "_o", "_i").dropDuplicates([key])


def burst_share(rows: DataFrame, entity: str, ts: str, seconds: int = 3600, at_least: int = 4) -> DataFrame:
    """Largest share of an entity's events inside any window of so many seconds, both ends included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(entity).orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    n = rows.select(entity, at.alias("_us")).withColumn("_in", F.count(F.lit(1)).over(w))
    return n.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.max("_in").alias("most")).select(
        entity, "n", F.when(F.col("n") < at_least, F.lit(0.0)).otherwise(F.col("most") / F.col("n")).alias("burst")
    )


def concentration(rows: DataFrame, entity: str, other: str) -> DataFrame:
    """Share of the commonest counterparty among all rows of an entity, rows without a counterparty included."""
    per = rows.groupBy(entity, other).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(entity).agg(F.sum("_n").alias("n"), F.coalesce(F.max(F.when(F.col(other).isNotNull(), F.col("_n"))), F.lit(0)).alias("_top")).select(
        entity, "n", (F.col("_top") / F.col("n")).alias("concentration")
    )


def reciprocal(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pairs with their reverse in the sample; a pair of one with itself needs to occur twice."""
    counted = pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    back = counted.select(*keys, F.col(a).alias(b), F.col(b).alias(a), F.lit(True).alias("_back")).where(F.col(a) != F.col(b))
    met = counted.join(back, [*keys, a, b], "left")
    return met.select(*keys, a, b, "n", F.coalesce(F.col("_back"), (F.col(a) == F.col(b)) & (F.col("n") >= 2), F.lit(False)).alias("reciprocal"))


def co_occurrence(rows: DataFrame, snapshot: str, member: str, snapshots: int = 30, at_least: int = 2) -> DataFrame:
    """Pairs of members met in several of the latest snapshots. Our own definition of coordination.

    Members per snapshot must be few (an alert list); the join is on the snapshot.
    """
    days = rows.select(snapshot).distinct().orderBy(F.col(snapshot).desc()).limit(snapshots)
    seen = rows.select(snapshot, member).distinct().join(F.broadcast(days), snapshot, "left_semi")
    pairs = seen.alias("a").join(seen.alias("b"), (F.col(f"a.{snapshot}") == F.col(f"b.{snapshot}")) & (F.col(f"a.{member}") < F.col(f"b.{member}")))
    return pairs.groupBy(F.col(f"a.{member}").alias("a"), F.col(f"b.{member}").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def largest_receipt(rows: DataFrame, receiver: str, amount: str, ledger: str, ts: str) -> DataFrame:
    """Each receiver's largest receipt, the earliest ledger on a tie: an aggregate rather than a window."""
    best = F.max(F.struct(F.col(amount).alias("amount"), (-F.col(ledger)).alias("_l"), F.col(ts).alias("ts"))).alias("x")
    return rows.groupBy(receiver).agg(best).select(F.col(receiver).alias("node"), F.col("x.amount").alias("received"), (-F.col("x._l")).alias("at_ledger"), F.col("x.ts").alias("at_ts"))


def next_hops(rows: DataFrame, sender: str, receiver: str, amount: str, ledger: str, ts: str, large: float = 1_000_000, known: DataFrame | None = None, receipt: Column | None = None, payment: Column | None = None) -> DataFrame:
    """What receivers send on after their largest receipt, and whether a large part of it moves.

    Receivers in ``known`` (a column node) are not traced. ``receipt`` says which rows count as received, ``payment`` which as sent on; what
    one sends to itself is not sent on.
    """
    got = rows if receipt is None else rows.where(receipt)
    if known is not None:
        k = known.select(F.col("node").alias("_known")).distinct()
        got = got.join(k, F.col(receiver) == F.col("_known"), "left_anti")
    src = largest_receipt(got, receiver, amount, ledger, ts)
    sent = (rows if payment is None else rows.where(payment)).where(~F.col(sender).eqNullSafe(F.col(receiver)))
    out = src.join(sent, (F.col("node") == F.col(sender)) & (F.col(ledger) > F.col("at_ledger")) & (F.col(ts) >= F.col("at_ts")), "left")
    return out.groupBy("node", "received", "at_ledger").agg(
        F.count(F.col(sender)).alias("forwards"), F.count_if(F.col(amount) >= large).alias("large_forwards"), F.sum(amount).alias("forwarded")
    ).withColumn("status", F.when(F.col("large_forwards") > 0, "NEXT_HOP_FORWARDING_DETECTED").otherwise("UNPROVEN")).withColumn(
        "confidence", F.when(F.col("large_forwards") > 0, "HIGH").otherwise("LOW")
    )


def qualified(rows: DataFrame, known: DataFrame, sender: str, receiver: str, key: str, amount: str, ledger: str, low: float, one: float, two: float, most: int | None = 5, high: float | None = None,
              ts: str | None = None, end: Column | None = None, hours: int = 72, observed_via: str | None = None, fingerprint: list[str] | None = None) -> DataFrame:
    """Unknown counterparties of known ones that earn a place: one very large transfer, or two of a large total.

    Exactly one end of a transfer must be known (``known`` has a column node). With ``ts`` and ``end``, transfers count within so many hours up to
    the end, both ends included. With ``observed_via``, an array, the known end must be among those that saw the transfer. With ``fingerprint``,
    rows of one key (in any case) are one transfer, and keys whose rows differ in these columns end the query with an error.
    """
    k = known.select("node").distinct()
    r = rows.where(F.col(amount) >= low)
    if high is not None:
        r = r.where(F.col(amount) <= high)
    if ts is not None:
        r = r.where((F.col(ts) >= end - F.expr(f"interval {hours} hours")) & (F.col(ts) <= end))
    if fingerprint is not None:
        own = [c for c in r.columns if c != key]
        one_row = r.groupBy(F.upper(key).alias(key)).agg(F.min(F.struct(*fingerprint)).alias("_a"), F.max(F.struct(*fingerprint)).alias("_b"), F.min(F.struct(*own)).alias("_x"))
        clash = F.raise_error(F.concat(F.lit("conflicting rows of "), F.col(key)))
        r = one_row.select(key, F.when(F.col("_a") == F.col("_b"), F.col("_x")).otherwise(clash).alias("_x")).select(key, "_x.*")
    r = r.join(k.select(F.col("node").alias("_a")), F.col(sender) == F.col("_a"), "left").join(k.select(F.col("node").alias("_b")), F.col(receiver) == F.col("_b"), "left")
    r = r.where(F.col("_a").isNull() != F.col("_b").isNull()).withColumn("candidate", F.when(F.col("_a").isNull(), F.col(sender)).otherwise(F.col(receiver)))
    if observed_via is not None:
        r = r.where(F.array_contains(observed_via, F.coalesce("_a", "_b")))
    g = r.groupBy("candidate").agg(F.countDistinct(key).alias("n"), F.countDistinct(ledger).alias("ledgers"), F.sum(amount).alias("total"), F.max(amount).alias("largest"))
    g = g.where((F.col("largest") >= one) | ((F.col("n") >= 2) & (F.col("ledgers") >= 2) & (F.col("total") >= two)))
    g = g.orderBy(F.col("total").desc(), "candidate")
    return g if most is None else g.limit(most)
