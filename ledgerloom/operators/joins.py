"""Join shapes: membership, as-of, newest-wins, dimension look-ups and set equality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .running import running_max

#: A dimension is broadcast only where its rows are counted and below this.
SMALL_ROWS = 100_000


def dimension(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small; the count stops one row beyond the bound."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_payload(events: DataFrame, payloads: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Events with their payloads, null where missing; and payloads without an event, which are an error."""
    return events.join(payloads, key, "left"), payloads.join(events.select(key), key, "left_anti")


def members_differ(rows: DataFrame, known: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """Rows of which exactly one end is known; adds known_a and known_b."""
    k = known.select(F.col(node).alias("_k")).distinct()
    r = rows.join(k.withColumnRenamed("_k", "_a"), F.col(a) == F.col("_a"), "left").join(k.withColumnRenamed("_k", "_b"), F.col(b) == F.col("_b"), "left")
    r = r.withColumn("known_a", F.col("_a").isNotNull()).withColumn("known_b", F.col("_b").isNotNull()).drop("_a", "_b")
    return r.where(F.col("known_a") != F.col("known_b"))


def as_of(states: DataFrame, key: str, at: str, moment: Column, fields: list[str]) -> DataFrame:
    """Each key's latest state at or before a moment, by an aggregate."""
    newest = F.max_by(F.struct(at, *fields), F.col(at)).alias("_x")
    return states.where(F.col(at) <= moment).groupBy(key).agg(newest).select(key, *(F.col(f"_x.{f}").alias(f) for f in (at, *fields)))


def as_of_each(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, fields: list[str], piece: Callable[[Column], Column] | None = None) -> DataFrame:
    """For every left row the latest right row of its key at or before it; of several at one time that of the largest fields.

    Both sides are laid in one line per key and the last right row is carried forward, so the cost is one sort
    of both instead of a join on the key with all pairs in between. ``piece`` makes of a time the piece of the line it belongs to, such as
    its day, so that a key of any size is sorted in pieces.
    """
    own = [c for c in left.columns if c != key]
    a = left.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*own).alias("_row"), F.lit(None).cast(right.select(F.struct(right_at, *fields).alias("x")).schema["x"].dataType).alias("_r"))
    b = right.select(key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(right_at, *fields).alias("_r"))
    seen = F.when(F.col("_side") == 0, F.struct("_at", "_r"))
    line = running_max(a.unionByName(b), [key], ["_at", "_side"], seen, "_last", None if piece is None else piece(F.col("_at"))).where("_side = 1")
    return line.select(key, *(F.col(f"_row.{c}").alias(c) for c in own), *(F.col(f"_last._r.{f}").alias(f) for f in (right_at, *fields)))


def newest_per(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key."""
    own = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(version), F.struct(*own).alias("_row"))).alias("_x"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_x._row.{c}").alias(c) for c in rows.columns))


def adjacent_increase(samples: DataFrame, sample: str, at: str, keys: list[str], size: str, most_gap: int = 1800) -> DataFrame:
    """Growth of a quote between adjacent samples at most so many seconds apart; nothing is said across a gap.

    The samples' order comes from the distinct samples, one row each.
    """
    order = W.orderBy(at)
    steps = samples.select(sample, at).distinct().withColumn("_prev", F.lag(sample).over(order)).withColumn("_gap", F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(order)))
    steps = steps.where((F.col("_gap") > 0) & (F.col("_gap") <= most_gap)).select(sample, "_prev")
    now = samples.groupBy(sample, *keys).agg(F.sum(size).alias("_now"))
    then = now.select(F.col(sample).alias("_prev"), *keys, F.col("_now").alias("_then"))
    j = now.join(steps, sample).join(then, ["_prev", *keys])
    return j.withColumn("increase", F.col("_now") - F.col("_then")).where("increase > 0").select(sample, *keys, "increase")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, with the side; empty if the two are equal as bags."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
