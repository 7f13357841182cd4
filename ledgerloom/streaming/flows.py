"""Structured Streaming: classification, alerts, daily and sliding totals, deduplication, exactly-once receipts.

Every function takes a streaming (or batch) DataFrame and returns one; ``run_available`` drives a query over what is
there and stops, which is how scheduled micro-batches run.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import size_band


def stream_table(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream; the number of files a batch is the rate limit."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def classified(rows: DataFrame, amount: str) -> DataFrame:
    return rows.withColumn("band", size_band(F.col(amount)))


def alerts(rows: DataFrame, ok: Column, amount: str, watched: Column, issued: Column, least: float = 100_000) -> DataFrame:
    """Successful transfers of native money that are large or touch a watched account."""
    return rows.where(ok & ((F.col(amount) >= least) | watched) & ~issued)


def daily(rows: DataFrame, ts: str, amount: str, late: str = "2 days") -> DataFrame:
    """Totals by day of the event, with rows up to ``late`` behind still counted."""
    w = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return w.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total")).select(F.to_date("w.start").alias("day"), "n", "total")


def sliding(rows: DataFrame, ts: str, entity: str, late: str = "2 hours", length: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    w = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return w.groupBy(F.window(ts, length, step).alias("w"), entity).agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("w.start").alias("start"), entity, "n")


def deduplicated(rows: DataFrame, key: str, ts: str, within: str = "30 days") -> DataFrame:
    """The first row of a key within the watermark; older keys are forgotten."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def lookback_hours(day: Column) -> Column:
    """36 hours, 96 around a weekend (Saturday to Monday, UTC). Spark's Sunday is 1."""
    return F.when(F.dayofweek(day).isin(7, 1, 2), 96).otherwise(36)


def freshness(age_seconds: Column, most: int) -> Column:
    return F.when(age_seconds.isNull(), "UNKNOWN").when(age_seconds > most, "STALE").otherwise("FRESH")


def gaps(ledgers: DataFrame, ledger: str) -> DataFrame:
    """Missing ranges between the ledgers that are there: reported as missing, never as zero."""
    from pyspark.sql import Window as W

    # ranges of a fixed width keep the windows small; only their ends meet in one short window
    parts = ledgers.select(ledger, F.floor(F.col(ledger) / 100_000).alias("_p")).distinct()
    inner = parts.withColumn("_next", F.lead(ledger).over(W.partitionBy("_p").orderBy(ledger)))
    ends = parts.groupBy("_p").agg(F.min(ledger).alias("lo"), F.max(ledger).alias("hi"))
    outer = ends.withColumn("_next", F.lead("lo").over(W.orderBy("_p"))).select(F.col("hi").alias(ledger), "_next")
    both = inner.select(ledger, "_next").unionByName(outer).where(F.col("_next") > F.col(ledger) + 1)
    return both.select((F.col(ledger) + 1).alias("missing_from"), (F.col("_next") - 1).alias("missing_to"))


def paced(gap: int, streak: int, ok: bool, least: int = 250, most: int = 2000, floor: int = 1000, ease: float = 0.7, streak_to_ease: int = 5) -> tuple[int, int]:
    """The gap in milliseconds and the streak after one outcome: doubled on a refusal, and then at least ``floor``; eased after a streak."""
    if not ok:
        return min(most, max(floor, gap * 2)), 0
    if streak + 1 < streak_to_ease:
        return gap, streak + 1
    return max(least, math.floor(gap * ease)), 0


def admission_clock(outcomes: list[bool], least: int = 250) -> list[int]:
    """The gap before each next request, in milliseconds."""
    gap, streak, out = least, 0, []
    for ok in outcomes:
        gap, streak = paced(gap, streak, bool(ok), least)
        out.append(gap)
    return out


def admission_gaps(rows: DataFrame, key: str, order: list[str], ok: str) -> DataFrame:
    """The clock of each endpoint as a stream: its gap after every batch, with requests and refusals so far.

    State is four numbers a key. A batch's outcomes of a key are put in order in one task; batches count in the order in which they come, so the
    number of files a batch bounds what a task holds. A null outcome is a refusal.
    """
    schema = f"{key} long, gap_ms long, requests long, refusals long"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        gap, streak, requests, refusals = state.get if state.exists else (250, 0, 0, 0)
        for good in pd.concat(list(batches)).sort_values(order)["_ok"]:
            gap, streak = paced(gap, streak, bool(good))
            requests, refusals = requests + 1, refusals + (not good)
        state.update((gap, streak, requests, refusals))
        yield pd.DataFrame({key: [k[0]], "gap_ms": [gap], "requests": [requests], "refusals": [refusals]})

    keyed = rows.select(F.col(key).cast("long").alias(key), *order, F.coalesce(F.col(ok), F.lit(False)).alias("_ok"))
    return keyed.groupBy(key).applyInPandasWithState(update, schema, "gap long, streak long, requests long, refusals long", "update", "NoTimeout")


def running_counts(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Custom state per key: rows seen and the latest time, across batches."""
    schema = f"{key} long, seen long, latest long"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, latest = state.get if state.exists else (0, -1)
        for pdf in batches:
            seen += len(pdf)
            latest = max(latest, int(pdf["_t"].max()))
        state.update((seen, latest))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "latest": [latest]})

    keyed = rows.select(F.col(key).cast("long").alias(key), F.unix_timestamp(F.col(ts).cast("timestamp")).alias("_t"))
    return keyed.groupBy(key).applyInPandasWithState(update, schema, "seen long, latest long", "update", "NoTimeout")


def run_available(rows: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there, batch by batch, and stop; the checkpoint makes a rerun go on where this ended."""
    q = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
    q.awaitTermination()


def receipts(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A sink in which a batch that comes again writes what it wrote before: each batch has its own folder."""

    def write(df: DataFrame, batch: int) -> None:
        df.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
