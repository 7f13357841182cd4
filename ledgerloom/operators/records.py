"""Records about runs, reports, identities, budgets: picks, merges and status rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def import_plan(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Reports by id: identical copies collapse, different contents under one id are variants."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.countDistinct(content).alias("variants"), F.min(content).alias("content"))
    return g.withColumn("state", F.when(F.col("variants") > 1, "VARIANTS").when(F.col("copies") > 1, "IDENTICAL_COPIES").otherwise("SINGLE"))


def pick(rows: DataFrame, usable: Column, by: list[str]) -> DataFrame:
    """The one usable row that is last in the order."""
    return rows.where(usable).agg(F.max(F.struct(*by, F.struct(*rows.columns).alias("_row"))).alias("x")).where("x is not null").select("x._row.*")


def balance_store(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two stores of (peak, peak_at, last, last_at, n): the higher peak (the later of equals), the newest last, the larger n."""
    both = a.unionByName(b)
    return both.groupBy(key).agg(F.max(F.struct("peak", "peak_at")).alias("p"), F.max(F.struct("last_at", "last")).alias("l"), F.max("n").alias("n")).select(key, "p.peak", "p.peak_at", "l.last", "l.last_at", "n")


def first_per_day(rows: DataFrame, day: Column, complete: Column, order: list[str], keep: int) -> DataFrame:
    """One archive row a day, the first complete one; the newest ``keep`` days stay."""
    own = rows.columns
    g = rows.where(complete).groupBy(day.alias("day")).agg(F.min(F.struct(*order, F.struct(*own).alias("_row"))).alias("x"))
    return g.orderBy(F.col("day").desc()).limit(keep).select("day", "x._row.*")


def on_this_day(rows: DataFrame, day: str, today: str) -> DataFrame:
    return rows.where((F.date_format(day, "MM-dd") == F.lit(today[5:])) & (F.date_format(day, "yyyy") != F.lit(today[:4])))


def merged_reports(local: DataFrame, remote: DataFrame, key: str, version: str, match: list[str]) -> DataFrame:
    """Remote rows by id, the last version winning, and the local rows that match none of them."""
    own = remote.columns
    last = remote.groupBy(key).agg(F.max(F.struct(version, F.struct(*own).alias("_row"))).alias("x")).select("x._row.*")
    return last.unionByName(local.join(last.select(*match), match, "left_anti").select(*own))


def wallet_history(rows: DataFrame, sender: str, receiver: str, amount: str, ts: str, key: str, most: int = 25) -> DataFrame:
    """Each account's latest transfers with a sign, summed: what came in and what went out."""
    legs = rows.select(F.explode(F.array(
        F.struct(F.col(sender).alias("account"), (-F.col(amount)).alias("signed"), F.col(ts).alias("at"), F.col(key).alias("tx")), F.struct(F.col(receiver).alias("account"), F.col(amount).alias("signed"), F.col(ts).alias("at"), F.col(key).alias("tx")),
    )).alias("l")).select("l.*")
    w = W.partitionBy("account").orderBy(F.col("at").desc(), "tx", "signed")
    last = legs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    s = lambda c: F.coalesce(F.sum(F.when(c, F.abs("signed"))), F.lit(0)).cast("double")
    return last.groupBy("account").agg(F.count(F.lit(1)).alias("n"), s(F.col("signed") > 0).alias("came_in"), s(F.col("signed") < 0).alias("went_out"))


def expansion(rows: DataFrame, centers: DataFrame, sender: str, receiver: str, ts: str, key: str, most: int = 10) -> DataFrame:
    """Edges from each center to the counterparties of its latest transfers."""
    both = rows.select(F.col(sender).alias("center"), F.col(receiver).alias("other"), ts, key).union(rows.select(F.col(receiver), F.col(sender), ts, key))
    near = both.join(centers.select("center"), "center", "left_semi")
    w = W.partitionBy("center").orderBy(F.col(ts).desc(), key, "other")
    return near.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= most) & (F.col("other") != F.col("center"))).select("center", "other").distinct()


def budget(reserved: DataFrame, settled: DataFrame, key: str) -> DataFrame:
    """What counts against a budget: the settled amount, else the reserved one; more settled than reserved is a breach."""
    s = settled.groupBy(key).agg(F.sum("settled").alias("settled"))
    j = reserved.join(s, key, "left")
    return j.withColumn("counts", F.coalesce("settled", "reserved")).withColumn("breach", F.coalesce(F.col("settled") > F.col("reserved"), F.lit(False)))


def next_slot(now: Column) -> Column:
    """The next even UTC hour, as epoch seconds."""
    return (F.floor(now / 7200) + 1) * 7200


def overdue(slot: Column, now: Column, hour: int = 3600) -> Column:
    """The hour that starts with the slot is over."""
    return F.coalesce(now >= slot + hour, F.lit(False))


def run_freshness(wallets: DataFrame, keys: list[str], outcome: str) -> DataFrame:
    """Counts of a run's wallets by what became of them, and whether its checkpoint may advance: only without a failure or contradiction.

    Outcomes: COMPLETE, RECOVERED, FAILED, CONTRADICTION, ADMITTED, AWAITING, NOT_ATTEMPTED and ABANDONED; recovered and admitted wallets are proven as well. A
    missing or unknown outcome is a failure.
    """
    o = F.col(outcome)
    n = lambda *names: F.count_if(F.coalesce(o.isin(*names), F.lit(False)))
    failed = F.count_if(~F.coalesce(o.isin("COMPLETE", "RECOVERED", "CONTRADICTION", "ADMITTED", "AWAITING", "NOT_ATTEMPTED", "ABANDONED"), F.lit(False)))
    bad = n("CONTRADICTION")
    return wallets.groupBy(*keys).agg(
        n("COMPLETE", "RECOVERED", "ADMITTED").alias("proven"), n("RECOVERED").alias("recovered"), failed.alias("unavailable"), bad.alias("contradicted"),
        n("ADMITTED").alias("admitted"), n("AWAITING").alias("awaiting"), n("NOT_ATTEMPTED").alias("not_attempted"), n("ABANDONED").alias("abandoned"),
        ((failed == 0) & (bad == 0)).alias("advances"),
    )


def window_proven(original: Column, floor: Column, baseline: Column) -> Column:
    return F.coalesce(original, F.lit(False)) | F.coalesce(floor <= baseline, F.lit(False))


def coverage_text(total: Column, proven: Column) -> Column:
    return F.when(total.isNull() | (total == 0), "NOT MEASURED").when(proven == total, "COMPLETE").otherwise("INCOMPLETE")


def walk_state(boundary: Column, exhausted: Column, pages: Column, ceiling: int) -> Column:
    return F.when(boundary, "BOUNDARY").when(exhausted, "EXHAUSTED").when(pages >= ceiling, "TRUNCATED").otherwise("RUNNING")


def outcomes(done: DataFrame, recovered: DataFrame, key: str, status: str) -> DataFrame:
    """Wallets by outcome; a recovered one counts as such whatever its run said."""
    r = recovered.select(key).distinct().withColumn("_r", F.lit(True))
    j = done.join(r, key, "left").select(F.when(F.col("_r"), "RECOVERED").otherwise(F.coalesce(F.col(status), F.lit("NOT_ATTEMPTED"))).alias("outcome"))
    return j.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def archive_write(stored: DataFrame, fresh: DataFrame, key: str, content: str) -> DataFrame:
    """What an archive does with fresh reports: ALREADY_ARCHIVED, CONFLICT or WRITE."""
    s = stored.groupBy(key).agg(F.max(content).alias("_c"))
    state = F.when(F.col("_c").isNull(), "WRITE").when(F.col("_c") == F.col(content), "ALREADY_ARCHIVED").otherwise("CONFLICT")
    return fresh.join(s, key, "left").select(key, state.alias("action"))


def contract_rows(candidates: DataFrame, section: str, weight: str, headline: str) -> DataFrame:
    """The row of the largest narrative weight of each section, ties to the first headline."""
    top = F.min(F.struct((-F.col(weight)).alias("_w"), F.col(headline).alias("_h"))).alias("x")
    return candidates.groupBy(section).agg(top).select(section, F.col("x._h").alias(headline), (-F.col("x._w")).alias(weight))


def archive_facts(wallets: DataFrame, keys: list[str], proved: Column, committed: Column) -> DataFrame:
    """What an archive may state of a run: its target, the proved ones and the rows these committed; what was not measured is null, not zero."""
    return wallets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("target"), F.count_if(proved).alias("proved"), F.sum(F.when(proved, committed)).alias("rows_committed"), F.lit(None).cast("long").alias("unmeasured")
    )


def staged_payload(rows: DataFrame, key: str, richness: str, order: list[str], payload: str) -> DataFrame:
    """The payload of each key's richest row, the first of several in the order. Nothing known of its richness comes last."""
    best = F.min(F.struct(F.col(richness).isNull().alias("_none"), (-F.col(richness)).alias("_rich"), F.struct(*order).alias("_at"), F.col(payload).alias("_payload"))).alias("x")
    return rows.groupBy(key).agg(best).select(key, F.col("x._payload").alias("payload"))
