"""Collection of ledgers and account pages: what was read whole, where reading stopped, and why.

Ledgers are numbers, so the one before is met by its number and running totals are taken within ranges of a fixed width; only
the ranges' sums meet in one short window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What a scanned ledger is refused for, in the order in which it is looked for.
SCAN_REFUSALS = ("LEDGER_UNPROVEN", "HEADER_MISMATCH", "CHAIN_MISMATCH", "TRANSACTION_SET_MISMATCH", "TRANSACTION_INDEX_GAP")


def ledger_scan(expanded: DataFrame, listed: DataFrame, transactions: DataFrame, hashes: DataFrame) -> DataFrame:
    """ledger, txs, problem: whole ledgers, read once expanded and once as a list of hashes, checked against one another.

    ``expanded`` has ledger, hash, parent, header (any comparable value), ``listed`` has ledger, hash, header; ``transactions`` has ledger, tx_hash,
    index and ``hashes`` has ledger, tx_hash. Both readings must have the hash and header, the parent must be the hash of the ledger before where
    that was read, both must name the same transactions in any case, each once, and indexes must run from 0 without a gap. The
    first refusal is the problem, null if there is none; a ledger without transactions is whole.
    """
    two = transactions.select("ledger", F.upper("tx_hash").alias("_h"), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    two = two.unionByName(hashes.select("ledger", F.upper("tx_hash").alias("_h"), F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    met = two.groupBy("ledger", "_h").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    once = (F.col("_a") == 1) & (F.col("_b") == 1) & F.col("_h").isNotNull()
    sets = met.groupBy("ledger").agg(F.sum("_a").alias("txs"), F.bool_and(F.coalesce(once, F.lit(False))).alias("_same"))
    at = transactions.groupBy("ledger").agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("index").alias("_u"), F.min("index").alias("_lo"), F.max("index").alias("_hi"))
    before = expanded.select((F.col("ledger") + 1).alias("ledger"), F.col("hash").alias("_before"), F.lit(True).alias("_there"))
    second = listed.select("ledger", F.col("hash").alias("_hash"), F.col("header").alias("_header"))
    j = expanded.join(second, "ledger", "left").join(before, "ledger", "left").join(sets, "ledger", "left").join(at, "ledger", "left")
    whole = F.col("_n").isNull() | ((F.col("_lo") == 0) & (F.col("_hi") == F.col("_n") - 1) & (F.col("_u") == F.col("_n")))
    refused = (
        F.col("hash").isNull() | F.col("_hash").isNull(), ~F.col("header").eqNullSafe(F.col("_header")),
        (F.col("hash") != F.col("_hash")) | (F.coalesce("_there", F.lit(False)) & ~F.col("parent").eqNullSafe(F.col("_before"))),
        ~F.coalesce("_same", F.lit(True)), ~F.coalesce(whole, F.lit(False)),
    )
    problem = F.coalesce(*(F.when(c, k) for c, k in zip(refused, SCAN_REFUSALS, strict=True)))
    return j.select("ledger", F.coalesce("txs", F.lit(0)).alias("txs"), problem.alias("problem"))


def collected(ledgers: DataFrame, start: int, end: int, limits: dict[str, int], width: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Receipts and one row of outcome of a run over the ledgers from start to end, in order and never over a gap.

    ``ledgers`` has one row a ledger: ledger, problem (null if whole), bytes, requests, ms. ``limits`` may name ledgers, object (bytes of one
    ledger), bytes, requests and ms. Reading stops before the first ledger that is missing, has a problem or an object too large, or with which
    the run's ledgers or bytes would pass their limit; and before one at which requests or time are used up. Receipts carry the totals up
    to their ledger, so each is a checkpoint: a run goes on at the outcome's ``next``. The outcome has next, remaining, reason (null at the end of the
    interval) and complete.
    """
    sums = ("n", "bytes", "requests", "ms")
    rows = ledgers.where(F.col("ledger").between(start, end)).select("ledger", "problem", F.lit(1).cast("long").alias("n"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in sums[1:]))
    rows = rows.withColumn("_p", F.floor(F.col("ledger") / width))
    earlier = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("_p").agg(*(F.sum(c).alias(c) for c in sums))
    parts = parts.select("_p", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))  # one row a range
    within = W.partitionBy("_p").orderBy("ledger").rowsBetween(W.unboundedPreceding, 0)
    run = rows.join(parts, "_p").select("ledger", "problem", *(F.col(c).alias(f"_own_{c}") for c in sums), *((F.sum(c).over(within) + F.col(f"_{c}")).alias(c) for c in sums))

    def spent(name: str, used: Column, passes: bool) -> Column:
        most = limits.get(name)
        if most is None:
            return F.lit(False)
        return used > most if passes else used >= most

    budget = spent("ledgers", F.col("n"), True) | spent("bytes", F.col("bytes"), True) | spent("requests", F.col("requests") - F.col("_own_requests"), False) | spent("ms", F.col("ms") - F.col("_own_ms"), False)
    stop = (
        F.when(F.col("ledger") != start + F.col("n") - 1, "LEDGER_MISSING").when(F.col("problem").isNotNull(), F.col("problem"))
        .when(spent("object", F.col("_own_bytes"), True), "OBJECT_SIZE_STOP").when(budget, "RUN_BUDGET_STOP")
    )
    run = run.withColumn("_stop", stop)
    first = run.agg(F.min(F.when(F.col("_stop").isNotNull(), F.struct("ledger", (F.col("n") - 1).alias("n"), F.col("_stop").alias("reason")))).alias("_x"), F.max("n").alias("_n"))  # one row
    receipts = run.crossJoin(F.broadcast(first.select(F.col("_x.ledger").alias("_at")))).where("_at is null or ledger < _at").select("ledger", *sums)
    after = start + F.coalesce("_x.n", "_n", F.lit(0))
    outcome = first.select(after.alias("next"), (end - after + 1).alias("remaining"), F.when(after <= end, F.coalesce("_x.reason", F.lit("LEDGER_MISSING"))).alias("reason"), (after > end).alias("complete"))
    return receipts, outcome


def backward_walk(rows: DataFrame, keys: list[str], start: Column, ceiling: int, restarts: int = 3) -> DataFrame:
    """Per key how far its newest-first pages reach: attempt, through_page and state.

    ``rows`` has the keys, attempt, page (from 1), close and more (whether the page had a marker); a page without rows has one of null close. A change of
    transport begins a new attempt, and only the last one counts: more than ``restarts`` new ones are UNPROVEN. The walk ends at the first page that reaches
    back to the start (BOUNDARY) or has no marker (EXHAUSTED), else at the ceiling (TRUNCATED), else it is RUNNING.
    """
    pages = rows.where(F.col("page") <= ceiling).groupBy(*keys, "attempt", "page").agg(F.min("close").alias("_oldest"), F.bool_or(F.coalesce("more", F.lit(False))).alias("_more"))
    reached = F.coalesce(F.col("_oldest") <= start, F.lit(False))
    ends = pages.groupBy(*keys, "attempt").agg(F.min(F.when(reached | ~F.col("_more"), F.struct("page", (~reached).alias("_exhausted")))).alias("_end"), F.max("page").alias("_last"))
    last = ends.groupBy(*keys).agg(F.max(F.struct("attempt", "_end", "_last")).alias("_x")).select(*keys, "_x.*")
    state = (
        F.when(F.col("attempt") > restarts + 1, "UNPROVEN").when(F.col("_end").isNotNull(), F.when(F.col("_end._exhausted"), "EXHAUSTED").otherwise("BOUNDARY"))
        .when(F.col("_last") >= ceiling, "TRUNCATED").otherwise("RUNNING")
    )
    return last.select(*keys, "attempt", F.coalesce("_end.page", "_last").alias("through_page"), state.alias("state"))


def walked_rows(rows: DataFrame, walks: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """The rows that a walk keeps: of its last attempt, of pages up to its end, within the closed window."""
    return rows.join(walks.select(*keys, "attempt", "through_page"), [*keys, "attempt"]).where((F.col("page") <= F.col("through_page")) & F.col("close").between(start, end)).drop("through_page")


def escrow_position(objects: DataFrame, asked: DataFrame) -> DataFrame:
    """One row: what is locked now, in how many objects of how many owners, and whether everyone asked has answered.

    ``objects`` has asked (the address whose objects these are said to be), owner, key and amount (null for another asset); one that its asker does not own, or
    is only the destination of, does not count, and an object seen twice counts once, with its least owner and amount. ``asked`` has address and answered.
    """
    own = objects.where(F.col("owner") == F.col("asked")).groupBy("key").agg(F.min(F.struct("owner", F.col("amount").isNull().alias("_none"), "amount")).alias("_x")).select("_x.*")
    native = F.col("amount").isNotNull()
    said = F.coalesce("answered", F.lit(False))
    a = asked.groupBy("address").agg(F.bool_and(said).alias("_ok")).agg(F.count(F.lit(1)).alias("asked"), F.count_if("_ok").alias("answered"))
    p = own.agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("locked"), F.count_if(native).alias("objects"), F.countDistinct(F.when(native, F.col("owner"))).alias("owners"), F.count_if(~native).alias("other_assets"),
    )
    return p.crossJoin(a).withColumn("complete", F.col("answered") == F.col("asked"))  # one row each


def book_problem(hash: Column, index: Column, validated: Column, offers: Column, ledger_hash: Column, ledger: Column, limit: int = 200) -> Column:
    """UNPROVEN_BOOK unless a side of an order book belongs to the ledger validated apart, by hash and number, and has no more offers than were asked for.

    An answer may leave out whether it is validated, but not deny it; a missing hash, number or count of offers proves nothing.
    """
    proven = (hash == ledger_hash) & (index == ledger) & (offers <= limit) & F.coalesce(validated, F.lit(True))
    return F.when(~F.coalesce(proven, F.lit(False)), "UNPROVEN_BOOK")
