"""Interval and proof algebra. Missing is never zero: every test on a missing number is a refusal, not a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_max

#: The earliest ledger that any server still has; fixed value.
EARLIEST = 32570


def parse_ranges(expr: Column) -> Column:
    """``"a-b,c,d-e"`` as sorted merged closed ranges array<struct<lo,hi>>; null if malformed, empty if 'empty' or blank.

    Touching ranges merge.
    """
    raw = F.trim(expr)
    parts = F.transform(F.split(raw, ",", -1), lambda x: F.trim(x))
    whole = F.forall(parts, lambda x: x.rlike(r"^[0-9]{1,18}(-[0-9]{1,18})?$"))
    pairs = F.transform(parts, lambda x: F.struct(
        F.regexp_extract(x, r"^([0-9]+)", 1).try_cast("long").alias("lo"),
        F.coalesce(F.nullif(F.regexp_extract(x, r"-([0-9]+)$", 1), F.lit("")), F.regexp_extract(x, r"^([0-9]+)", 1)).try_cast("long").alias("hi"),
    ))
    ordered = F.forall(pairs, lambda p: p["hi"] >= p["lo"])
    none = F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], p["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (p["lo"] <= F.get(done, F.size(done) - 1)["hi"] + 1), joined).otherwise(F.concat(done, F.array(p)))

    merged = F.aggregate(F.array_sort(pairs), none, lambda a, p: F.when(F.size(a) == 0, F.array(p)).otherwise(step(a, p)))
    return F.when(raw.isNull(), None).when((raw == "") | (F.lower(raw) == "empty"), none).when(whole & ordered, merged)


def merged_ranges(rows: DataFrame, keys: list[str], lo: str, hi: str, piece: Column | None = None) -> DataFrame:
    """Gaps and islands over rows: merged closed ranges per key. ``piece``, of ``lo`` and not decreasing with it, lets a key be sorted in pieces.

    Equal rows are one with a count, so that the order has no ties: the second pass must see the rows as the first did.
    """
    once = rows.groupBy(*keys, lo, hi).agg(F.count(F.lit(1)).alias("_times"))
    reached = running_max(once, keys, [lo, hi], F.col(hi), "_reach", piece, before=True)
    start = F.when(F.col("_reach").isNull() | (F.col(lo) > F.col("_reach") + 1), F.col(lo))
    islands = running_max(reached.withColumn("_start", start), keys, [lo, hi], F.col("_start"), "_island", piece)
    return islands.groupBy(*keys, "_island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.sum("_times").alias("pieces")).drop("_island")


def capped_end(end: Column, anchor: Column) -> tuple[Column, Column, Column]:
    """The window's end no later than the anchor, whether it was cut, and by how much."""
    return F.least(end, anchor), end > anchor, F.greatest(end - anchor, F.lit(0))


def exhaustion(ranges: Column, anchor: Column, earliest: int = EARLIEST) -> Column:
    """Whether a server's ranges prove the whole history up to the anchor: struct(proven, reason, covers_from, covers_through)."""
    span = F.get(F.filter(ranges, lambda r: (r["lo"] <= earliest) & (r["hi"] >= earliest)), F.lit(0))
    reason = (
        F.when(anchor.isNull() | (anchor <= 0), "ANCHOR_REQUIRED").when(ranges.isNull(), "SERVER_RANGE_UNPARSEABLE").when(F.size(ranges) == 0, "SERVER_RANGE_EMPTY")
        .when(span.isNull(), "SERVER_HISTORY_PARTIAL").when(span["hi"] < anchor, "SERVER_HISTORY_DISJOINT").otherwise("SERVER_HAS_FULL_HISTORY")
    )
    there = reason.isin("SERVER_HISTORY_DISJOINT", "SERVER_HAS_FULL_HISTORY")
    return F.struct((reason == "SERVER_HAS_FULL_HISTORY").alias("proven"), reason.alias("reason"), F.when(there, span["lo"]).alias("covers_from"), F.when(there, span["hi"]).alias("covers_through"))


def servability(start: Column, end: Column, anchor: Column, anchor_close: Column, scan_from: Column, scan_from_close: Column, scan_through: Column, kept_from: Column, kept_from_close: Column, kept_through: Column) -> Column:
    """Whether a window can be answered from what is stored, and what remains to fetch: struct(reason, served, fetch_from)."""
    reach, _, _ = capped_end(end, anchor_close)
    proof = scan_from.isNotNull() & scan_through.isNotNull()
    proven_start = F.coalesce(scan_from_close <= start, F.lit(False))
    kept_start = F.coalesce(kept_from.isNotNull() & (kept_from_close <= start), F.lit(False))
    kept_edge = F.coalesce(kept_through >= scan_through, F.lit(False))
    reason = (
        F.when(start > reach, "WINDOW_AFTER_ANCHOR").when(~proof, "NO_COVERAGE").when(~proven_start, "PROOF_GAP_AT_START")
        .when(~(kept_start & kept_edge), "EVIDENCE_PRUNED").when(scan_through >= anchor, "FULLY_SERVABLE").otherwise("EDGE_ONLY")
    )
    return F.struct(reason.alias("reason"), reason.isin("FULLY_SERVABLE", "EDGE_ONLY").alias("served"), F.when(reason == "EDGE_ONLY", scan_through + 1).alias("fetch_from"))


def yes(c: Column) -> Column:
    """True only where the flag is there and true."""
    return F.coalesce(c, F.lit(False))


def coverage_proven(p: dict[str, Column]) -> Column:
    """Whether a walk earned its coverage claim; the refusals are tried in order. struct(proven, reason).

    ``p`` has: anchor_ok, anchor, request_bounded, window_bounded, transport_consistent, proof_anchor, run_match, status,
    verified_index (all its own conditions together), boundary_reached, history_exhausted, exhaustion_proven, exhaustion_anchor, exhaustion_through.
    """
    exhausted = yes(p["exhaustion_proven"]) & yes(p["exhaustion_anchor"] == p["anchor"]) & yes(p["exhaustion_through"] >= p["anchor"])
    reason = (
        F.when(~yes(p["anchor_ok"]) | ~yes(p["anchor"] > 0), "NO_RUN_ANCHOR").when(~yes(p["request_bounded"]), "REQUEST_NOT_BOUNDED")
        .when(~yes(p["window_bounded"]), "WINDOW_NOT_BOUNDED").when(~yes(p["transport_consistent"]), "TRANSPORT_CHANGED")
        .when(~yes(p["proof_anchor"] == p["anchor"]), "PROOF_ANCHOR_MISMATCH").when(~yes(p["run_match"]), "PROOF_RUN_MISMATCH")
        .when(p["status"] == "FAILED", "WALK_FAILED").when(p["status"] == "TRUNCATED", "SAFETY_CEILING_REACHED")
        .when(yes(p["status"] == "COMPLETE") & yes(p["verified_index"]), "RETAINED_HISTORY_AND_VERIFIED_EDGE").when(yes(p["boundary_reached"]), "BOUNDARY_REACHED_BY_TX")
        .when(yes(p["history_exhausted"]), F.when(exhausted, "HISTORY_EXHAUSTED_FULL_RETENTION").otherwise("HISTORY_EXHAUSTION_UNPROVEN"))
        .otherwise("RETENTION_DOES_NOT_PROVE_WINDOW_START")
    )
    return F.struct(reason.isin("RETAINED_HISTORY_AND_VERIFIED_EDGE", "BOUNDARY_REACHED_BY_TX", "HISTORY_EXHAUSTED_FULL_RETENTION").alias("proven"), reason.alias("reason"))


def advance(p: dict[str, Column]) -> Column:
    """Whether a proof moves a wallet's checkpoint: struct(advance, reason, next_from, next_through).

    ``p`` has: status, bounded, boundary_reached, exhaustion_claimed, exhausted, oldest, lo, hi, lo_close, oldest_close, hi_close, scan_from,
    scan_from_close, scan_through, anchor, rows_stored.
    """
    bounded, reached, claimed, done = (yes(p[k]) for k in ("bounded", "boundary_reached", "exhaustion_claimed", "exhausted"))
    lo = F.when(bounded, p["lo"]).otherwise(p["oldest"])
    has = p["scan_from"].isNotNull() & p["scan_through"].isNotNull()
    lo_close = F.when(has, p["scan_from_close"]).when(bounded, p["lo_close"]).otherwise(p["oldest_close"])
    status = F.coalesce(p["status"], F.lit("FAILED"))
    refusal = (
        F.when(status == "UNPROVEN", "PROOF_UNPROVEN").when(status != "COMPLETE", "PROOF_NOT_COMPLETE")
        .when(~bounded & ~reached & ~claimed, "RANGE_NOT_LEDGER_BOUND").when(~bounded & ~reached & ~done, "HISTORY_EXHAUSTION_UNPROVEN")
        .when(~bounded & p["oldest"].isNull(), "NO_LEDGER_FLOOR_OBSERVED").when(lo.isNull() | p["hi"].isNull() | (p["hi"] < lo), "PROOF_RANGE_MALFORMED")
        .when(lo_close.isNull() | p["hi_close"].isNull(), "PROOF_MISSING_CLOSE_TIMES")
        .when(has & ((lo > p["scan_through"] + 1) | (p["hi"] < p["scan_from"] - 1)), "PROOF_RANGE_NOT_CONTIGUOUS")
        .when(p["hi"] > p["anchor"], "PROOF_EXCEEDS_ANCHOR").when(has & (p["hi"] <= p["scan_through"]), "NO_FORWARD_PROGRESS")
    )
    why = F.when(~bounded, F.when(done, "BOOTSTRAP_HISTORY_EXHAUSTED").otherwise("BOOTSTRAP_BOUNDARY_REACHED")).when(F.coalesce(p["rows_stored"], F.lit(0)) == 0, "EMPTY_RANGE_EXHAUSTED").otherwise("RANGE_PROVEN")
    ok = refusal.isNull()
    return F.struct(
        ok.alias("advance"), F.coalesce(refusal, why).alias("reason"), F.when(ok, F.when(has, p["scan_from"]).otherwise(lo)).otherwise(p["scan_from"]).alias("next_from"),
        F.when(ok, p["hi"]).otherwise(p["scan_through"]).alias("next_through"),
    )


def quiet(rows: Column, served: Column, reason: Column, complete: Column, edge_done: Column) -> Column:
    """Whether no rows may be reported as quiet: struct(quiet, reason)."""
    why = (
        F.when(rows.isNull() | (rows < 0), "ROW_COUNT_UNKNOWN").when(rows > 0, "ROWS_PRESENT").when(~yes(served), F.coalesce(reason, F.lit("NO_COVERAGE")))
        .when(yes(complete) | yes(edge_done), "PROVEN_QUIET").otherwise("EDGE_NOT_YET_PROVEN")
    )
    return F.struct((why == "PROVEN_QUIET").alias("quiet"), why.alias("reason"))


def reconciled(wallets: DataFrame, deltas: DataFrame, key: str, tx: str, ledger: str, delta: str, previous: tuple[str, str], current: tuple[str, str], edge: tuple[str, str]) -> DataFrame:
    """Whether the change between two balances is the sum of the deltas in between.

    ``previous`` and ``current`` name (balance, ledger) columns of ``wallets``, ``edge`` the walked (from, through). A transaction counts once.
    """
    (pb, pl), (cb, cl), (lo, hi) = previous, current, edge
    once = deltas.groupBy(key, tx).agg(F.min(ledger).alias("_l"), F.min(F.struct(F.col(delta).isNull().alias("n"), F.col(delta).alias("d"))).alias("_d"), F.bool_or(F.col(delta).isNull()).alias("_missing"))
    inside = wallets.select(key, pl, cl).join(once, key).where((F.col("_l") > F.col(pl)) & (F.col("_l") <= F.col(cl)))
    sums = inside.groupBy(key).agg(F.count(F.lit(1)).alias("considered"), F.sum("_d.d").alias("_explained"), F.bool_or("_missing").alias("_gap"))
    j = wallets.join(sums, key, "left").withColumn("considered", F.coalesce("considered", F.lit(0)))
    explained = F.coalesce("_explained", F.lit(0))
    observed = F.col(cb) - F.col(pb)
    reason = (
        F.when(F.col(cb).isNull() | F.col(cl).isNull(), "NO_CURRENT_BALANCE").when(F.col(pb).isNull() | F.col(pl).isNull(), "NO_PREVIOUS_BALANCE")
        .when(F.col(lo).isNull() | F.col(hi).isNull(), "EDGE_RANGE_UNPROVEN").when(F.col(lo) > F.col(pl) + 1, "EDGE_LEAVES_GAP")
        .when(F.col(hi) != F.col(cl), "EDGE_DOES_NOT_REACH_BALANCE").when(yes(F.col("_gap")), "BALANCE_DELTAS_UNAVAILABLE")
        .when(observed == explained, "BALANCE_EXPLAINED").when(F.col("considered") > 0, "BALANCE_UNEXPLAINED_PARTIAL").otherwise("BALANCE_UNEXPLAINED_NO_ROWS")
    )
    status = F.when(reason == "BALANCE_EXPLAINED", "RECONCILED").when(reason.startswith("BALANCE_UNEXPLAINED"), "CONTRADICTION").otherwise("NOT_APPLICABLE")
    return j.select(key, status.alias("status"), reason.alias("reason"), F.col("considered"), F.when(status == "CONTRADICTION", observed - explained).alias("unexplained"))


def floor_ledger(rows: DataFrame, ledger: str, close: str, moment: Column) -> DataFrame:
    """The last ledger that closed before a moment."""
    return rows.where(F.col(close) < moment).agg(F.max_by(ledger, F.struct(close, ledger)).alias("ledger"), F.max(close).alias("close"))


def widened(stored: dict[str, Column], found: dict[str, Column]) -> Column:
    """A wallet's proof after a further one, as a struct: the proven range only widens, and each of its ends takes the close of the side it comes from.

    Both have from, through, from_close and through_close; ``stored`` may have nulls and has kept_from, kept_through and kept_from_close besides. The kept range
    grows only if the new one touches or overlaps it; otherwise the new one takes its place, since what lies between was not kept.
    """
    s, p = stored, found
    lo, hi = F.least(s["from"], p["from"]), F.greatest(s["through"], p["through"])
    touches = F.coalesce((s["kept_through"] >= p["from"] - 1) & (s["kept_from"] <= p["through"] + 1), F.lit(False))
    kept_lo = F.when(touches, F.least(s["kept_from"], p["from"])).otherwise(p["from"])
    kept_hi = F.when(touches, F.greatest(s["kept_through"], p["through"])).otherwise(p["through"])
    side = lambda end, mine, a, b: F.when(end.eqNullSafe(mine), a).otherwise(b)
    return F.struct(
        lo.alias("scan_from"), hi.alias("scan_through"), side(lo, s["from"], s["from_close"], p["from_close"]).alias("scan_from_close"), side(hi, s["through"], s["through_close"], p["through_close"]).alias("scan_through_close"),
        kept_lo.alias("kept_from"), kept_hi.alias("kept_through"), side(kept_lo, s["kept_from"], s["kept_from_close"], p["from_close"]).alias("kept_from_close"),
    )


def edge_range(through: Column, target: Column) -> Column:
    """What is still to be fetched after a proven range, as a struct; null if it reaches the target."""
    return F.when(through < target, F.struct((through + 1).alias("fetch_from"), target.alias("fetch_to"), (target - through).alias("missing")))


def same_anchor(anchor: Column) -> Column:
    """Aggregate: all rows have one anchor. The least is the greatest, so no distinct is needed; a null among them is another anchor."""
    return F.coalesce((F.min(anchor) == F.max(anchor)) & (F.count(anchor) == F.count(F.lit(1))), F.lit(False))


def unseen(named: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that claim what nothing has seen."""
    return named.join(seen.select(*keys), keys, "left_anti")
