"""Daily series: flows by category, lead and lag against price, drains, signing modes, escrow rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def guarded_corr(x: str, y: str, n: Column, least: int = 3) -> Column:
    """Pearson's r, null with too few points or no variance. From sums, because ``corr`` fails on zero variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    sx, sy = F.stddev_pop(a), F.stddev_pop(b)
    cov = F.covar_pop(a, b)
    return F.when((n >= least) & (sx > 1e-12) & (sy > 1e-12), cov / (sx * sy))


def lead_lag(days: DataFrame, keys: list[str], day: str, flow: str, price: str, least: int = 6) -> DataFrame:
    """Correlation of flow with the price change of the same day, of the next and of the previous.

    Day 0 has no change of its own and takes no part in any of the three.
    """
    w = W.partitionBy(*keys).orderBy(day)
    d = days.withColumn("_i", F.row_number().over(w) - 1).withColumn("_before", F.lag(price).over(w))
    d = d.withColumn("_chg", F.when(F.col("_i") > 0, F.when(F.col("_before") > 0, (F.col(price) - F.col("_before")) / F.col("_before") * 100.0).otherwise(0.0)))
    d = d.withColumn("_next", F.when(F.col("_i") >= 1, F.lead("_chg").over(w))).withColumn("_prev", F.when(F.col("_i") >= 2, F.lag("_chg").over(w)))
    d = d.withColumn("_f", F.col(flow).cast("double"))
    out = {}
    for name, c in (("same", "_chg"), ("leads", "_next"), ("lags", "_prev")):
        n = F.count(F.col(c))
        out[name] = F.when(n >= least, guarded_corr("_f", c, n)).alias(name)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), *out.values())


def verdict(rows: DataFrame) -> DataFrame:
    """The strongest relation, in the order leads, same, lags; weak ones are none."""
    best, name = F.lit(-1.0), F.lit("none")
    for k in ("leads", "same", "lags"):
        r = F.coalesce(F.abs(F.round(F.col(k), 9)), F.lit(-1.0))
        name, best = F.when(r > best, F.lit(k)).otherwise(name), F.greatest(best, r)
    strength = F.when(best >= 0.75, "strong").when(best >= 0.55, "clear").when(best >= 0.35, "weak").otherwise("none")
    return rows.withColumn("strength", strength).withColumn("relation", F.when(best >= 0.35, name).otherwise("none"))


def drain(readings: DataFrame, key: str, at: str, balance: str, expected: Column, light: float = 1_000_000, floor: float = 10_000) -> DataFrame:
    """Each key's state against its high-water mark: DRAINED, BLEEDING, LIGHT or OK."""
    g = readings.groupBy(key).agg(F.max(balance).alias("peak"), F.max_by(balance, at).alias("last"), F.max(expected).alias("_label"), F.count(F.lit(1)).alias("n"))
    want = F.greatest(F.coalesce("_label", F.lit(0.0)), F.col("peak"))
    ratio = F.col("last") / want
    state = (
        F.when(want < floor, F.when(F.col("last") < light, "LIGHT").otherwise("OK"))
        .when(ratio <= 0.05, "DRAINED").when(ratio <= 0.60, "BLEEDING").when((F.col("last") < light) & (want < light), "LIGHT").otherwise("OK")
    )
    return g.select(key, "n", "peak", "last", want.alias("expected"), F.when(want > 0, ratio).alias("ratio"), state.alias("state"))


def running_peak(readings: DataFrame, key: str, at: str, balance: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(at)
    return readings.withColumn("peak", F.max(balance).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("previous", F.lag(balance).over(w))


#: What a signing mode's state becomes on an observation of single and of multisig, eight more standing for a flip. States: nothing seen, one single, one
#: multisig, one of each; single, and that with one multisig since; multisig, and that with one single since.
_AFTER = ((1, 2), (4, 3), (3, 6), (4, 6), (4, 5), (5, 14), (7, 6), (12, 7))


def mode_changes(rows: DataFrame, key: str, order: list[str], mode: str, piece: Column | None = None) -> DataFrame:
    """key, n, mode and flips: where an account's established signing mode flips.

    A mode (single or multisig; other values and null are counted in n and change nothing) is established by two observations; it flips when
    the other one's cumulative count since the last flip reaches two. That is an automaton of eight states, so a stretch of observations is a map
    of states, and maps of stretches follow one another: ``piece``, which must not decrease in the order, cuts an account's life into stretches that are folded in
    tasks of their own, and only their maps, eight numbers each, meet in one row.
    """
    after = F.array(*(F.lit(x) for pair in _AFTER for x in pair))
    move = lambda a, x: F.when(x < 0, a).otherwise(a - a % 8 + F.element_at(after, (a % 8 * 2 + x + 1).cast("int")))
    code = F.when(F.col(mode) == "single", 0).when(F.col(mode) == "multisig", 1).otherwise(-1)
    cut = F.lit(0) if piece is None else piece
    seq = F.transform(F.array_sort(F.collect_list(F.struct(*order, code.alias("_m")))), lambda x: x["_m"])
    parts = rows.groupBy(key, cut.alias("_p")).agg(seq.alias("_s"))
    starts = F.array(*(F.lit(i).cast("long") for i in range(8)))
    maps = F.aggregate("_s", starts, lambda acc, x: F.transform(acc, lambda a: move(a, x).cast("long")))
    parts = parts.select(key, F.size("_s").alias("_n"), F.struct("_p", maps.alias("_map")).alias("_x"))
    g = parts.groupBy(key).agg(F.sum("_n").cast("int").alias("n"), F.array_sort(F.collect_list("_x")).alias("_xs"))
    end = F.aggregate("_xs", F.lit(0).cast("long"), lambda a, p: a - a % 8 + F.element_at(p["_map"], (a % 8 + 1).cast("int")))
    g = g.select(key, "n", end.alias("_end"))
    return g.select(key, "n", F.when(F.col("_end") % 8 >= 6, "multisig").when(F.col("_end") % 8 >= 4, "single").alias("mode"), F.floor(F.col("_end") / 8).cast("int").alias("flips"))


def escrow_lanes(rows: DataFrame, keys: list[str], kind: str, amount: str, key: str) -> DataFrame:
    """Locks, releases and cancels; a cancel is counted but carries no amount."""
    is_ = lambda k: F.col(kind) == k
    money = lambda k: F.coalesce(F.sum(F.when(is_(k), F.col(amount))), F.lit(0)).cast("double")
    return rows.groupBy(*keys).agg(
        F.count_if(is_("LOCK")).alias("locks"), money("LOCK").alias("locked"), F.count_if(is_("UNLOCK")).alias("unlocks"), money("UNLOCK").alias("released"),
        F.count_if(is_("CANCEL")).alias("cancels"), F.max_by(key, F.when(is_("CANCEL"), None).otherwise(F.struct(amount, key))).alias("largest"),
    )
