"""Merging of repeated records: sightings, first-wins, last-wins, field-wise and per-key summaries.

Arrival order is always an explicit list of columns, so results never depend on partitioning. All are
plain aggregates with a map-side part; no window holds a key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _earliest(value: Column, order: Column) -> Column:
    """The first non-null value in the order; null if all are."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def merge_sightings(rows: DataFrame, key: str, order: list[str], observer: str, fill: list[str], conflict: list[str], richness: str, payload: str, union: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: its observers, the number of sightings, gaps filled from the earliest sighting that
    has a value, the columns on which sightings contradict one another, and the payload of the richest
    sighting (the earliest of several), and of the ``union`` columns, which are arrays, every value that any sighting has."""
    at = F.struct(*order)
    clash = F.array_compact(F.array(*(F.when(F.min(c) != F.max(c), F.lit(c)) for c in conflict)))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("sightings"), F.array_sort(F.collect_set(observer)).alias("observers"),
        *(_earliest(F.col(c), at).alias(c) for c in fill),
        clash.alias("conflicts"),
        F.min_by(payload, F.struct((-F.col(richness)).alias("_rich"), at.alias("_at"))).alias("payload"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in union),
    )


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_x"))
    return first.select(*(F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in rows.columns))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key; the order must not have nulls."""
    own = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*own).alias("_row"))).alias("_x"))
    return last.select(*(F.col(c) if c in keys else F.col(f"_x._row.{c}").alias(c) for c in rows.columns))


def upserted(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored rows with the fresh ones over them."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def upsert_conflicts(stored: DataFrame, fresh: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Keys that both sides have with different content: what an idempotent append must refuse."""
    a, b = stored.alias("a"), fresh.alias("b")
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).where(differs).select(F.col(f"a.{key}").alias(key))


def appended(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored rows and the fresh rows whose key is new."""
    return stored.unionByName(fresh.join(stored.select(key), key, "left_anti"))


def fieldwise_union(sources: list[tuple[str, DataFrame]], key: str, fields: list[str]) -> DataFrame:
    """Registries in order of precedence: per key the first non-null of each field and the sources that know it."""
    rows = None
    for rank, (name, df) in enumerate(sources):
        part = df.select(key, *fields, F.lit(rank).alias("_rank"), F.lit(name).alias("_source"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(*(_earliest(F.col(f), F.struct("_rank", f)).alias(f) for f in fields), F.array_sort(F.collect_set("_source")).alias("sources"))


def roster(sources: list[tuple[str, DataFrame]], key: str, fields: list[str], valid: Column, identified: Column, label: Column) -> tuple[DataFrame, DataFrame]:
    """The union of registries as targets, and the rows rejected from it.

    ``valid``, ``identified`` and ``label`` are read on the merged row. Targets come in a fixed order: identified first, then by label and key. A key
    that is null or not valid is rejected with what is known of it.
    """
    merged = fieldwise_union(sources, key, fields).withColumn("identified", F.coalesce(identified, F.lit(False))).withColumn("label", label)
    good = F.coalesce(valid, F.lit(False)) & F.col(key).isNotNull()
    return merged.where(good).orderBy(F.col("identified").desc(), F.col("label"), F.col(key)), merged.where(~good)


def usable_name(name: Column, longest: int = 60) -> Column:
    """A looked-up name, trimmed; null if it is empty, too long or itself an address."""
    n = F.trim(name)
    return F.when((n != "") & (F.length(n) <= longest) & ~n.rlike("^r[1-9A-HJ-NP-Za-km-z]{24,34}$"), n)


def lookups_due(wanted: DataFrame, misses: DataFrame, key: str, asked: str, now: Column, days: int = 7) -> DataFrame:
    """Rows to ask about: those not asked in vain within so many days. Of several misses of a key the latest counts; one without a time counts as none."""
    fresh = misses.groupBy(key).agg(F.max(asked).alias("_asked")).where(now - F.col("_asked") < F.expr(f"interval {days} days"))
    return wanted.join(fresh.select(key), key, "left_anti")


def filled_slots(committed: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Looked-up values fill empty fields only; a disagreement is listed and changes nothing."""
    f = found.select(F.col(key).alias("_key"), *(F.col(x).alias(f"_f_{x}") for x in fields))
    j = committed.join(f, committed[key] == F.col("_key"), "left")
    clash = F.array_compact(F.array(*(F.when(F.col(x) != F.col(f"_f_{x}"), F.lit(x)) for x in fields)))
    return j.select(*[c for c in committed.columns if c not in fields], *(F.coalesce(F.col(x), F.col(f"_f_{x}")).alias(x) for x in fields), clash.alias("conflicts"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """ADDED, REMOVED and CHANGED keys between two snapshots."""
    mark = lambda df, n: df.select(F.col(key).alias(key), F.sha2(F.to_json(F.struct(*compared)), 256).alias(n))
    j = mark(old, "_old").join(mark(new, "_new"), key, "full")
    state = F.when(F.col("_old").isNull(), "ADDED").when(F.col("_new").isNull(), "REMOVED").when(F.col("_old") != F.col("_new"), "CHANGED")
    return j.select(key, state.alias("change")).where("change is not null")
