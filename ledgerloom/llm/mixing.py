"""Mixing sources to target weights (2): weighted fair queueing.

Documents of a source are shuffled by a seeded hash and queue up to ``REPEATS`` times over, round after
round. A queued document's virtual finish time is the tokens its source has queued up to its end,
divided by the source's weight. All sources' queues are put in one order by finish time and served
until the next document would exceed the budget. So each source gets its weighted share to within one
document; a source that runs out (at ``REPEATS`` times its size) leaves its share to the others, by weight.

Cumulative tokens come from ``prefix_sums`` over hash ranges of a source. The queued documents, slim rows of
a few numbers, are range-sorted by (finish time, source, round, place in the source) into ranges of
about ``RANGE_ROWS``; the ranges' totals tell in which one the budget ends, and only that one is summed row by
row. What was served is, for each source, its queue up to a last document, so the documents
themselves meet one row a source: no text is shuffled and no task holds a source.

Targets, the tokens a source should get, follow from the sizes alone: the virtual time at which the sum over
sources of min(weight x time, REPEATS x size) is the budget. They are reported beside the queue's result and decide nothing.

Defined cases: null text has no tokens; a null source is a source of its own, the last; a document of no
tokens queues once, in the first round; rows equal in doc_id, source and text are one entry of the queue, so they
are taken alike; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, prefix_sums

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
SEED = 17
#: Rows of a source that meet in one window, about; rows of a range of finish times, and ranges at most.
PIECE_ROWS = 2_000
RANGE_ROWS = 20_000
RANGES = 10_000
#: Rows of under 100 bytes and a source's name that may be broadcast.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """source, source_size -> also rank, weight and target.

    One row a source; windows run over sources, not documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("rank", F.row_number().over(order).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    w = w.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * repeats)
    # sources run out in the order of cap / weight; before source i runs out, those after it still draw
    full = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = full.rowsBetween(W.unboundedPreceding, -1), full.rowsBetween(0, W.unboundedFollowing)
    w = (
        w.withColumn("budget", F.sum(F.col("source_size").cast("double")).over(W.partitionBy()) * share)
        .withColumn("at", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("out", F.col("cap") / F.col("weight"))
    )
    # the first source that doesn't run out has the time at which the budget is spent
    w = w.withColumn("time", F.min(F.when(F.col("at") <= F.col("out"), F.struct("out", "at"))).over(W.partitionBy())["at"])
    return w.select("source", "source_size", "rank", "weight", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("time"), F.col("cap"))).alias("target"))


def keyed(documents: DataFrame, doc_id: str, text: str, source: str, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    return documents.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)).alias("h"), *(F.col(f"`{k}`").alias(f"_keep_{i}") for i, k in enumerate(keep)),
    )


def with_source(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source's row of ``goal``."""
    goal = goal.withColumnRenamed("source", "_source")
    goal = F.broadcast(goal) if goal.count() <= BROADCAST_ROWS else goal
    return rows.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def queued(slim: DataFrame, goal: DataFrame, repeats: int) -> DataFrame:
    """One row per document and round: rank, round, place in the source (h, doc_id, size), mass, and the virtual finish time."""
    entries = with_source(slim.groupBy("source", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), goal)
    entries = checkpointed(entries.select("rank", "h", "doc_id", "size", (F.col("size") * F.col("n")).alias("mass"), "weight", "source_size"))
    most = entries.groupBy("rank").count().agg(F.max("count")).first()[0] or 0
    pieces = max(1, min(1 << 20, -(-most // PIECE_ROWS)))
    entries = entries.withColumn("piece", F.expr(f"cast(floor((h / 18446744073709551616D + 0.5D) * {pieces}) as long)"))
    entries = prefix_sums(entries, ["rank"], "piece", [F.col("h"), F.col("doc_id"), F.col("size")], {"end": F.col("mass")})
    rounds = F.sequence(F.lit(0), F.when(F.col("size") > 0, F.lit(repeats - 1)).otherwise(F.lit(0)))
    copies = entries.withColumn("round", F.explode(rounds))
    finish = (F.col("round") * F.col("source_size") + F.col("end")) / F.col("weight")
    return copies.select(finish.alias("finish"), "rank", "round", "h", "doc_id", "size", "mass")


def served(copies: DataFrame, budget: float) -> DataFrame:
    """The rows of ``queued`` in the order of finish times, up to where the next one would exceed ``budget``."""
    order = ["finish", "rank", "round", "h", "doc_id", "size"]
    ranges = max(1, min(RANGES, -(-copies.count() // RANGE_ROWS)))
    sorted_ = checkpointed(copies.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    # one short row a range
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = sorted_.groupBy("range").agg(F.sum("mass").alias("b")).withColumn("before", F.coalesce(F.sum("b").over(ahead), F.lit(0)))
    cut = totals.where(F.col("before") + F.col("b") > budget).orderBy("range").first()
    if cut is None:
        return sorted_.drop("range")
    line = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    last = sorted_.where(F.col("range") == cut["range"]).withColumn("run", F.sum("mass").over(line) + cut["before"])
    return sorted_.where(F.col("range") < cut["range"]).drop("range").union(last.where(F.col("run") <= budget).drop("range", "run"))


def mixed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken per document, with ``keep`` as _keep_0 and so on."""
    slim = checkpointed(keyed(documents, doc_id, text, source, seed))
    goal = checkpointed(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats, share))
    total = int(goal.agg(F.sum("source_size")).first()[0] or 0)
    last = served(checkpointed(queued(slim, goal, repeats)), total * share).groupBy("rank").agg(F.max(F.struct("round", "h", "doc_id", "size")).alias("last"))
    goal = checkpointed(goal.join(last, "rank", "left"))
    d = with_source(keyed(documents, doc_id, text, source, seed, keep) if keep else slim, goal)
    here = F.struct("h", "doc_id", "size") <= F.struct("last.h", "last.doc_id", "last.size")
    copies = F.coalesce(F.col("last.round") + here.cast("int"), F.lit(0))
    d = d.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.least(copies, F.lit(1))))
    return d.withColumn("taken", F.col("copies") * F.col("size"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its own columns."""
    d = mixed(documents, keep=tuple(documents.columns), **options)
    names = [F.col(f"_keep_{i}").alias(c) for i, c in enumerate(documents.columns)]
    return d.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names)
