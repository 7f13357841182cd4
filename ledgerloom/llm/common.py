"""Shared building blocks: lineage cuts, distributed prefix sums and ranks, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..shipping import shipped

LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bytes of text that a worker works on at a time, and of a batch that Spark sends it; Spark's own limit of a batch.
PIECE = 1 << 21
BATCH = str(1 << 23)
DEFAULT_BATCH = "67108864b"
DEFAULT_SINGLE = "134217728b"
#: Rows, of some longs, that one task joins and groups, and edges that it joins to components.
FEW = 250_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it without its lineage.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session may go without that
    setting; a folder of this machine is then used, which no other executor would need to read.

    The shuffles that led to ``df`` are not needed any more. Spark deletes the files of those that the driver's
    garbage collector has found unreachable, so it is asked to look; else they stay on the executors' disks.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"{LOCAL_CHECKPOINTS}/{uuid.uuid4().hex}"
        sc.setCheckpointDir(folder)
    out = df.checkpoint(eager=True)
    sc._jvm.System.gc()
    return out


def single(df: DataFrame) -> bool:
    """Whether the checkpointed ``df`` is one partition."""
    return df._jdf.rdd().getNumPartitions() == 1


def short(df: DataFrame) -> DataFrame:
    """The checkpointed ``df``; in one partition, if it has at most ``FEW`` rows.

    Lists of one partition are joined and grouped with one another without a shuffle, which takes a task and its files
    for every partition, however few the rows are. Spark shuffles them all the same where it guesses that a side is over
    ``spark.sql.maxSinglePartitionBytes``, and it guesses the product of both sides for a join. So that limit is lifted, unless the
    session has its own, and the list is given the number of its rows, which cuts none.
    """
    rows = df.count()
    if rows > FEW:
        return df
    name = "spark.sql.maxSinglePartitionBytes"
    if df.sparkSession.conf.get(name, DEFAULT_SINGLE) == DEFAULT_SINGLE:
        df.sparkSession.conf.set(name, str(1 << 60))
    return df.coalesce(1).limit(max(rows, 1))


def gathered(df: DataFrame) -> DataFrame:
    return short(checkpointed(df))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_columns(df: DataFrame, keep: tuple[str, ...] | list[str]) -> list[Column]:
    """Columns carried through under names of our own, so extra columns can't clash with an operator's."""
    return [F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)]


def restored(df: DataFrame, keep: tuple[str, ...] | list[str]) -> DataFrame:
    return df.select(*(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)))


def smaller_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of at most BATCH bytes, unless the session has its own limit; results don't depend on it.

    A batch stands in the executor's memory outside the heap, and again in its worker's.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(name, BATCH)


def pieces(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, rows) of runs of at most ``most`` bytes of text, a run of one row at least. A struct counts by its text."""
    if pa.types.is_struct(texts.type):
        texts = texts.field("text")
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    first = 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + (most or PIECE), "right")))
        yield first, last - first
        first = last


def mapped(df: DataFrame, text: str, added: T.StructType, made: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """``df`` without its text column, with columns made from it; the other columns pass through untouched as Arrow.

    ``made`` is called once a task and returns a function from a batch's texts to the arrays of ``added``. It sees texts of
    PIECE bytes at a time (one text, if that is longer), so what a worker holds does not follow the size of Spark's batches.
    """
    shipped(df.sparkSession)
    smaller_batches(df.sparkSession)
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = made()
        for b in batches:
            at = b.schema.get_field_index(text)
            for first, rows in pieces(b.column(at)):
                part = b.slice(first, rows)
                columns = [part.column(i) for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays(columns + f(part.column(at).to_pylist()), names=schema.names)

    return df.mapInArrow(run, schema)


def own(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the columns an operator works on, under names of its own, so extra columns can't clash."""
    return df.select(*(F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items()))


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running totals within ``keys``, in the order (``bucket``, ``order``), with no task holding a whole key.

    ``bucket`` is a column that rises with the order and cuts each key into pieces small enough for
    one task. Each piece is summed map-side, the pieces' totals are accumulated (one short row a
    piece), and only within a piece do rows meet in a window. ``sums`` maps a new column to the
    expression accumulated; the sum includes the row itself. Keys and buckets must not be null.
    """
    by = [*keys, bucket]
    pieces = df.groupBy(*by).agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    ahead = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(*by, *(F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_b_{n}") for n in sums))
    within = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.select("*", *(F.sum(c).over(within).alias(f"_w_{n}") for n, c in sums.items()))
    return rows.join(pieces, by).select(*df.columns, *((F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def grouped_by(lead: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the groups of x[i] and y[i]; ``lead`` has the least member of each one's group."""
    while len(x):
        low, high = np.minimum(lead[x], lead[y]), np.maximum(lead[x], lead[y])
        apart = low != high
        x, y = x[apart], y[apart]
        np.minimum.at(lead, high[apart], low[apart])
        while (lead[lead] != lead).any():
            lead[:] = lead[lead]


def _few_components(e: DataFrame) -> DataFrame:
    """(node, root) of a bounded number of edges (u, v), in one task."""
    shipped(e.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            u.append(b["u"].to_numpy())
            v.append(b["v"].to_numpy())
        nodes, at = np.unique(np.concatenate(u + v), return_inverse=True)
        lead = np.arange(len(nodes))
        grouped_by(lead, *np.split(at, 2))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[lead])], names=["node", "root"])

    return short(checkpointed(e.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")))


def components(edges: DataFrame, u: str = "u", v: str = "v", most: int = 60) -> DataFrame:
    """Connected components of an edge list of longs: one row (node, root) per node, root the smallest node.

    Alternates large-star and small-star contractions, so the edge list never grows, rounds are
    logarithmic in the longest path, and nothing but a checksum reaches the driver. Every round is
    checkpointed; a list of at most ``FEW`` edges is joined by one task instead, as a round is some six shuffles however
    few its rows are. Self-links and repeats are allowed; an empty list gives no rows.
    """
    e = checkpointed(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    )
    if e.count() <= FEW:
        return _few_components(e)
    mark = None
    for _ in range(most):
        # large-star: neighbours above a node hang on the smallest node around it
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small-star: a node and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
