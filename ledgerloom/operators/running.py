"""Running values over a key's rows of which no task holds more than a piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running_max(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, piece: Column | None = None, before: bool = False) -> DataFrame:
    """The rows with ``name``, the largest value (nulls apart) of their key's rows up to them in the order; with ``before`` without the row itself.

    ``piece`` must not decrease in the order. Its pieces are sorted apart; each begins with the largest value of the pieces before, which
    takes one short row a piece. Without it a key is one piece. Null keys are a key.
    """
    if piece is None:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
        return rows.withColumn(name, F.max(value).over(w))
    cut = rows.select(*keys, piece.alias("_p"), F.lit(1).alias("_real"), value.alias("_v"), F.struct(*order).alias("_o"), F.struct(*rows.columns).alias("_whole"))
    earlier = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    ends = cut.groupBy(*keys, "_p").agg(F.max("_v").alias("_most"))
    carry = ends.select(*keys, "_p", F.lit(0).alias("_real"), F.max("_most").over(earlier).alias("_v"))
    w = W.partitionBy(*keys, "_p").orderBy("_real", "_o").rowsBetween(W.unboundedPreceding, -1 if before else 0)
    line = cut.unionByName(carry, allowMissingColumns=True).withColumn("_run", F.max("_v").over(w)).where("_real = 1")
    return line.select("_whole.*", F.col("_run").alias(name))
