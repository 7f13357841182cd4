"""Bounded samples of labelled documents, and the logistic calibration both classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SEED = 29


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, float]:
    """At most ``most`` labelled documents of either class outside the held-out fold, and the share of class 1.

    The sample is the rows of the least seeded hashes, so it is the same in every run. Labels that are
    null or not 0 or 1, and labels of several values for one doc_id, teach nothing.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where(f"id is not null and y in (0, 1)")
    known = known.where(fold(F.col("id"), folds) != held).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    known = checkpointed(known)
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(most)
        ids = part if ids is None else ids.union(part)
    # at most 2 x most rows of two numbers
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id").where("text is not null")
    # a doc_id may repeat, however often; its least text stands for it, which keeps the bound
    rows = checkpointed(rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")))
    total = sum(n.values())
    return rows, n.get(1, 0) / total if total else 0.0


def logistic(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of p(1 | x), with the classes weighted to the share ``prior`` of class 1.

    One pseudo-count in each class keeps separable samples finite; the slope is never negative.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if len(set(y.tolist())) < 2:
        return 0.0, float(np.log(prior / (1 - prior)))
    mean, spread = x.mean(), x.std() or 1.0
    z = (x - mean) / spread
    n1, n0 = y.sum(), len(y) - y.sum()
    w = np.where(y == 1, prior / n1, (1 - prior) / n0) * len(y)
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        g = w * (p - t)
        h = w * p * (1 - p) + 1e-9
        ga, gb = (g * z).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 4.0 / max(1e-9, abs(da), abs(db)))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    a = max(a, 0.0)
    return float(a / spread), float(b - a * mean / spread)


def squashed(x, slope: float, offset: float):
    return 1 / (1 + np.exp(-np.clip(slope * np.asarray(x, float) + offset, -35, 35)))
