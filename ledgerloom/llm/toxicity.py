"""Toxicity (3): nearest labelled examples by exact TF-IDF cosine, over block-max inverted indexes.

Examples are labelled documents outside the held-out fold, at most ``MOST`` of either class. Features
are words and their beginnings of 4 to 8 bytes, which catch a stem under any ending. The vocabulary is every feature
whose presence differs between the classes beyond chance (chi-squared of at least ``CHI``), however many
these are. Over all features of the examples the neighbours are those of like subject, and a few toxic words in
a long text are lost among the others; the README has the figures. A term weighs (1 + log tf) x idf, the
idf over all documents of the corpus, and vectors have length 1.

The index keeps examples in blocks of ``BLOCK``; each (block, term) has its postings and each term the
largest weight in each block. The query's product with these maxima bounds every cosine in a block,
blocks are visited from the highest bound down, and visiting stops where the bound is below the
``NEAR``-th cosine found: the neighbours are exact. Their votes weigh cos / (1 - cos + 0.1), are
smoothed towards the class share, and a logistic fitted on the examples' own leave-one-out votes
makes the score. The three nearest examples are the evidence.

The index is bounded by the features of ``MOST`` examples of either class and broadcast; examples are labelled rows, of which a
bounded sample is used; documents and idf are over all rows.

Defined cases: null and empty texts and texts without a term have no neighbours and score the smoothed
prior; ties among neighbours go to the smaller doc_id; without labels of both classes every score is the
share of class 1 (0 where there are no labels); repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import shipped
from .common import kept_columns, mapped, restored
from .decontaminate import words
from .labelled import fold, logistic, sample, squashed

MOST = 2048
#: One feature in about 130,000 passes by chance.
CHI = 20.0
STEMS = (4, 5, 6, 7, 8)
NEAR = 25
BLOCK = 64
FOLDS, HELD = 5, 0


def features(word: bytes) -> list[bytes]:
    """A word and its beginnings; a beginning ends in a byte that no word has."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]


def distinctive(seen: DataFrame, n1: int, n0: int) -> DataFrame:
    """The rows of ``seen`` (w, a documents of class 1, b of class 0) whose chi-squared, with Yates' correction, is at least ``CHI``."""
    n = n1 + n0
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d = n1 - a, n0 - b
    apart = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2)
    margins = (a + b) * (c + d) * n1 * n0
    return seen.where((margins > 0) & (n * apart * apart >= CHI * margins))


class Index:
    def __init__(self, terms: list[bytes], idf: np.ndarray, block: int = BLOCK):
        self.terms, self.idf, self.block = {t: i for i, t in enumerate(terms)}, np.asarray(idf, float), block
        self.n, self.gate = 0, {t.rstrip(b"*")[:4] for t in terms}

    def counts(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        for w, n in Counter(self.possible(text)).items():
            for i in self.numbers(w):
                out[i] = out.get(i, 0) + n
        return out

    def possible(self, text: str | None) -> list[bytes]:
        """The words that begin as a term begins; all others have no term."""
        gate = self.gate
        return [w for w in words(text) if w[:4] in gate]

    def numbers(self, word: bytes) -> list[int]:
        return [self.terms[x] for x in features(word) if x in self.terms]

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, ascending, and weights of length 1."""
        at = np.array(sorted(counts), np.int64)
        if not len(at):
            return at, np.zeros(0)
        v = (1 + np.log(np.array([counts[i] for i in at.tolist()], float))) * self.idf[at]
        length = np.sqrt((v * v).sum())
        return (at, v / length) if length else (at[:0], v[:0])

    def build(self, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        # examples led by the same term share blocks, which makes the bounds tight
        order = sorted(range(len(ids)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1, ids[i]))
        self.n, f = len(order), len(self.terms)
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.y = np.array([labels[i] for i in order], float)
        blocks = max(1, -(-self.n // self.block))
        cells: dict[int, list[tuple[int, float]]] = {}
        self.top = np.zeros((f, blocks))
        for row, i in enumerate(order):
            b, local = divmod(row, self.block)
            for t, w in zip(vectors[i][0].tolist(), vectors[i][1].tolist(), strict=True):
                cells.setdefault(b * f + t, []).append((local, w))
                self.top[t, b] = max(self.top[t, b], w)
        self.start = np.zeros(blocks * f + 1, np.int64)
        for cell, posted in cells.items():
            self.start[cell + 1] = len(posted)
        self.start = np.cumsum(self.start)
        self.local = np.zeros(self.start[-1], np.int64)
        self.weight = np.zeros(self.start[-1])
        for cell, posted in cells.items():
            s = self.start[cell]
            self.local[s : s + len(posted)] = [x for x, _ in posted]
            self.weight[s : s + len(posted)] = [w for _, w in posted]

    def nearest(self, at: np.ndarray, weights: np.ndarray, near: int = NEAR, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the ``near`` nearest examples of a cosine above 0; ``without`` is left out."""
        if not len(at) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        f = len(self.terms)
        bound = weights @ self.top[at]
        order = np.argsort(-bound, kind="stable")
        rows, cosines, seen, step, least = np.zeros(0, np.int64), np.zeros(0), 0, 4, 0.0
        while seen < len(order) and bound[order[seen]] > 0 and bound[order[seen]] >= least - 1e-12:
            wave = order[seen : seen + step]
            wave = wave[(bound[wave] > 0) & (bound[wave] >= least - 1e-12)]
            cells = (wave[:, None] * f + at[None, :]).ravel()
            first, size = self.start[cells], self.start[cells + 1] - self.start[cells]
            flat = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
            place = np.repeat(np.repeat(np.arange(len(wave)) * self.block, len(at)), size) + self.local[flat]
            got = np.bincount(place, self.weight[flat] * np.repeat(np.tile(weights, len(wave)), size), len(wave) * self.block)
            hit = np.nonzero(got > 0)[0]
            row = wave[hit // self.block] * self.block + hit % self.block
            keep = row != without
            rows, cosines = np.concatenate((rows, row[keep])), np.concatenate((cosines, got[hit][keep]))
            if len(rows) > near:
                best = np.lexsort((self.ids[rows], -np.round(cosines, 12)))[:near]
                rows, cosines = rows[best], cosines[best]
            least = cosines.min() if len(rows) >= near else 0.0
            seen, step = seen + step, step * 2
        best = np.lexsort((self.ids[rows], -np.round(cosines, 12)))
        return rows[best], np.minimum(cosines[best], 1.0)

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines / (1.1 - cosines)
        return float(((w * self.y[rows]).sum() + 0.5 * 0.5) / (w.sum() + 0.5))


def logit(v) -> np.ndarray:
    v = np.clip(np.asarray(v, float), 0.005, 0.995)
    return np.log(v / (1 - v))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held: int = HELD, most: int = MOST) -> Index:
    """``documents`` has doc_id and text."""
    spark = documents.sparkSession
    shipped(spark)
    rows, prior = sample(documents, labels, label, folds, held, most)

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for y, text in zip(pdf["y"], pdf["text"], strict=True):
                found = sorted({x for w in set(words(text)) for x in features(w)})
                yield pd.DataFrame({"w": found, "a": int(y), "b": 1 - int(y)}).astype({"w": object})

    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    seen = rows.mapInPandas(presence, "w binary, a int, b int").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # features of a bounded sample
    terms = sorted(bytes(r["w"]) for r in distinctive(seen, n1, n0).select("w").collect()) if n1 and n0 else []
    index = Index(terms, np.ones(len(terms)))

    blank = spark.sparkContext.broadcast(index)

    def corpus(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index_, total, found = blank.value, 0, Counter()
        for pdf in batches:
            for text in pdf["text"]:
                total += 1
                found.update({i for w in set(index_.possible(text if isinstance(text, str) else None)) for i in index_.numbers(w)})
        yield pd.DataFrame({"t": [-1, *found], "n": [total, *found.values()]})

    if terms:
        df = {r["t"]: r["n"] for r in documents.select("text").mapInPandas(corpus, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}  # a row a term
        total = df.pop(-1, 0)
        index.idf = np.array([np.log((1 + total) / (1 + df.get(i, 0))) + 1 for i in range(len(terms))])
        sent = spark.sparkContext.broadcast(index)

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                vs = [sent.value.vector(sent.value.counts(t)) for t in pdf["text"]]
                yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "t": [v[0] for v in vs], "w": [v[1] for v in vs]})

        examples = sorted(rows.mapInPandas(counted, "id long, y int, t array<long>, w array<double>").collect(), key=lambda r: (r["id"], r["t"], r["w"]))  # at most 2 x most
        index.build([r["id"] for r in examples], [r["y"] for r in examples], [(np.array(r["t"], np.int64), np.array(r["w"])) for r in examples])
        at = {(i, tuple(r["t"])): k for k, r in enumerate(examples) for i in [r["id"]]}
        votes, ys = [], []
        row_of = {int(i): k for k, i in enumerate(index.ids)}
        for (i, t), k in at.items():
            votes.append(index.vote(*index.nearest(np.array(t, np.int64), np.array(examples[k]["w"]), without=row_of[i])))
            ys.append(examples[k]["y"])
        index.slope, index.offset = logistic(logit(votes), np.array(ys), prior)
    else:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        index.slope, index.offset = 0.0, float(np.log(p / (1 - p)))
        index.build([], [], [])
    return index


def scored(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, held: int = HELD, most: int = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and evidence (doc_id, cosine and label of the nearest examples), with ``keep`` as _keep_0 and so on."""
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    index = fit(own, labels, folds=folds, held=held, most=most)
    sent = documents.sparkSession.sparkContext.broadcast(index)

    def made():
        index = sent.value

        def voted(texts: list) -> list[pa.Array]:
            votes, shown = [], []
            for t in texts:
                rows, cosines = index.nearest(*index.vector(index.counts(t)))
                votes.append(index.vote(rows, cosines))
                shown.append([{"doc_id": int(index.ids[r]), "cosine": float(c), "label": int(index.y[r])} for r, c in zip(rows[:3], cosines[:3], strict=True)])
            return [pa.array(squashed(logit(votes), index.slope, index.offset), pa.float64()), pa.array(shown, EVIDENCE_ARROW)]

        return voted

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *kept_columns(documents, keep))
    return mapped(rows, "_text", T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", EVIDENCE)]), made)


#: The nearest examples shown with a score.
EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))
EVIDENCE_ARROW = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))


def report(found: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    return found.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence",
    )


def without_toxic(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that score below one half, with their own columns."""
    found = scored(documents, labels, doc_id, text, keep=tuple(documents.columns)).where("score < 0.5")
    return restored(found, documents.columns)
