"""Quality classifier (10): compression against two zstandard dictionaries.

One dictionary is trained on good and one on bad labelled text. A document is compressed piece by piece
with either; text like a dictionary's compresses better with it, so the difference of the compressed
sizes, bad - good, divided by the size of the text, rises with quality. (Divided by the compressed
sizes it would let repetitive junk through, which is small with either dictionary.) A logistic fitted on
labelled documents that the dictionaries have not seen turns it into a score.

Whole texts are compressed, in pieces of ``PIECE`` bytes, so a long text does not drown the
dictionaries in its own repetition and memory stays that of a piece.

Fitting uses at most ``MOST`` documents of either class outside the held-out fold, half of them for the
dictionaries and half for the calibration, their whole texts in either case. Everything else reads all rows.

Defined cases: null and empty texts have no pieces and a difference of 0; without labels of both classes
every score is the share of class 1 (0.5 where there are no labels); repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import shipped
from .common import mapped
from .labelled import fold, logistic, sample

MOST = 3000
PIECE = 1024
DICTIONARY = 112_640
LEVEL = 3
FOLDS, HELD = 3, 1


def pieces(text: str | None, size: int = PIECE) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Compressors:
    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        import zstandard

        def made(d: bytes):
            kind = zstandard.DICT_TYPE_FULLDICT if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            zd = zstandard.ZstdCompressionDict(d, dict_type=kind) if len(d) >= 8 else None
            if zd is not None:
                zd.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=zd, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = made(good), made(bad)

    def difference(self, text: str | None) -> float:
        good = bad = size = 0
        for p in pieces(text):
            good += len(self.good.compress(p))
            bad += len(self.bad.compress(p))
            size += len(p)
        return (bad - good) / size if size else 0.0


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held: int = HELD, most: int = MOST) -> dict:
    spark = documents.sparkSession
    shipped(spark)
    rows, prior = sample(documents, labels, label, folds, held, most)
    rows = rows.withColumn("half", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2)))

    # a bounded number of documents, whole
    taught = sorted(rows.where("half = 0").select("id", "y", "text").collect(), key=lambda r: r["id"])
    good, bad = ([p for r in taught if r["y"] == y for p in pieces(r["text"])] for y in (1, 0))
    model = {"good": dictionary(good), "bad": dictionary(bad), "slope": 0.0, "offset": float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0}
    if good and bad:
        seen = differences(rows.where("half = 1").select("id", "text", "y"), model).select("y", "d").collect()  # at most ``most`` pairs of numbers
        slope, offset = logistic([r["d"] for r in seen], [r["y"] for r in seen], prior) if seen else (0.0, model["offset"])
        model |= {"slope": slope, "offset": offset}
    return model


def differences(rows: DataFrame, model: dict) -> DataFrame:
    """The columns of ``rows`` without text, and d; ``rows`` has a column text."""
    sent = rows.sparkSession.sparkContext.broadcast((model["good"], model["bad"]))  # two dictionaries of bounded size

    def made():
        both = Compressors(*sent.value)
        return lambda texts: [pa.array([both.difference(t) for t in texts], pa.float64())]

    return mapped(rows, "text", T.StructType([T.StructField("d", T.DoubleType())]), made)


def scored(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, held: int = HELD, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted and the difference d."""
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = fit(own, labels, folds=folds, held=held, most=most)
    d = differences(own, model)
    x = F.lit(model["slope"]) * F.col("d") + F.lit(model["offset"])
    score = 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-35.0)), F.lit(35.0))))
    return d.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "d",
    )

