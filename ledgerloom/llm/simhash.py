"""SimHash near-dedup (9): a byte-position inverted index with count filtering.

A text's words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; its shingles are runs of three
words joined by a space (all words, if fewer), repeats included. A fingerprint bit is 1 where over half
of the shingles' XXH64 (UTF-8, seed 42) have it. Fingerprints link at two or fewer differing bits.

Two bits touch at most two of the eight bytes, so linked fingerprints share at least six positional
bytes. The index posts each fingerprint under every set of ``GRAM`` of its positional bytes (a list of a
single byte would hold a 256th of the corpus, and pairs of it would grow with the square of the
documents; five bytes are 40 bits). Two fingerprints that share s positional bytes meet in C(s, 5) of
the 56 postings: once at five, 6 times at six, 21 at seven, never below. The meetings are tallied per
pair, pairs below the guaranteed minimum of C(6, 5) = 6 are dropped, and the rest is verified by the
Hamming distance.

Equal fingerprints are one entry of the index, so groups of copies cost nothing. Lists of over ``LONG``
entries, which only large groups of near copies make, are not paired: each entry of one looks up the
2,080 fingerprints at one or two bits from it among the entries of such lists, by equality, which finds
the same links. A linked pair that meets in a long list is found there, and any other has all its
meetings in lists that are paired, so none is lost.

Defined cases: null, empty or blank text has the fingerprint zero, linked like any other; repeated
rows get equal results; a null doc_id gets the smallest doc_id of its component, null if there is none.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, components, gathered, kept_columns, mapped, own, single

SHINGLE = 3
RADIUS = 2
BYTES = 8
#: Positional bytes of a posting.
GRAM = 5
LONG = 512
BROADCAST_ROWS = 1_000_000
SEED = 42


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 100_000):
        hashes = np.fromiter(
            (digest(line[a:b], SEED) for a, b in zip(starts[at : min(n, at + 100_000)].tolist(), ends[at + size - 1 : min(n, at + 100_000) + size - 1].tolist(), strict=True)),
            np.uint64,
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    return _with_fp(own(documents, doc_id=doc_id, text=text), size)


def _with_fp(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``rows`` with fp instead of text."""

    def made():
        return lambda texts: [pa.array(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))]

    return mapped(rows, "text", T.StructType([T.StructField("fp", T.LongType())]), made)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(values: list[int]) -> str:
    return f"array({', '.join(f'{_signed(v)}L' if v != 1 << 63 else '(-9223372036854775807L - 1L)' for v in values)})"


def postings(index: DataFrame) -> DataFrame:
    """place (which positional bytes), value (those bytes) and fp: the inverted index, C(8, GRAM) rows a fingerprint."""
    masks = [sum(255 << 8 * k for k in chosen) for chosen in combinations(range(BYTES), GRAM)]
    return index.select("fp", F.posexplode(F.expr(f"transform({_longs(masks)}, m -> fp & m)")).alias("place", "value")).select("place", "value", "fp")


def links(index: DataFrame, radius: int = RADIUS, long: int = LONG) -> DataFrame:
    """Pairs u < v of different fingerprints at most ``radius`` (two at most) bits apart; ``index`` has distinct fp."""
    if not 0 <= radius <= 2:
        raise ValueError("the index guarantees pairs of at most two differing bits")
    posted = postings(index).repartition("place", "value")
    lengths = posted.groupBy("place", "value").agg(F.count("fp").alias("n")).where("n > 1")  # of fp, so that both read one shuffle
    shared = checkpointed(posted.join(lengths, ["place", "value"]).select("place", "value", "fp", (F.col("n") > long).alias("long")))
    short = shared.where("not long")
    # count filter: meetings per pair, of which linked pairs have a guaranteed number
    met = short.alias("a").join(short.alias("b"), F.expr("a.place = b.place and a.value = b.value and a.fp < b.fp")).groupBy(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).agg(F.count(F.lit(1)).alias("tally"))
    paired = met.where(F.col("tally") >= comb(BYTES - radius, GRAM)).where(F.expr(f"bit_count(u ^ v) <= {radius}")).select("u", "v")
    crowded = checkpointed(shared.where("long").select("fp").distinct())
    around = [1 << j for j in range(64)] * (radius > 0) + [1 << j | 1 << k for j, k in combinations(range(64), 2)] * (radius > 1)
    small = F.broadcast if crowded.count() <= BROADCAST_ROWS else (lambda x: x)
    probed = (
        crowded.select(F.col("fp").alias("u"), F.explode(F.expr(f"transform(cast({_longs(around)} as array<bigint>), m -> fp ^ m)")).alias("v")).where("u < v")
        .join(small(crowded.select(F.col("fp").alias("v"))), "v", "left_semi").select("u", "v")
    )
    # a pair may meet in lists of either kind
    return paired.union(probed).distinct()


def groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links, the row's own included."""
    fps = checkpointed(fingerprints(documents, doc_id, text, size))
    index = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(index, radius))
    index = index.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = index.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(index.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, that of the smallest doc_id (null last); the columns stay.

    Of rows that share that doc_id and fingerprint, repeated rows say, one stays.
    """
    fps = checkpointed(fingerprints(documents, doc_id, text))
    index = checkpointed(fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least")))
    return one_each(documents, fps, index, components(links(index)), _with_fp, doc_id, text)


def one_each(documents: DataFrame, fps: DataFrame, index: DataFrame, roots: DataFrame, with_fp, doc_id: str, text: str) -> DataFrame:
    """``deduplicated`` for given fingerprints, their least documents and roots; ``with_fp`` puts fp in place of text."""
    rooted = index.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    kept = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min(F.struct("least", "fp")).alias("k")).select("k.least.doc_id", "k.fp")
    often = fps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = gathered(
        kept.withColumnRenamed("doc_id", "_id").join(often, F.col("_id").eqNullSafe(F.col("doc_id"))).select("_id", F.col("fp").alias("_fp"), (F.col("n") > 1).alias("_again"))
    )
    same = documents[doc_id].eqNullSafe(F.col("_id"))
    small = F.broadcast if single(kept) else (lambda x: x)
    alone = documents.join(small(kept.where("not _again").select("_id")), same, "left_semi")
    shared = documents.join(small(kept.where("_again").select("_id").distinct()), same, "left_semi")
    rows = with_fp(shared.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *kept_columns(documents, documents.columns)))
    names = [f"_keep_{i}" for i in range(len(documents.columns))]
    again = rows.join(small(kept.where("_again")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")))
    again = again.groupBy("doc_id", "fp").agg(F.min(F.struct(*names)).alias("row"))
    return alone.union(again.select(*(F.col(f"row.{n}").alias(c) for n, c in zip(names, documents.columns, strict=True))))
