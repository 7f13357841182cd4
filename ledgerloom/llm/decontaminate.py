"""Benchmark decontamination (8): one Aho-Corasick automaton over normalised test items.

Texts are normalised by lower-casing A-Z and keeping words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
joined by one space, with a space at both ends. Every window of ten consecutive item words (the whole
item where it is shorter) is a pattern, so a match always covers whole words. A text is normalised and
scanned once; a match's end is mapped back through the offsets of the word starts to the word
positions, and to the byte span of the original text where spans are asked for.

Patterns are made and grouped on the executors. The automaton is built in each Python worker from the broadcast
patterns. They are dealt by hash to blocks of about ``BLOCK_CHARS`` characters, of which the driver and the
workers hold one at a time; there is one block unless the benchmark is very large, in which case texts pass
the blocks one after another, whatever their number.

Defined cases: a null or empty text, or one without words, has no words and no hits; an item without
words has no windows; rows of one item_id are one item; an item without item_id marks words but is
not listed; repeated documents are each scanned; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import shipped
from .common import checkpointed, kept_columns, mapped, own, restored

WINDOW = 10
BLOCK_CHARS = 4_000_000

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes(32 if i in _SEPARATORS else i for i in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BUILT: dict = {}


def words(text: str | None) -> list[bytes]:
    """Normalised words of a text, as UTF-8. ``bytes.lower`` touches A-Z only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()


def windows(item: list[bytes], size: int = WINDOW) -> list[bytes]:
    if not item:
        return []
    return [b" " + b" ".join(item[i : i + size]) + b" " for i in range(max(1, len(item) - size + 1))]


def patterns(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """w, a window, and items, the ids of the items that have it, in order; one row a window."""
    shipped(benchmark.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, t in zip(pdf["item"], pdf["text"], strict=True):
                found = sorted({w.decode("utf-8", "surrogatepass") for w in windows(words(t), size)})
                yield pd.DataFrame({"w": found, "item": [item] * len(found)}).astype(object)

    rows = own(benchmark, item=F.col(f"`{item_id}`").cast("string"), text=text).where("text is not null")
    return rows.mapInPandas(cut, "w string, item string").groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))


def blocks_of(found: DataFrame) -> Iterator[tuple[bool, dict[str, tuple]]]:
    """Blocks of patterns, each a mapping of a window to its items, and whether it is the last."""
    found = checkpointed(found)
    n = max(1, -(-(found.agg(F.sum(F.length("w"))).first()[0] or 0) // BLOCK_CHARS))
    for k in range(n):
        rows = found.where(F.pmod(F.xxhash64("w"), F.lit(n)) == k).collect()  # of BLOCK_CHARS characters, about
        yield k == n - 1, {r["w"]: tuple(r["items"]) for r in sorted(rows, key=lambda r: r["w"])}


def automaton(key, block: dict[str, tuple]):
    """The block's automaton, built once in each Python worker."""
    import ahocorasick

    if key not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for w, items in block.items():
            built.add_word(w, (w.count(" ") - 1, items))
        if block:
            built.make_automaton()
        _BUILT[key] = built
    return _BUILT[key]


def scan(text: str | None, built) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged ranges [first, last] of the words that are hit, and the items found."""
    found = words(text)
    if not found or not len(built):
        return len(found), [], set()
    line = f" {b' '.join(found).decode('utf-8', 'surrogatepass')} "
    starts: list[int] = []
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    for end, (length, names) in built.iter(line):
        if not starts:
            at = 0
            for w in line.split():
                starts.append(at)
                at += len(w) + 1
        # ``end`` is the space after the last word; the word before it starts at or before it
        last = bisect_right(starts, end - 1) - 1
        first = last - length + 1
        items.update(names)
        if ranges and first <= ranges[-1][1] + 1 and first >= ranges[-1][0]:
            ranges[-1] = (ranges[-1][0], max(last, ranges[-1][1]))
        else:
            ranges.append((first, last))
    return len(found), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as [start, end) byte spans of the original UTF-8 text."""
    at = [m.span() for m in _WORD.finditer(text.encode("utf-8", "surrogatepass").lower())]
    return [(at[a][0], at[b][1]) for a, b in ranges]


def contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, keep: tuple[str, ...] = (), with_spans: bool = False) -> DataFrame:
    """One row per document: doc_id, the columns in ``keep`` as _keep_0, _keep_1 and so on, n_words, ranges of hit words, items, byte spans."""
    spark = documents.sparkSession
    out = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *kept_columns(documents, keep))
    ranges = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    arrow = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for k, (last, block) in enumerate(blocks_of(patterns(benchmark, item_id, item_text, size))):
        sent, key = spark.sparkContext.broadcast(block), uuid_of(block)
        names = [f"_n{k}", f"_h{k}", f"_i{k}", f"_s{k}"]
        added = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.LongType(), ranges, T.ArrayType(T.StringType()), ranges), strict=True)])

        def made(sent=sent, key=key):
            built = automaton(key, sent.value)

            def scanned(texts: list) -> list[pa.Array]:
                rows = [scan(t, built) for t in texts]
                where = [spans(t, r[1]) if with_spans and r[1] else [] for t, r in zip(texts, rows, strict=True)]
                pairs = lambda lists: pa.array([[{"a": a, "b": b} for a, b in x] for x in lists], arrow)
                return [pa.array([r[0] for r in rows], pa.int64()), pairs([r[1] for r in rows]), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())), pairs(where)]

            return scanned

        out = mapped(out.withColumnRenamed("_text", "_t") if last else out.withColumn("_t", F.col("_text")), "_t", added, made)
        if not last:
            out = checkpointed(out)
            sent.unpersist()
    n = range(k + 1)
    if k == 0:
        return out.withColumnsRenamed({"_n0": "n_words", "_h0": "hits", "_i0": "items", "_s0": "spans"})
    union = lambda c: F.expr(MERGE.format(f"array_sort(flatten(array({', '.join(f'_{c}{k}' for k in n)})))"))
    out = out.withColumns({"n_words": F.col("_n0"), "hits": union("h"), "items": F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(f"_i{k}") for k in n))))), "spans": union("s")})
    return out.drop(*(f"_{c}{k}" for c in "nhis" for k in n))


#: Sorted ranges with those that overlap or touch joined.
MERGE = """aggregate({}, cast(array() as array<struct<a:int,b:int>>), (s, x) -> if(size(s) > 0 and x.a <= element_at(s, -1).b + 1,
 concat(slice(s, 1, size(s) - 1), array(named_struct('a', element_at(s, -1).a, 'b', greatest(element_at(s, -1).b, x.b)))), concat(s, array(x))))"""


def uuid_of(block: dict[str, tuple]) -> str:
    h = hashlib.sha256()
    for w, items in block.items():
        h.update(f"{w}\0{items}\n".encode("utf-8", "surrogatepass"))
    return h.hexdigest()


def report(found: DataFrame) -> DataFrame:
    """The digest of ``contamination``: counts, the items' sha256 and the verdict."""
    n_hit = F.expr("aggregate(hits, 0L, (s, x) -> s + x.b - x.a + 1)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those in which a window occurs, with their own columns."""
    found = contamination(documents, benchmark, doc_id, text, keep=tuple(documents.columns))
    return restored(found.where(F.size("hits") == 0), documents.columns)
