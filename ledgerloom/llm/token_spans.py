"""Token counts (5): offset-mapped attribution.

A document is encoded once, as a whole, so its tokens are the ones a model would see. A byte-level
vocabulary's tokens are byte strings that concatenate to the text, so the running sum of their lengths is
their exact span. Sections are character spans; both are sorted, and a binary search of one in the other
is their interval join. A token that crosses a boundary goes by one explicit rule:

- ``start``: all of it to the section of its first byte;
- ``end``: all of it to the section of its last byte;
- ``most``: all of it to the section with most of its bytes, the earlier one on a tie;
- ``split``: to each section the share of its bytes there.

Tokens outside every section are counted under section -1, so the counts of a document always add up.

The vocabulary's file is read on the driver and broadcast (about 1 MB); a document is held by one task.

Defined cases: null and empty texts have one empty section 0 of no tokens; empty sections have none; given
sections may stand in any order and are cut to the text; where some overlap, bytes belong to the one that
starts first, of these to the one that ends first, then to the one given first; a section that is null, has a
null bound or ends before it starts is empty and has null bounds; repeated rows are each counted; an
empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before the merges; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "most", "split")
_ENCODERS: dict = {}


class Encoder:
    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            self.lengths[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte at which each token ends."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])


def encoder(key, ranks: bytes) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]


def attributed(ends: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str = "start") -> tuple[np.ndarray, float]:
    """Tokens of each section [first, last) in bytes, and of none; ``ends`` as from ``Encoder.ends``."""
    if rule not in RULES:
        raise ValueError(f"no rule {rule}")
    if (first[1:] < last[:-1]).any() or (last < first).any():
        raise ValueError("sections must be in order and must not overlap")
    out = np.zeros(len(first) + 1)
    if not len(ends):
        return out[:-1], 0.0
    starts = np.concatenate(([0], ends[:-1]))
    # empty sections hold no byte; looking up among the others keeps the search right
    full = np.nonzero(last > first)[0]
    a, b = first[full], last[full]

    def holder(byte: np.ndarray) -> np.ndarray:
        i = np.searchsorted(a, byte, side="right") - 1
        inside = (i >= 0) & (byte < b[np.maximum(i, 0)]) if len(a) else np.zeros(len(byte), bool)
        return np.where(inside, full[np.maximum(i, 0)] if len(full) else 0, len(first))

    if rule in ("start", "end"):
        out += np.bincount(holder(starts if rule == "start" else ends - 1), minlength=len(out))
        return out[:-1], float(out[-1])
    # pieces of tokens: cut at all section bounds that fall inside the text
    bounds = np.unique(np.concatenate((ends, a, b)))
    bounds = bounds[(bounds > 0) & (bounds <= ends[-1])]
    begin = np.concatenate(([0], bounds[:-1]))
    token = np.searchsorted(ends, begin, side="right")
    section = holder(begin)
    size = (bounds - begin).astype(float)
    if rule == "split":
        out += np.bincount(section, size / (ends - starts)[token], len(out))
        return out[:-1], float(out[-1])
    # pieces of a token in one section (outside: in none) are summed, then the largest wins, the earlier on a tie
    key, place, inverse = np.unique(token * (len(first) + 1) + section, return_index=True, return_inverse=True)
    total = np.bincount(inverse, size)
    order = np.lexsort((place, -total, key // (len(first) + 1)))
    tokens = (key // (len(first) + 1))[order]
    winners = order[np.concatenate(([True], tokens[1:] != tokens[:-1]))]
    out += np.bincount(key[winners] % (len(first) + 1), minlength=len(out))
    return out[:-1], float(out[-1])


def char_bytes(raw: bytes) -> np.ndarray | None:
    """The byte at which each character starts, and the length; None where they are the same (ASCII)."""
    if raw.isascii():
        return None
    b = np.frombuffer(raw, np.uint8)
    return np.append(np.nonzero((b & 0xC0) != 0x80)[0], len(raw))


def given_sections(sections: list | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of sections as given, cut to the text, and which of them are sound."""
    sound = np.array([s is not None and s["start"] is not None and s["end"] is not None and s["start"] <= s["end"] for s in sections or []], bool)
    at = np.array([(s["start"], s["end"]) if ok else (0, 0) for s, ok in zip(sections or [], sound.tolist(), strict=True)], np.int64).reshape(-1, 2)
    return at.clip(0, size), sound


def disjoint(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of sections by (start, end, place), and their spans in it without what earlier ones hold already."""
    order = np.lexsort((last, first))
    first, last = first[order], last[order]
    held = np.concatenate(([0], np.maximum.accumulate(last)))[: len(last)]
    first = np.maximum(first, held)
    return order, first, np.maximum(first, last)


def line_sections(text: str) -> np.ndarray:
    """Character spans of the lines; a line's newline is its own."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cut = np.nonzero(chars == 10)[0] + 1
    bounds = np.unique(np.concatenate(([0], cut, [len(chars)])))
    return np.stack((bounds[:-1], bounds[1:]), axis=1) if len(bounds) > 1 else np.zeros((1, 2), np.int64)


def counted(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document and section: doc_id, section, start_char, end_char, n_tokens.

    ``sections`` names a column array<struct<start:int,end:int>> of character spans; without it the lines
    are the sections. Tokens of no section, if any, are section -1, of null bounds.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    key = vocabulary
    given = F.struct(F.col(text).alias("text"), F.col(sections).alias("sections")) if sections else F.struct(F.col(text).alias("text"))
    rows = documents.select(F.col(doc_id).alias("doc_id"), given.alias("in"))

    def made():
        enc = encoder(key, sent.value)

        def tokens(inputs: list) -> list[pa.Array]:
            sizes, columns = [0], [[], [], [], []]
            for x in inputs:
                t = x["text"] or ""
                at, sound = given_sections(x["sections"], len(t)) if sections else (line_sections(t), None)
                where = char_bytes(t.encode("utf-8", "surrogatepass"))
                first, last = (at[:, 0], at[:, 1]) if where is None else (where[at[:, 0]], where[at[:, 1]])
                order, first, last = disjoint(first, last)
                n, none = attributed(enc.ends(t), first, last, rule)
                n[order] = n.copy()
                at = at if sound is None else np.where(sound[:, None], at, -1)
                own = np.arange(len(at))
                if none:
                    at, n, own = np.concatenate((at, [[-1, -1]])), np.append(n, none), np.append(own, -1)
                sizes.append(len(own))
                for c, v in zip(columns, (own, at[:, 0], at[:, 1], n), strict=True):
                    c.append(v)
            joined = [np.concatenate(c) if c else np.zeros(0) for c in columns]
            parts = pa.StructArray.from_arrays([pa.array(v.astype(k)) for v, k in zip(joined, (np.int32, np.int64, np.int64, np.float64), strict=True)], names=["section", "start_char", "end_char", "n_tokens"])
            return [pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), parts)]

        return tokens

    fields = T.StructType([T.StructField("section", T.IntegerType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("n_tokens", T.DoubleType())])
    out = mapped(rows, "in", T.StructType([T.StructField("parts", T.ArrayType(fields))]), made).select("doc_id", F.inline("parts"))
    there = F.col("start_char") >= 0
    out = out.withColumns({"start_char": F.when(there, F.col("start_char")), "end_char": F.when(there, F.col("end_char"))})
    return out if rule == "split" else out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
