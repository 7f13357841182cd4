"""Chat formatting (6), native: preference pairs from chosen and rejected conversations.

The two conversations of a pair share a prompt: their longest common prefix of turns, equal in role and
text. The prompt is rendered once; what follows it is the chosen and the rejected completion, with a
mask that tells which characters count for the loss: those of the completions' assistant turns.

``segments`` renders turn by turn, ``paired`` puts the turns together: one row per pair and chunk of
``TURNS`` positions with the prompt, both completions and their masks. Ordinary conversations are one row; the rows of
a longer one concatenate in the order of chunks, so no conversation has to fit into one task.

Turns are compared by sha256 of role and text, at their position: hashes go through the shuffles, and
the text only through the last one, which brings each conversation its first differing turn.

Defined cases: a turn's repeated rows are one turn; of several rows of one turn the order is that of
(turn, hash), a null turn last; a null role or text is unlike any text, equal to another null and
rendered empty; a conversation without a partner is all completion, its pair's other side being empty;
equal conversations are all prompt, with empty completions; a null pair id makes no pair; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, prefix_sums

TURNS = 256
LAST = (1 << 62) - 1
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def content(role: Column, text: Column) -> Column:
    """A hash in which null differs from any text."""
    mark = lambda c: F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.sha2(c.cast("binary"), 256)))
    return F.sha2(F.concat(mark(role), mark(text)).cast("binary"), 256)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(CLOSE), F.coalesce(text, F.lit("")), F.lit(END))


def segments(turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), position, turn, role, segment and loss.

    ``pair`` and ``chosen`` (boolean) say which pair and side a turn belongs to.
    """
    rows = turns.select(
        pair.alias("pair_id"), F.when(chosen, 0).otherwise(1).alias("side"), F.coalesce(F.col(turn).cast("long"), F.lit(LAST)).alias("at"),
        content(F.col(role), F.col(text)).alias("h"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"),
    ).where("pair_id is not null")
    slim = rows.select("pair_id", "side", "at", "h").distinct()
    slim = prefix_sums(slim.withColumn("piece", F.floor(F.col("at") / TURNS)), ["pair_id", "side"], "piece", [F.col("at"), F.col("h")], {"position": F.lit(1)})
    slim = checkpointed(slim.select("pair_id", "side", "at", "h", (F.col("position") - 1).cast("long").alias("position")))
    # the first position at which the sides are not both there and equal
    met = slim.groupBy("pair_id", "position").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("a"), F.max("h").alias("b"))
    first = met.where("n < 2 or a <> b").groupBy("pair_id").agg(F.min("position").alias("shared"))
    placed = slim.join(first, "pair_id", "left")
    prompt = F.col("shared").isNull() | (F.col("position") < F.col("shared"))
    # the prompt is rendered from the chosen side, once
    placed = placed.where(~(prompt & (F.col("side") == 1))).select(
        "pair_id", "side", "at", "h", "position", F.when(prompt, "prompt").when(F.col("side") == 0, "chosen").otherwise("rejected").alias("part")
    )
    one = rows.groupBy("pair_id", "side", "at", "h").agg(F.first("turn").alias("turn"), F.first("role").alias("role"), F.first("text").alias("text"))
    out = one.join(placed, ["pair_id", "side", "at", "h"])
    return out.select(
        "pair_id", "part", "position", "turn", "role", rendered(F.col("role"), F.col("text")).alias("segment"),
        ((F.col("part") != "prompt") & F.col("role").eqNullSafe(F.lit("assistant"))).alias("loss"),
    )


def paired(turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, chunk, prompt, chosen, chosen_mask, rejected, rejected_mask; a mask is an array of spans [start, end) of characters."""
    s = segments(turns, pair, chosen, turn, role, text).withColumn("chunk", F.floor(F.col("position") / TURNS))
    rows = s.groupBy("pair_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("position", "part", "segment", "loss"))).alias("turns"))  # two TURNS at most
    own = lambda part: f"filter(turns, t -> t.part = '{part}')"
    joined = lambda part: F.expr(f"array_join(transform({own(part)}, t -> t.segment), '')").alias(part)
    # the running length, and the spans of the turns that count
    walk = "aggregate({}, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>)), (a, t) -> named_struct('at', a.at + length(t.segment), 'spans', if(t.loss, concat(a.spans, array(named_struct('start', a.at, 'end', a.at + length(t.segment)))), a.spans)), a -> a.spans)"
    mask = lambda part: F.expr(walk.format(own(part))).alias(f"{part}_mask")
    return rows.select("pair_id", "chunk", joined("prompt"), joined("chosen"), mask("chosen"), joined("rejected"), mask("rejected"))
