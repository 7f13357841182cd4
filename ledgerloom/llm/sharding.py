"""Sharding (4): minimum-cost-flow resharding.

Old shards hold so many bytes; new shards have capacities. Moving a byte from old shard i to new shard
j costs nothing if j is i and one unit otherwise (or what ``cost`` says), so the cheapest flow moves the
fewest bytes. The flow network has a node a shard and is solved on the driver by successive shortest
paths; what it reads are one total per old shard. The flow is then carried out on blocks: an old shard's
documents stand in a line, largest first, the bytes that stay at its head, and a document goes where its
middle falls. What moves is therefore small documents, and each cut is off by half a small document.
A second, much smaller flow from the shards so made evens out what the cuts left.

In the query the old layout is a hash of the text, so equal texts start together in one shard, and a
large group of copies makes its shard too large; the flow takes the surplus away. The law is ``bytes``:
new capacities are equal.

Positions come from ``prefix_sums`` over (shard, size class), and slots likewise, so no task holds a shard.

Defined cases: null text counts one byte and has the checksum of the empty text; a document larger than
a capacity stays whole; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, prefix_sums

SHARDS = 16
ROUNDS = 2
PIECE_ROWS = 2_000


def cheapest_flow(supply: list[int], capacity: list[int], cost=None) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j, at the least total cost; capacities must hold the supply."""
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities can't hold the supply")
    cost = cost or (lambda i, j: int(i != j))
    n, m = len(supply), len(capacity)
    start, end = n + m, n + m + 1
    edges: list[list[int]] = []  # to, room, price; the reverse edge is the next one
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, room: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, room, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i in range(n):
        edge(start, i, supply[i], 0)
        for j in range(m):
            edge(i, n + j, supply[i], cost(i, j))
    for j in range(m):
        edge(n + j, end, capacity[j], 0)
    while True:
        best, via, queue, queued = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for k in out[a]:
                b, room, price = edges[k]
                if room > 0 and best[a] + price < best.get(b, 1 << 60):
                    best[b], via[b] = best[a] + price, k
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if end not in best:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = edges[via[at] ^ 1][0]
        pushed = min(edges[k][1] for k in path)
        for k in path:
            edges[k][1] -= pushed
            edges[k ^ 1][1] += pushed
    flow = {}
    for i in range(n):
        for k in out[i]:
            if k % 2 == 0 and edges[k ^ 1][1]:
                flow[i, edges[k][0] - n] = edges[k ^ 1][1]
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def carried_out(rows: DataFrame, flow: dict[tuple[int, int], int]) -> DataFrame:
    """``rows`` (old, size, h, ...) with ``new``, the shard that the flow gives each."""
    lines: dict[int, list[tuple[int, int]]] = {}
    for (i, j), b in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        at = lines[i][-1][0] if i in lines else 0
        lines.setdefault(i, []).append((at + b, j))
    # a line's pieces: classes of sizes from the largest down, each in hash ranges
    most = rows.groupBy("old", F.floor(F.log2("size") * 4).alias("s")).count().agg(F.max("count")).first()[0] or 0
    ranges = max(1, -(-most // PIECE_ROWS))
    piece = F.expr(f"cast(-floor(log2(size) * 4) * {ranges} + floor((h / 18446744073709551616D + 0.5D) * {ranges}) as long)")
    placed = prefix_sums(rows.withColumn("_piece", piece), ["old"], "_piece", [F.col("size").desc(), F.col("h"), F.col("doc_id"), F.col("c")], {"_end": F.col("size")})
    middle = F.col("_end") * 2 - F.col("size")
    new = F.col("old")
    for i, cuts in lines.items():
        at = F.lit(cuts[-1][1])
        for end, j in reversed(cuts[:-1]):
            at = F.when(middle <= 2 * end, j).otherwise(at)
        new = F.when(F.col("old") == i, at).otherwise(new)
    return placed.withColumn("new", new.cast("int")).drop("_end", "_piece")


def reshard(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (doc_id, size, h, c, old, ...) with ``shard``; ``old`` stays."""
    at = rows.withColumn("first", F.col("old"))
    for _ in range(rounds):
        sizes = {r["old"]: int(r["b"]) for r in at.groupBy("old").agg(F.sum("size").alias("b")).collect()}  # a row a shard
        n = max([shards - 1, *sizes]) + 1
        flow = cheapest_flow([sizes.get(i, 0) for i in range(n)], equal_capacities(sum(sizes.values()), shards))
        at = checkpointed(carried_out(at, flow).drop("old").withColumnRenamed("new", "old"))
    return at.withColumnRenamed("old", "shard").withColumnRenamed("first", "old")


def sharded(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, old_shards: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old, shard and slot of every document."""
    binary = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = documents.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(binary) + 1).cast("long").alias("size"), F.crc32(binary).alias("c"),
        F.xxhash64(binary, F.col(doc_id)).alias("h"), F.pmod(F.xxhash64(binary), F.lit(old_shards or shards)).cast("int").alias("old"),
    )
    at = reshard(checkpointed(rows), shards)
    most = at.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    ranges = max(1, -(-most // PIECE_ROWS))
    at = at.withColumn("_piece", F.expr(f"cast(floor((h / 18446744073709551616D + 0.5D) * {ranges}) as long)"))
    at = prefix_sums(at, ["shard"], "_piece", [F.col("h"), F.col("doc_id"), F.col("size"), F.col("c")], {"_n": F.lit(1)})
    return at.select("doc_id", "size", F.col("c").alias("text_crc32"), "old", "shard", (F.col("_n") - 1).cast("long").alias("slot"))


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number, from 1, among those equal in ``by``."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def met(documents: DataFrame, placed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Each document once, as _keep_0 and so on, with its row of ``placed``.

    They meet by doc_id, null too, and by text_crc32 and size where ``placed`` has them. Rows equal in all of these are
    numbered on either side, here by a hash of the whole row, so that only equal rows can change places.
    """
    binary = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    known = {"doc_id": F.col(f"`{doc_id}`"), "text_crc32": F.crc32(binary), "size": (F.octet_length(binary) + 1).cast("long")}
    known = {k: c for k, c in known.items() if k in placed.columns}
    hashed = [F.col(f"`{f.name}`") for f in documents.schema.fields if "map<" not in f.dataType.simpleString()]
    names = documents.columns
    d = documents.select(*(c.alias(f"_{k}") for k, c in known.items()), F.xxhash64(*hashed).alias("_row"), *(F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(names)))
    d = numbered(d, [f"_{k}" for k in known], [F.col("_row")], "_again")
    placed = numbered(placed, list(known), [F.col("shard"), F.col("slot")], "again")
    same = F.col("_again") == F.col("again")
    for k in known:
        same &= F.col(f"_{k}").eqNullSafe(F.col(k))
    return d.join(placed, same)


def in_shards(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """The documents' columns with size, shard and slot; columns that have these names already are kept as size_in and so on."""
    placed = sharded(documents, doc_id, text, shards).select("doc_id", "size", "text_crc32", "shard", "slot")
    taken = {*documents.columns, "size", "shard", "slot"}
    out = []
    for i, c in enumerate(documents.columns):
        name = c
        if c in ("size", "shard", "slot"):
            while name in taken:
                name += "_in"
            taken.add(name)
        out.append(F.col(f"_keep_{i}").alias(name))
    return met(documents, placed, doc_id, text).select(*out, "size", "shard", "slot")


def rewrite(documents: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> list[int]:
    """Write the shards that gain or lose documents to path/shard=N, leaving the others' files alone; their numbers.

    ``placed`` is ``sharded``'s result: doc_id, old, shard and slot, and text_crc32 and size, without which doc_id must be
    unique. ``documents`` may have been read from ``path``; shard and slot columns of theirs are the old layout's and are replaced. A shard
    whose number is new counts as affected; the folder of a shard that ends empty is deleted. Rows are written aside before any
    file of the old layout goes.
    """
    moves = placed.where("old <> shard")
    touched = sorted({x for r in moves.select("old", "shard").distinct().collect() for x in r})  # pairs of shards
    if touched:
        own = documents.select(*(F.col(f"`{c}`") for c in documents.columns if c not in ("shard", "slot")))
        rows = met(own, placed, doc_id, text).where(F.col("shard").isin(touched))
        rows = checkpointed(rows.select(*(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(own.columns)), "shard", "slot"))
        left = {r["shard"] for r in rows.select("shard").distinct().collect()}  # a row a shard
        spread = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
        # an overwrite by partition leaves a partition without rows as it was
        spark = documents.sparkSession
        for emptied in sorted(set(touched) - left):
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={emptied}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
