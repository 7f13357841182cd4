import itertools
import random
import zlib

import pytest
from conftest import frame, prose
from ledgerloom.llm import sharding as S
from pyspark.sql import functions as F


def test_the_flow_moves_the_fewest_bytes():
    rng = random.Random(7)
    for _ in range(50):
        supply = [rng.randrange(100) for _ in range(rng.randrange(1, 6))]
        capacity = S.equal_capacities(sum(supply), rng.randrange(1, 7))
        flow = S.cheapest_flow(supply, capacity)
        assert [sum(b for (i, _), b in flow.items() if i == k) for k in range(len(supply))] == supply
        assert all(sum(b for (_, j), b in flow.items() if j == k) <= c for k, c in enumerate(capacity))
        stay = sum(min(s, c) for s, c in zip(supply, capacity))
        assert sum(b for (i, j), b in flow.items() if i != j) == sum(supply) - stay


def test_the_flow_heeds_costs():
    cost = lambda i, j: abs(i - j)
    flow = S.cheapest_flow([2, 1, 0], [1, 1, 1], cost)
    best = min(sum(cost(i, j) for i, j in zip((0, 0, 1), p)) for p in itertools.permutations(range(3)))
    assert sum(cost(i, j) * b for (i, j), b in flow.items()) == best
    with pytest.raises(ValueError):
        S.cheapest_flow([3], [2])


def test_shards_are_even_and_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE_ROWS", 40)
    rng = random.Random(8)
    copy = prose(99, 80)
    rows = [(i, copy if i % 3 == 0 else prose(i, rng.randrange(1, 200)), "s") for i in range(1500)]
    got = S.sharded(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)
    by = [[r for r in got if r["shard"] == k] for k in range(S.SHARDS)]
    sizes = [sum(r["size"] for r in b) for b in by]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / S.SHARDS + 1500
    assert all(sorted(r["slot"] for r in b) == list(range(len(b))) for b in by)


def test_odd_documents(spark, odd, none):
    got = S.in_shards(odd)
    assert got.count() == odd.count() and {"doc_id", "text", "source", "size", "shard", "slot", "fp"} <= set(got.columns)
    assert S.sharded(none).count() == S.in_shards(none).count() == 0


def test_only_affected_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "doc_id long, text string")
    placed = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 1, 0), (2, 1, 1, 1), (3, 2, 2, 0), (4, 3, 3, 0), (5, 3, 3, 1)], "doc_id long, old int, shard int, slot long")
    path = str(tmp_path / "shards")
    docs.join(placed.select("doc_id", "old", "slot"), "doc_id").withColumnRenamed("old", "shard").write.partitionBy("shard").parquet(path)
    before = {p.name for p in (tmp_path / "shards" / "shard=3").iterdir()}
    assert S.rewrite(docs, placed, path) == [0, 1]
    assert {p.name for p in (tmp_path / "shards" / "shard=3").iterdir()} == before
    assert sorted((r["doc_id"], r["shard"]) for r in spark.read.parquet(path).collect()) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3), (5, 3)]


def test_shrinking_leaves_no_document_twice(spark, tmp_path):
    docs = spark.createDataFrame([(None, "t0"), *((i, f"t{i}") for i in range(1, 6))], "doc_id long, text string")
    placed = spark.createDataFrame([(None, 0, 0, 0), (1, 0, 0, 1), (2, 1, 1, 0), (3, 2, 0, 2), (4, 3, 1, 1), (5, 3, 1, 2)], "doc_id long, old int, shard int, slot long")
    path = str(tmp_path / "shards")
    docs.join(placed, docs["doc_id"].eqNullSafe(placed["doc_id"])).select(docs["doc_id"], "text", F.col("old").alias("shard"), "slot").write.partitionBy("shard").parquet(path)
    assert S.rewrite(docs, placed, path) == [0, 1, 2, 3]
    assert sorted((r["text"], r["shard"]) for r in spark.read.parquet(path).collect()) == [("t0", 0), ("t1", 0), ("t2", 1), ("t3", 0), ("t4", 1), ("t5", 1)]
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == ["shard=0", "shard=1"]


def test_every_row_once_whatever_its_id(spark, tmp_path):
    """16 shards become 5: null and repeated ids, rows wholly equal, rows that differ in another column only."""
    rows = [(i % 40 if i % 5 else None, f"text {i % 50} " * (1 + i % 7), f"x{i % 3}") for i in range(400)] + [(7, "same", "y")] * 9 + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    path = str(tmp_path / "shards")
    old = S.met(docs, S.sharded(docs, shards=16), "doc_id", "text")
    old.select(*(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(docs.columns)), "shard", "slot").write.partitionBy("shard").parquet(path)
    stored = spark.read.parquet(path)
    placed = S.sharded(stored, shards=5).drop("old")
    # the layout on disk is where each row stands now
    now = S.met(stored.drop("slot"), placed, "doc_id", "text").select(*placed.columns, F.col("_keep_3").alias("old"))
    assert S.rewrite(stored, now, path) == list(range(16))
    got = spark.read.parquet(path)
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["note"]) for r in got.collect()))) == sorted(map(repr, rows))
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == [f"shard={k}" for k in range(5)]
    slots = {}
    for r in got.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"a{i}", i * 2, f"b{i}", "c") for i in range(30)], "doc_id long, text string, size string, shard long, slot string, size_in string")
    got = S.in_shards(docs, shards=3)
    assert got.columns == ["doc_id", "text", "size_in_in", "shard_in", "slot_in", "size_in", "size", "shard", "slot"]
    assert sorted((r["doc_id"], r["size_in_in"], r["shard_in"], r["slot_in"], r["size_in"]) for r in got.collect()) == [(i, f"a{i}", i * 2, f"b{i}", "c") for i in range(30)]
    assert {r["shard"] for r in got.collect()} == {0, 1, 2}
