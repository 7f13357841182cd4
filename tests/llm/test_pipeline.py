import corpus_pipeline as C
from conftest import frame, prose
from ledgerloom.llm import mixing, simhash


def test_stages_run_on_odd_documents(spark, tmp_path, odd):
    passage = prose(70, 30)
    more = frame(spark, [(100, f"start {passage} end", "a"), (101, prose(71, 50), "b"), (102, prose(71, 50), "b")])
    docs = odd.union(more)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(C.STAGES):
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(str(tmp_path / f"stage{k}"))
        d = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept[name] = [r["doc_id"] for r in d.select("doc_id").collect()]
        if k < len(C.STAGES) - 1:
            assert d.columns == docs.columns
    assert 102 in kept["toxicity"] and 102 not in kept["simhash near-dedup"] and 101 in kept["simhash near-dedup"]
    assert 100 in kept["simhash near-dedup"] and 100 not in kept["benchmark decontamination"]
    assert len(kept["mixing"]) == len(kept["sharding"])
    assert C.run(spark, str(tmp_path)).count() == len(kept["sharding"])


def test_stage_order():
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing", "sharding"]
    assert simhash.RADIUS == 2 and mixing.REPEATS == 3
