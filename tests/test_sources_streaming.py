from datetime import datetime, timedelta

import pytest
from ledgerloom.operators import headlines as H
from ledgerloom.operators import merge as M
from ledgerloom.sources import shards
from ledgerloom.streaming import flows as S
from pyspark.sql import functions as F

START = datetime(2024, 3, 1)


def rows(spark, n=40):
    return spark.createDataFrame([(f"h{i:03}", i, START + timedelta(hours=i)) for i in range(n)], "tx_hash string, ledger long, ts timestamp")


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_day_shards_round_trip(spark, tmp_path, fmt):
    df = rows(spark)
    shards.write_days(df, str(tmp_path / "d"), "ts", ["ts", "tx_hash"], fmt, 10)
    back = shards.read_days(spark, str(tmp_path / "d"), df.schema, "2024-03-01", "2024-03-01", fmt)
    assert sorted(r["ledger"] for r in back.collect()) == list(range(24))
    assert shards.manifest(shards.read_days(spark, str(tmp_path / "d"), df.schema, "2024-03-01", "2024-03-09", fmt), "ledger", "ts").agg(F.sum("rows")).first()[0] == 40


def test_changed_and_missing_files_are_named(spark, tmp_path):
    shards.write_days(rows(spark), str(tmp_path / "d"), "ts", ["ts"], "json", 10)
    listed = shards.file_digests(spark, str(tmp_path / "d"))
    listed = spark.createDataFrame([tuple(r) for r in listed.collect()], listed.schema)
    files = sorted((tmp_path / "d").glob("day=*/*.gz"))
    files[0].write_bytes(b"x")
    files[1].unlink()
    (files[2].parent / "part-new.json.gz").write_bytes(b"y")
    for crc in (tmp_path / "d").glob("day=*/.*.crc"):
        crc.unlink()
    assert sorted(r["problem"] for r in shards.verify_files(spark, str(tmp_path / "d"), listed).collect()) == ["DIGEST_MISMATCH", "MISSING", "UNMANIFESTED"]


def test_append_is_idempotent_and_refuses_contradictions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows(spark, 5).write.parquet(path)
    assert shards.append_new(spark, path, rows(spark, 8), "tx_hash", ["ledger"]) == 3
    assert shards.append_new(spark, path, rows(spark, 8), "tx_hash", ["ledger"]) == 0
    with pytest.raises(ValueError):
        shards.append_new(spark, path, rows(spark, 8).withColumn("ledger", F.lit(0).cast("long")), "tx_hash", ["ledger"])


def test_seals(spark):
    text = shards.sealed(spark.range(1).select(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b")))
    assert shards.opened(text) == {"a": 1, "b": None}
    with pytest.raises(ValueError):
        shards.opened(text.replace('\\"a\\":1', '\\"a\\":2'))
    with pytest.raises(ValueError):
        shards.sealed(spark.range(2))


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    rows(spark, 5).write.parquet(src)
    stream = S.stream_table(spark, src, rows(spark).schema, 1)
    S.run_available(stream, state, S.receipts(out, "tx_hash"))
    rows(spark, 9).where("ledger >= 5").write.mode("append").parquet(src)
    S.run_available(S.stream_table(spark, src, rows(spark).schema, 1), state, S.receipts(out, "tx_hash"))
    assert sorted(r["ledger"] for r in spark.read.parquet(out).collect()) == list(range(9))


def test_gaps_are_named(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 5, 99_999, 100_000, 100_003, 350_000]], "l long")
    got = sorted((r["missing_from"], r["missing_to"]) for r in S.gaps(df, "l").collect())
    assert got == [(3, 4), (6, 99_998), (100_001, 100_002), (100_004, 349_999)]


def test_admission_clock():
    assert S.admission_clock([False] * 5) == [1000, 2000, 2000, 2000, 2000]
    assert S.admission_clock([False, *[True] * 25])[-1] == 250 and S.admission_clock([False, False, *[True] * 5])[-1] == 1400


def brute_titles(rows, own, alike):
    """Every title held against every kept one of its block."""
    kept, out = {}, []
    for feed, i, t in sorted(rows, key=lambda r: r[1]):
        x = own(t or "")
        if x is not None and not any(alike(x, k) for k in kept.get(feed, [])):
            kept.setdefault(feed, []).append(x)
            out.append(i)
    return sorted(out)


TITLES = [
    ("f", 1, "Whale moves 40 million XRP to exchange wallet today"), ("f", 2, "WHALE moves 40 million XRP to an exchange wallet, today! https://x.y/z"), ("f", 3, "Whale never moves 40 million XRP to exchange wallet today"),
    ("g", 4, "Whale moves 40 million XRP to exchange wallet today"), ("f", 5, None), ("f", 6, None), ("f", 7, ""), ("f", 8, "Ripple CLO says Clarity Act tied to U.S. jobs and economic growth"),
    ("f", 9, "Passing the CLARITY Act could create over 230,000 US jobs soon enough"), ("f", 10, "Ledger amendment enabled after vote - Example News"), ("f", 11, "Ledger amendment enabled after vo..."), ("f", 12, "Price reaches 230,"),
    ("f", 13, "Fees fall as ledger closes"), ("f", 14, "Amendment enabled on ledger"),
]


def test_headlines_by_equivalence(spark):
    df = spark.createDataFrame(TITLES, "feed string, i long, t string")
    got = sorted(r["i"] for r in H.equivalent_once(df, ["feed"], "i", "t").collect())
    assert got == brute_titles(TITLES, lambda t: (H.spoken_words(t), bool(H.NEGATION.search(t))), H.equivalent)
    assert got == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]


def test_headlines_by_story(spark):
    df = spark.createDataFrame(TITLES, "feed string, i long, t string")
    got = sorted(r["i"] for r in H.stories_once(df, ["feed"], "i", "t").collect())
    assert got == brute_titles(TITLES, lambda t: None if H.whole(t) is None else H.story_words(H.whole(t)), H.same_story)
    # 2 and 3 are told by 1, 9 by 8, 14 by 10; 11 and 12 are cut off
    assert got == [1, 4, 8, 10, 13]


def test_sightings_merge_by_arrival(spark):
    df = spark.createDataFrame([("h", 2, "b", None, 5, 1, "late"), ("h", 1, "a", "x", 5, 3, "rich"), ("h", 3, "a", "y", 6, 3, "rich2"), ("g", 1, "c", None, 1, 0, "only")], "h string, at long, who string, gap string, amount long, nodes long, raw string")
    got = {r["h"]: r for r in M.merge_sightings(df, "h", ["at"], "who", ["gap"], ["amount"], "nodes", "raw").collect()}
    assert (got["h"]["sightings"], got["h"]["observers"], got["h"]["gap"], got["h"]["conflicts"], got["h"]["payload"]) == (3, ["a", "b"], "x", ["amount"], "rich")
    assert got["g"]["gap"] is None and got["g"]["conflicts"] == []


def test_first_and_last_win(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("l", 5, "c")], "k string, v long, x string")
    assert sorted(tuple(r) for r in M.first_wins(df, ["k"], ["v", "x"]).collect()) == [("k", 1, "a"), ("l", 5, "c")]
    assert sorted(tuple(r) for r in M.last_wins(df, ["k"], ["v"]).collect()) == [("k", 2, "b"), ("l", 5, "c")]
