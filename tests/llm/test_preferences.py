import duckdb
from ledgerloom.llm import preferences as P
from ledgerloom.llm.queries import OP6_SQL
from pyspark.sql import functions as F

TURNS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", "left"), (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "right"), (1, 4, "user", "bye"),
    (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "alone"), (4, 1, "assistant", "yes"), (6, 0, "user", "a"), (7, 0, "system", "a"), (8, 0, None, "x"), (9, 0, None, "x"), (9, 1, "assistant", None),
    (10, 0, "user", "twice"), (10, 0, "user", "twice"), (11, 0, "user", "twice"), (11, 1, "assistant", ""), (12, 0, "user", "p"), (12, 1, "assistant", "q"), (13, 0, "user", "p"),
]


def pairs(df):
    return P.segments(df, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2)) == 0)


def made(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("side", F.lit("clash")).withColumn("h", F.lit(1))


def test_the_prompt_is_the_longest_common_prefix(spark):
    got = {}
    for r in sorted(pairs(made(spark, TURNS)).collect(), key=lambda r: (r["pair_id"], r["part"], r["position"])):
        got.setdefault(r["pair_id"], {}).setdefault(r["part"], []).append((r["segment"], r["loss"]))
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got[0] == {
        "prompt": [(say("user", "hi"), False), (say("assistant", "hello"), False), (say("user", "more"), False)],
        "chosen": [(say("assistant", "left"), True)], "rejected": [(say("assistant", "right"), True), (say("user", "bye"), False)],
    }
    assert set(got[1]) == {"prompt"} and set(got[2]) == {"chosen"} and set(got[3]) == {"chosen", "rejected"}
    assert got[4] == {"prompt": [(say("", "x"), False)], "rejected": [(say("assistant", ""), True)]}
    assert len(got[5]["prompt"]) == 1 and got[6]["chosen"] == [(say("assistant", "q"), True)] and "rejected" not in got[6]


def whole(df):
    return P.paired(df, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2)) == 0)


def test_against_sql(spark):
    rows = [t for t in TURNS if t[2] is not None] + [(20 + s, i, "user" if i % 2 else "assistant", "ä" * (i % 5) + ("x" if s and i > 300 else "")) for s in (0, 1) for i in range(600)]
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = db.execute(OP6_SQL).fetchall()
    spans = lambda m: " ".join(f"{x['start']}-{x['end']}" for x in m)
    got = [(r["pair_id"], r["chunk"], r["prompt"], r["chosen"], spans(r["chosen_mask"]), r["rejected"], spans(r["rejected_mask"])) for r in whole(made(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and len([r for r in got if r[0] == 10]) == 3


def test_pairs_are_their_segments(spark):
    parts, loss = {}, {}
    for r in sorted(pairs(made(spark, TURNS)).collect(), key=lambda r: (r["pair_id"], r["part"], r["position"])):
        k = (r["pair_id"], r["part"])
        if r["loss"]:
            loss.setdefault(k, []).append((len(parts.get(k, "")), len(parts.get(k, "")) + len(r["segment"])))
        parts[k] = parts.get(k, "") + r["segment"]
    rows = whole(made(spark, TURNS)).collect()
    assert len(rows) == len({k for k, _ in parts})
    for r in rows:
        assert [r[p] for p in ("prompt", "chosen", "rejected")] == [parts.get((r["pair_id"], p), "") for p in ("prompt", "chosen", "rejected")]
        for p in ("chosen", "rejected"):
            assert [tuple(x) for x in r[f"{p}_mask"]] == loss.get((r["pair_id"], p), [])


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", "last"), (1, 0, "user", "first"), (0, 0, "user", "first"), (0, 0, "user", "variant"), (0, 700, "assistant", "far")]
    got = pairs(made(spark, rows)).collect()
    assert len(got) == 4 + (0 if any(r["part"] == "prompt" for r in got) else 1)
    assert pairs(made(spark, rows).where("false")).count() == whole(made(spark, rows).where("false")).count() == 0


def test_no_python_on_the_main_path(spark):
    for df in (pairs(made(spark, TURNS)), whole(made(spark, TURNS))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
