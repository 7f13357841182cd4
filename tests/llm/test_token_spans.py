import random

import numpy as np
import pytest
from conftest import frame, prose
from ledgerloom.llm import token_spans as T
from pyspark.sql import functions as F


def brute(ends, first, last, rule):
    """Each byte of each token asked for its section."""
    out, start = [0.0] * (len(first) + 1), 0
    for end in ends:
        own = [next((i for i, (a, b) in enumerate(zip(first, last)) if a <= y < b), len(first)) for y in range(start, end)]
        if rule == "split":
            for o in own:
                out[o] += 1 / (end - start)
        else:
            out[{"start": own[0], "end": own[-1], "most": max(own, key=lambda o: (own.count(o), -own.index(o)))}[rule]] += 1
        start = end
    return out


@pytest.mark.parametrize("rule", T.RULES)
def test_rules(rule):
    rng = random.Random(6)
    for _ in range(300):
        ends = np.cumsum([rng.randint(1, 6) for _ in range(rng.randint(0, 9))]).astype(np.int64)
        n = int(ends[-1]) if len(ends) else 0
        cut = sorted(rng.randint(0, n + 2) for _ in range(2 * rng.randint(0, 4)))
        first, last = np.array(cut[::2], np.int64), np.array(cut[1::2], np.int64)
        got, none = T.attributed(ends, first, last, rule)
        assert np.allclose([*got, none], brute(ends.tolist(), first.tolist(), last.tolist(), rule))


def test_overlapping_sections_are_refused():
    with pytest.raises(ValueError):
        T.attributed(np.array([3]), np.array([0, 1]), np.array([2, 3]))
    with pytest.raises(ValueError):
        T.attributed(np.array([3]), np.array([0]), np.array([2]), "half")


@pytest.mark.parametrize("rule", T.RULES)
def test_lines_add_up_to_the_document(spark, rule):
    texts = ["one\n\ntwo lines\n", "Ünïcode 漢字\n\n\n end 🙂🙂", "x" * 3000 + "\n" + prose(1, 3000), None, "", "\n"]
    enc = T.Encoder(open(T.VOCABULARY, "rb").read())
    rows = T.counted(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), rule=rule).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in own) == pytest.approx(len(enc.encoding.encode_ordinary(t or "")))
        assert "".join((t or "")[r["start_char"] : r["end_char"]] for r in own) == (t or "")
    raw = "naïve 🙂 text"
    tokens = [enc.encoding.decode_single_token_bytes(x) for x in enc.encoding.encode_ordinary(raw)]
    assert b"".join(tokens) == raw.encode() and enc.ends(raw).tolist() == np.cumsum([len(x) for x in tokens]).tolist()


def test_given_sections(spark):
    df = spark.createDataFrame([(1, "Title\nbody text here", [(0, 5), (6, 10)]), (2, "all", []), (3, None, None)], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    rows = T.counted(df, sections="parts").collect()
    assert {r["section"] for r in rows if r["doc_id"] == 1} == {0, 1, -1} and [r["section"] for r in rows if r["doc_id"] == 2] == [-1]


def test_sections_in_any_order(spark):
    text = "Some words of a text, naïve and long enough"
    parts = [(20, 30), (None, 4), (0, 10), (5, 25), None, (9, 3), (40, 999), (12, 12), (0, 10)]
    df = spark.createDataFrame([(1, text, parts), (2, None, parts)], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = {(r["doc_id"], r["section"]): r for r in T.counted(df, sections="parts", rule="split").collect()}
    enc = T.Encoder(open(T.VOCABULARY, "rb").read())
    ends, at = enc.ends(text), np.append(T.char_bytes(text.encode()), len(text.encode()))
    # each byte asked which sound section that starts first holds it
    sound = sorted((p[0], p[1], i) for i, p in enumerate(parts) if p and None not in p and p[0] <= p[1])
    want, start = [0.0] * (len(parts) + 1), 0
    for end in ends.tolist():
        for byte in range(start, end):
            want[next((i for a, b, i in sound if at[a] <= byte < at[min(b, len(text))]), len(parts))] += 1 / (end - start)
        start = end
    assert np.allclose([got[1, i]["n_tokens"] for i in range(len(parts))] + [got[1, -1]["n_tokens"]], want)
    assert [(got[1, i]["start_char"], got[1, i]["end_char"]) for i in (0, 1, 4, 5, 6)] == [(20, 30), (None, None), (None, None), (None, None), (40, len(text))]
    assert sum(r["n_tokens"] for (d, _), r in got.items() if d == 2) == 0


def test_odd_documents(odd, none):
    got = T.counted(odd)
    assert got.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert T.counted(none).count() == 0
    assert got.where(F.col("n_tokens") < 0).count() == 0
