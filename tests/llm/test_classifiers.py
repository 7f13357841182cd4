import random
import zlib

import numpy as np
import pytest
from conftest import frame, prose
from ledgerloom.llm import labelled, quality, toxicity


def labelled_docs(spark):
    rng = random.Random(11)
    bad = ["scumbag", "dreckly", "moronic"]
    rows, marks = [], []
    for i in range(400):
        w = prose(i + 500, 60).split()
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "s", "er"])
        junk = i % 5 == 0
        text = " ".join(x.upper() + "!!" if junk else x for x in w)
        rows.append((i, text, "s"))
        marks.append((i, 0 if junk else 1, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled_docs(spark)
    marks = {r["doc_id"]: r for r in labels.collect()}
    got = [r for r in toxicity.report(toxicity.scored(docs, labels)).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got) and len(got) > 40
    assert np.mean([r["predicted"] == marks[r["doc_id"]]["toxic"] for r in got]) > 0.95
    assert all(r["evidence"] for r in got if r["predicted"])
    got = [r for r in quality.scored(docs, labels).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)
    assert np.mean([r["predicted"] == marks[r["doc_id"]]["quality"] for r in got]) > 0.95


def test_neighbours_are_exact():
    rng = np.random.default_rng(5)
    index = toxicity.Index([f"t{i}".encode() for i in range(40)], rng.uniform(1, 4, 40))
    vectors = [index.vector({int(t): int(rng.integers(1, 5)) for t in rng.choice(40, rng.integers(0, 9), replace=False)}) for _ in range(700)]
    index.build(list(range(700)), rng.integers(0, 2, 700).tolist(), vectors)
    dense = np.zeros((700, 40))
    for row, i in enumerate(index.ids):
        dense[row, vectors[i][0]] = vectors[i][1]
    for v in vectors[:200]:
        q = np.zeros(40)
        q[v[0]] = v[1]
        rows, cosines = index.nearest(*v)
        want = np.sort((dense @ q)[dense @ q > 0])[::-1][: toxicity.NEAR]
        assert np.allclose(cosines, want) and np.allclose((dense @ q)[rows], want)


@pytest.mark.parametrize("some", [True, False])
def test_odd_documents(spark, odd, none, some):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, 1, None), (9, None, 0), (7, 0, 1), (8, 1, 0), (10, 1, 0), (None, 1, 1), (7, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    labels = labels if some else labels.where("false")
    t = toxicity.report(toxicity.scored(odd, labels)).collect()
    q = quality.scored(odd, labels).collect()
    assert len(t) == len(q) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in t + q)
    assert toxicity.scored(none, labels).count() == quality.scored(none, labels).count() == 0
    assert toxicity.without_toxic(odd, labels).columns == odd.columns


def test_calibration_follows_the_prior():
    x = np.concatenate([np.zeros(50), np.ones(50)])
    y = np.concatenate([np.zeros(50), np.ones(50)])
    slope, offset = labelled.logistic(x, y, 0.1)
    assert labelled.squashed(0.0, slope, offset) < 0.5 < labelled.squashed(1.0, slope, offset)
    assert labelled.logistic(x, np.zeros(100), 0.1)[0] == 0.0
    assert labelled.logistic(-x, y, 0.5)[0] == 0.0


def test_long_texts_are_compressed_whole():
    both = quality.Compressors(b"good words and more of them " * 40, b"BAD!! $$$ ### " * 60)
    assert both.difference("good words and more of them " * 5000) > both.difference("BAD!! $$$ ### " * 5000)
    assert both.difference(None) == both.difference("") == 0.0
    assert sum(map(len, quality.pieces("é" * 5000))) == 10_000


def test_score_by_plain_recomputation(spark):
    """Dictionaries, sizes and calibration of op10 computed again from its definition, one text after another."""
    import zstandard

    docs, labels = labelled_docs(spark)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    taught = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    half = {r["id"]: r["h"] for r in spark.createDataFrame([(i,) for i in taught], "id long").selectExpr("id", "pmod(xxhash64(id, 3), 2) as h").collect()}
    cut = lambda t: [t.encode()[i : i + 1024] for i in range(0, len(t.encode()), 1024)]

    def sizes(dictionary, t):
        kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(p)) for p in cut(t))

    good, bad = (quality.dictionary([p for i in sorted(taught) if taught[i] == y and half[i] == 0 for p in cut(text[i])]) for y in (1, 0))
    differ = {i: (sizes(bad, t) - sizes(good, t)) / len(t.encode()) for i, t in text.items()}
    seen = [i for i in sorted(taught) if half[i] == 1]
    slope, offset = labelled.logistic([differ[i] for i in seen], [taught[i] for i in seen], np.mean(list(taught.values())))
    for r in quality.scored(docs, labels).collect():
        assert r["d"] == pytest.approx(differ[r["doc_id"]], abs=2e-2)
        assert r["score"] == pytest.approx(float(labelled.squashed(r["d"], slope, offset)), abs=0.05)


def test_terms_are_all_that_pass_the_test(spark):
    rng = random.Random(12)
    counts = [(f"w{i}".encode(), rng.randrange(40), rng.randrange(90)) for i in range(3000)]
    seen = spark.createDataFrame([(bytearray(w), a, b) for w, a, b in counts], "w binary, a int, b int")
    want = set()
    for w, a, b in counts:
        n1, n0 = 50, 100
        table = np.array([[a, b], [n1 - a, n0 - b]], float)
        expected = table.sum(1, keepdims=True) @ table.sum(0, keepdims=True) / table.sum()
        if (expected > 0).all() and (np.maximum(abs(table - expected) - 0.5, 0) ** 2 / expected).sum() >= toxicity.CHI:
            want.add(w)
    assert {bytes(r["w"]) for r in toxicity.distinctive(seen, 50, 100).collect()} == want and len(want) > 600
