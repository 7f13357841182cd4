import random

from conftest import CLASHES, frame, prose
from ledgerloom.llm import simhash as S
from test_common import roots


def brute(fps):
    return [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]


def test_links_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centres for _ in range(60)} | {0, (1 << 64) - 1, 1 << 63}
    index = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in brute(sorted(fps))}
    for long in (4096, 3):  # paired, and probed
        got = [(r["u"], r["v"]) for r in S.links(index, long=long).collect()]
        assert sorted(got) == sorted(want)


def test_fingerprint_by_hand():
    import xxhash

    words = [f"W{i}" for i in range(40)]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).lower().encode(), 42) for i in range(38)]
    assert S.fingerprint("  ".join(words)) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 38)
    assert S.fingerprint(None) == S.fingerprint("") == S.fingerprint(" \t") == 0
    assert S.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_odd_documents(spark, odd, none):
    rows = S.groups(odd, "doc_id", "text").collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[2] == {1} and by[3] == by[4] == by[5] == {3} and by[8] == {8}
    assert S.groups(none).count() == 0
    assert S.deduplicated(none).count() == 0


def test_one_of_each_group_stays(spark, odd):
    kept = S.deduplicated(odd)
    assert kept.columns == odd.columns and set(CLASHES) <= set(kept.columns)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    groups = {(r["component_id"], r["fp"]) for r in S.groups(odd).collect()}
    assert len(ids) == len({c if c is not None else f for c, f in groups})
    assert (False, 8) in ids and ids.count((False, 8)) == 1 and (False, 2) not in ids


def test_a_chain_is_one_group(spark):
    base = prose(9, 400).split()
    texts = []
    for i in range(12):
        base = [*base]
        base[i * 20] = f"changed{i}"
        texts.append(" ".join(base))
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    fps = {r["doc_id"]: r["fp"] for r in S.fingerprints(df).collect()}
    linked = roots([(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) & ((1 << 64) - 1)).bit_count() <= 2])
    assert {r["doc_id"]: r["component_id"] for r in S.groups(df).collect()} == {i: linked.get(i, i) for i in fps}
