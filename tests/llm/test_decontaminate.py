import hashlib
import re

import pytest
from conftest import frame, prose
from ledgerloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    known = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            known.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for d, t, _ in docs:
        w, hit, found = low(t), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if x := known.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [D.BLOCK_CHARS, 300])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_CHARS", block)
    items = [(1, prose(20, 25)), (2, prose(21, 12)), (3, "short ITEM, Ünï"), (4, ""), (5, None), (6, prose(20, 25)), (11, prose(22, 10))]
    docs = [
        (1, prose(30, 20) + ". " + prose(20, 25).upper() + "! " + prose(31, 20), "s"), (2, prose(21, 12)[3:], "s"), (3, "a short, item -- ünï b", "s"), (4, "a Short item Ünï", "s"), (5, None, "s"), (6, "", "s"),
        (7, " ".join(prose(20, 25).split()[4:16]) + " x " + " ".join(prose(20, 25).split()[:10]), "s"), (7, prose(22, 10) * 1 + "z", "s"), (8, prose(22, 10) + " " + prose(22, 10), "s"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in D.report(D.contamination(frame(spark, docs), bench)).collect()]
    assert sorted(got) == sorted(brute(docs, items))


def test_spans_lead_back_to_the_original(spark):
    passage = prose(40, 11)
    text = f"É first, {passage.replace(' ', ' -- ').title()}; after"
    found = D.contamination(frame(spark, [(1, text, "s")]), spark.createDataFrame([(1, passage)], "item_id long, text string"), with_spans=True).first()
    (span,) = found["spans"]
    assert low(text.encode()[span["a"] : span["b"]].decode()) == passage.split()


def test_odd_documents(spark, odd, none):
    bench = spark.createDataFrame([(1, prose(2, 60)), (None, prose(4, 40))], "item_id long, text string")
    kept = D.decontaminate(odd, bench)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 8, 9]
    assert D.decontaminate(none, bench).count() == 0
    assert D.decontaminate(odd, bench.where("false")).count() == odd.count()


def test_a_large_benchmark_passes_in_blocks(spark, monkeypatch):
    items = [(i, prose(100 + i, 14)) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_CHARS", 2000)
    blocks = list(D.blocks_of(D.patterns(bench)))
    assert len(blocks) > 3 and [last for last, _ in blocks] == [False] * (len(blocks) - 1) + [True]
    assert sorted(w for _, b in blocks for w in b) == sorted({w.decode() for _, t in items for w in D.windows(D.words(t))})
    docs = [(i, prose(200 + i, 9) + " " + prose(100 + i, 14) + " " + prose(300 + i, 9), "s") for i in range(0, 60, 4)]
    got = [tuple(r) for r in D.report(D.contamination(frame(spark, docs), bench)).collect()]
    assert sorted(got) == sorted(brute(docs, items)) and sum(r[5] for r in got) == 8
