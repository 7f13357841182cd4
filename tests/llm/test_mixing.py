import heapq

from conftest import frame, prose
from ledgerloom.llm import mixing as M


def filled(sizes, weights=(5, 2, 1)):
    """Targets by giving out shares until nobody is over."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 3 * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= set(over)
        left = sum(sizes.values()) - sum(out.values())
    return out


def check(rows):
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = filled(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own)
        assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in own)


def test_targets_are_met(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE_ROWS", 50)
    monkeypatch.setattr(M, "RANGE_ROWS", 100)
    rows = [(i, prose(i, 1 + i % 37), "hot" if i % 3 else f"s{i % 10}") for i in range(900)] + [(2000, prose(1, 5), "tiny"), (2001, prose(1, 9), "a-small")]
    df = frame(spark, rows)
    got = M.mixed(df).collect()
    assert len(got) == len(rows)
    check(got)
    again = M.mixed(df.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)
    assert M.mix(df).count() == sum(r["copies"] for r in got)


def test_odd_documents(spark, odd, none):
    got = M.mixed(odd).collect()
    assert len(got) == odd.count()
    check(got)
    assert M.mix(odd).columns == odd.columns
    assert M.mixed(none).count() == M.mix(none).count() == 0


def test_no_words_at_all(spark):
    got = M.mixed(frame(spark, [(1, None, "a"), (2, "", "b"), (3, " ", None)])).collect()
    assert [r["taken"] for r in got] == [0, 0, 0]


def queue(rows, budget, weights=(5, 2, 1)):
    """The sources' queues served one by one from a heap, by virtual finish time; rows: source, h, doc_id, size -> copies."""
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    lines = {}
    for k, s in enumerate(sources):
        own = sorted((r["h"], r["doc_id"], r["size"]) for r in rows if r["source"] == s)
        lines[k] = own + [x for _ in range(2) for x in own if x[2]]
    heap, used, out = [], [0] * len(sources), {}
    push = lambda k, at: at < len(lines[k]) and heapq.heappush(heap, ((used[k] + lines[k][at][2]) / weights[k % 3], k, at))
    for k in lines:
        push(k, 0)
    spent = 0
    while heap:
        _, k, at = heapq.heappop(heap)
        size = lines[k][at][2]
        spent += size
        if spent > budget:
            break
        used[k] += size
        out[lines[k][at][1]] = out.get(lines[k][at][1], 0) + 1
        push(k, at + 1)
    return out


def test_as_served_from_a_heap(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE_ROWS", 60)
    monkeypatch.setattr(M, "RANGE_ROWS", 90)
    texts = [(i, "" if i % 11 == 0 else prose(i, 1 + i * i % 43), None if i % 13 == 0 else "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    for share in (1.0, 0.4, 5.0):
        df = frame(spark, texts)
        rows = M.keyed(df, "doc_id", "text", "source", M.SEED).collect()
        want = queue(rows, share * sum(r["size"] for r in rows))
        got = {r["doc_id"]: r["copies"] for r in M.mixed(df, share=share).collect()}
        assert {i: c for i, c in got.items() if c} == want
        assert max(got.values()) <= 3
