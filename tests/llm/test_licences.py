import re

import pytest
from conftest import frame, prose
from ledgerloom.llm import licences as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = [
    "Released under the MIT License.", "under the MIT licence; under the\nMIT License under the mit license", "Apache License, Version 2.0", "apache license version 20", "CC BY-NC 4.0 and CC-BY-NC", "cc by", "mit mit mit unter the mit",
    "This work is licensed under the GNU General Public License, version 3.", None, "", "...", "ÜNDER the MIT License", "This wor\u212a is licensed", "under the m\u0130t license", "x" + "under the mit license", prose(5, 3000) + " cc by nc " + prose(6, 100), "under the mit license", "under the mit license",
]


def test_against_brute_force(spark):
    df = frame(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])
    got = {r["doc_id"]: r for r in L.report(L.scanned(df)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert got[7]["labels"] == "gpl-3" and got[7]["score"] == pytest.approx(1)
    assert got[6]["labels"] == "" and got[6]["score"] == 0


def test_every_notice_is_found_in_itself(spark):
    df = frame(spark, [(i, f"Before. {n.upper()}, after", "s") for i, (n, _, _) in enumerate(L.NOTICES)])
    for r in L.report(L.scanned(df)).collect():
        assert L.NOTICES[r["doc_id"]][2] in r["labels"].split(",") and r["score"] == pytest.approx(1)


def test_odd_documents(odd, none):
    assert L.report(L.scanned(odd)).count() == odd.count()
    assert L.report(L.scanned(none)).count() == 0
