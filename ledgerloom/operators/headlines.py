"""Relevance and deduplication of short texts."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that do not tell stories apart, and the negations of the two rules.
STOP = frozenset("the a an and or of to in on for as at by is it its with that this says could would over more us u s".split())
NEGATION = re.compile(r"\b(no|not|never|won't|doesn't)\b", re.IGNORECASE)
LEAST_WORDS, SAME_WORDS = 6, 0.85
SAME_STORY, SAME_STORY_WITH_PHRASE = 0.5, 0.3


def any_of(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def relevant(text: Column, title: Column, allowed: list[str], denied: list[str], softly_denied: list[str], core: list[str]) -> Column:
    """An allowed term and no denied one; a softly denied term needs a core term in the title."""
    return any_of(text, allowed) & ~any_of(text, denied) & (~any_of(text, softly_denied) | any_of(title, core))


def spoken_words(title: str) -> frozenset:
    """Words of three characters or more, links left out."""
    plain = re.sub(r"[^a-z0-9 ]", " ", re.sub(r"https?://\S+", "", title.lower()))
    return frozenset(w for w in plain.split() if len(w) > 2)


def equivalent(a: tuple, b: tuple) -> bool:
    """Syndicated or truncated versions of one title: nearly the same words, and a negation in both or in neither. (words, negated) each."""
    fewest = min(len(a[0]), len(b[0]))
    return a[1] == b[1] and fewest >= LEAST_WORDS and len(a[0] & b[0]) >= SAME_WORDS * fewest


def story_words(title: str) -> list[str]:
    """The telling words, each once, in order."""
    plain = re.sub(r"[^a-z0-9]+", " ", title.lower())
    return list(dict.fromkeys(w for w in plain.split() if len(w) > 2 and w not in STOP))


def whole(title: str) -> str | None:
    """The title without its publisher; None if it is empty or was cut off."""
    t = re.sub(r"\s*[-—–|]\s*[^-—–|]{1,40}$", "", title).strip()
    return None if not t or t.endswith("...") or re.search(r"[,\d]$|\s[a-z]{1,3}$", t) else t


def same_story(a: list[str], b: list[str]) -> bool:
    """Half of the telling words are shared, or fewer and two that follow one another."""
    if not a or not b:
        return False
    overlap = len(set(a) & set(b)) / min(len(a), len(b))
    return overlap >= SAME_STORY or (overlap >= SAME_STORY_WITH_PHRASE and bool(set(zip(a, a[1:])) & set(zip(b, b[1:]))))


def _greedy(rows: DataFrame, block: list[str], order: str, text: str, read: Callable, words: Callable, alike: Callable, usual: Callable) -> DataFrame:
    """A pass in order within each block: what is like an earlier kept one goes.

    Only kept ones that share a word with a title are compared with it, by an index from words to them. A block (a feed's
    day) is one task; a null or empty title has no words and is like none.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, text], ignore_index=True, na_position="last")
        kept, index, stays = [], {}, []
        for t in pdf[text]:
            own = read(t if isinstance(t, str) else "")
            met = {} if own is None else {k for w in words(own) for k in index.get(w, ())}
            new = own is not None and not any(alike(own, kept[k]) for k in met)
            stays.append(new)
            if new:
                for w in words(own):
                    index.setdefault(w, []).append(len(kept))
                kept.append(own)
        return pdf[stays]

    return usual(rows).groupBy(*block).applyInPandas(keep, rows.schema)


def equivalent_once(rows: DataFrame, block: list[str], order: str, text: str) -> DataFrame:
    """Titles that say the same in nearly the same words are kept once. Null titles stay, each."""
    return _greedy(rows, block, order, text, lambda t: (spoken_words(t), bool(NEGATION.search(t))), lambda own: own[0], equivalent, lambda r: r)


def stories_once(rows: DataFrame, block: list[str], order: str, text: str) -> DataFrame:
    """One title a story; null, empty and cut titles go."""
    return _greedy(rows, block, order, text, lambda t: None if whole(t) is None else story_words(whole(t)), lambda own: own, same_story, lambda r: r.where(F.col(text).isNotNull()))
