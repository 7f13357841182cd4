"""License scans (7), native: a positional rare-token index over licence templates.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A template is the words
of a notice, of which a key phrase is mandatory. The document frequency of every template word is
counted over the whole corpus; the index posts each template under the rarest word of its key, with
the word's position. A file's words that are posted give candidates (template, start); the key's next
rarest words are intersected at their relative positions, the whole key is verified word by word, and
the rest of the notice, weighed by idf, gives the match's share. Every occurrence of a key holds its
rarest word, so the look-up loses none.

A file is scanned in its own row: nothing is exploded or shuffled but the counts of template words.
The base phrases are templates too, whose key is the whole phrase; their places are what n_base,
first_word, last_word and base_labels tell. The other templates add labels.

Defined cases: null and empty texts have no words and no labels; repeated rows are scanned each;
overlapping places all count; an empty table gives no rows.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 3

#: Phrase and label of the base.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Notice, its mandatory key phrase, label. Wording of the public licences.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license version 2", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gnu general public license version 2", "gpl-2"),
    ("this library is free software under the gnu lesser general public license", "gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "gnu affero general public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software", "isc"),
    ("this is free and unencumbered software released into the public domain", "free and unencumbered software", "unlicense"),
    ("made available under the eclipse public license", "eclipse public license", "epl"),
    ("distributed under the boost software license version 1 0", "boost software license", "bsl-1"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc by 4", "cc-by"),
    ("creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution 4 0 international license", "creative commons attribution 4", "cc-by"),
    ("dedicated to the public domain under cc0 1 0 universal", "cc0 1 0", "cc0"),
]


def templates(base=BASE, notices=NOTICES) -> list[dict]:
    out = [{"words": p.split(), "at": 0, "key": p.split(), "label": label, "base": True} for p, label in base]
    for notice, key, label in notices:
        words, k = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        out.append({"words": words, "at": at, "key": k, "label": label, "base": False})
    return out


def normalised(text: Column) -> Column:
    """The words joined by one space; of letters only A-Z are lower-cased."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), SEPARATORS, " "))


def frequencies(line: Column, documents: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and documents per template word; one row a word reaches the driver."""
    known = F.array(*map(F.lit, vocabulary))
    words = documents.select(F.explode(F.array_append(F.array_intersect(F.split(line, " "), known), F.lit(""))).alias("w"))
    found = {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return found.pop("", 0), found


def _array(items: list[str]) -> str:
    return f"array({', '.join(items)})"


def scanned(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """doc_id, n_words and found, the matches: template, start and key_start (words from 0), share, label, base."""
    known = templates(base, notices)
    vocabulary = sorted({w for t in known for w in t["words"]})
    n, df = frequencies(normalised(F.col(text)), documents, vocabulary)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    posted, structs = [], []
    for i, t in enumerate(known):
        rare = sorted(range(len(t["key"])), key=lambda k: (-idf[t["key"][k]], k))[:RARE]
        posted.append((t["key"][rare[0]], i, t["at"] + rare[0]))
        total = sum(idf[w] for w in t["words"])
        structs.append(
            "named_struct("
            f"'words', {_array([repr(w) for w in t['words']])}, 'weights', {_array([f'{idf[w] / total!r}D' for w in t['words']])}, 'at', {t['at']}, 'key', {_array([repr(w) for w in t['key']])}, "
            f"'rare', {_array([f'named_struct({chr(39)}w{chr(39)}, {t["key"][k]!r}, {chr(39)}o{chr(39)}, {t["at"] + k})' for k in rare[1:]] or ['named_struct(' + repr('w') + ', ' + repr(t['key'][0]) + ', ' + repr('o') + f', {t["at"]})'])}, "
            f"'label', {t['label']!r}, 'base', {str(t['base']).lower()})"
        )
    index = _array([f"named_struct('w', {w!r}, 't', {i}, 'o', {o})" for w, i, o in posted])
    leads = sorted({w for w, _, _ in posted})
    d = documents.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("line"))
    d = d.withColumn("n_words", F.expr("if(line = '', 0L, cast(length(line) - length(replace(line, ' ', '')) + 1 as long))"))
    some = " or ".join(f"contains(concat(' ', line, ' '), ' {w} ')" for w in leads)
    d = d.withColumn("words", F.expr(f"if({some}, split(line, ' '), cast(array() as array<string>))")).drop("line")
    # look up: words that are posted, with their positions
    d = d.withColumn("hits", F.expr(f"filter(transform(words, (w, i) -> if(w in ({', '.join(map(repr, leads))}), named_struct('w', w, 'i', i), null)), h -> h is not null)"))
    starts = f"flatten(transform(hits, h -> transform(filter({index}, p -> p.w = h.w), p -> named_struct('t', p.t, 's', h.i - p.o))))"
    d = d.withColumn("starts", F.expr(starts))
    # intersect at relative positions, then verify the key
    known_ = _array(structs)
    same = "forall(x.k.rare, r -> get(words, x.s + r.o) <=> r.w) and x.s + x.k.at >= 0 and slice(words, greatest(x.s + x.k.at, 0) + 1, size(x.k.key)) = x.k.key"
    d = d.withColumn("kept", F.expr(f"filter(transform(starts, c -> named_struct('t', c.t, 's', c.s, 'k', element_at({known_}, c.t + 1))), x -> {same})"))
    share = "aggregate(sequence(0, size(x.k.words) - 1), 0D, (a, j) -> a + if(get(words, x.s + j) <=> get(x.k.words, j), get(x.k.weights, j), 0D))"
    found = f"transform(kept, x -> named_struct('template', x.t, 'start', x.s, 'key_start', cast(x.s + x.k.at as long), 'share', least(1D, {share}), 'label', x.k.label, 'base', x.k.base))"
    return d.select("doc_id", "n_words", F.expr(found).alias("found"))


def report(found: DataFrame) -> DataFrame:
    base = "transform(filter(found, x -> x.base), x -> x.key_start)"
    return found.select(
        "doc_id", "n_words", F.expr(f"cast(size({base}) as long)").alias("n_base"),
        F.expr(f"array_min({base})").alias("first_word"), F.expr(f"array_max({base})").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(filter(found, x -> x.base), x -> x.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(found, x -> x.label))), ',')").alias("labels"),
        F.expr("coalesce(array_max(transform(found, x -> x.share)), 0D)").alias("score"),
    )
