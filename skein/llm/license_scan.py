"""Operator 3: license scans by a positional rare-token index.

Document frequencies of the templates' words are counted over all texts. For a file, its license words of highest
IDF are looked up in the templates' postings; postings that agree on a relative position make a candidate, and a
candidate counts only if the template's mandatory phrase stands in the file there.

Defined results: a null or empty text has no words; labels are sorted by code point, each once; first_word and
last_word are null without a base phrase; score is the best share of a template's words at their places, at least 0.5
for a base label (0 without labels); an empty table gives an empty one; repeated rows give a row each, a null doc_id
stays null; other columns are not looked at, so their names cannot clash. Texts are scanned whole; time grows with the
number of words and of license words in them.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import arrow_map, ascii_lower, doc_texts, small_batches

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Statements, titles and paragraphs of licenses, each with the phrase that must stand in the file.
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "under the apache license version 2 0"),
    ("apache-2.0", "apache license version 2 0 january 2004", "apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("artistic-2.0", "the artistic license 2 0", "artistic license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "may be used to endorse or promote products derived from this software"),
    ("bsl-1.0", "boost software license version 1 0", "boost software license"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy of the software"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-sa-4.0", "creative commons attribution noncommercial sharealike 4 0 international license", "attribution noncommercial sharealike 4 0"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-by-nc-nd-4.0", "creative commons attribution noncommercial noderivatives 4 0 international license", "attribution noncommercial noderivatives 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("cc-by-nd-4.0", "creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("cc-by-sa-3.0", "creative commons attribution sharealike 3 0 unported license", "creative commons attribution sharealike 3 0"),
    ("cc0-1.0", "released under the creative commons zero cc0 1 0 public domain dedication", "cc0 1 0"),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("epl-2.0", "eclipse public license version 2 0", "eclipse public license"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2.0", "terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3.0", "terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("isc", "the isc license", "isc license"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", "lesser general public license version 2 1"),
    ("lgpl-2.1", "gnu lesser general public license v2 1", "lesser general public license v2 1"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", "lesser general public license version 3"),
    ("lgpl-3.0", "gnu lesser general public license v3", "lesser general public license v3"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "the mit license mit", "mit license"),
    ("mit", "mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one", "mozilla public license v 2 0"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("unlicense", "the unlicense", "the unlicense"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages"),
)
#: Titles, each wholly mandatory.
TITLES = (
    ("agpl-3.0", "gnu affero general public license version 3"), ("bsd", "bsd 2 clause license"), ("bsd", "2 clause bsd license"), ("bsd-3-clause", "bsd 3 clause license"), ("bsd-3-clause", "3 clause bsd license"),
    ("gpl-2.0", "gnu general public license version 2 june 1991"), ("gpl-3.0", "gnu general public license version 3 29 june 2007"), ("gpl-2.0", "gnu gpl version 2"), ("gpl-3.0", "gnu gpl version 3"), ("gpl-2.0", "gnu gpl v2"), ("gpl-3.0", "gnu gpl v3"),
    ("lgpl-3.0", "gnu lesser general public license version 3"), ("mpl-2.0", "mozilla public license version 2 0"), ("mpl-2.0", "mozilla public license 2 0"), ("epl-1.0", "eclipse public license v 1 0"), ("artistic-2.0", "artistic license version 2 0"),
    ("mit", "mit or apache 2 0"), ("apache-2.0", "mit or apache 2 0"), ("mit", "apache 2 0 or mit"), ("apache-2.0", "apache 2 0 or mit"),
)
TEMPLATES += tuple((label, title, title) for label, title in TITLES)
#: Identifiers that stand behind "SPDX-License-Identifier:", in words, and what they are called here.
IDENTIFIERS = (
    ("agpl 3 0", "agpl-3.0"), ("apache 2 0", "apache-2.0"), ("artistic 2 0", "artistic-2.0"), ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd-3-clause"), ("bsl 1 0", "bsl-1.0"),
    ("cc by 4 0", "cc-by-4.0"), ("cc by nc 4 0", "cc-by-nc-4.0"), ("cc by nc nd 4 0", "cc-by-nc-nd-4.0"), ("cc by nc sa 4 0", "cc-by-nc-sa-4.0"), ("cc by nd 4 0", "cc-by-nd-4.0"), ("cc by sa 4 0", "cc-by-sa-4.0"), ("cc0 1 0", "cc0-1.0"), ("epl 2 0", "epl-2.0"), ("gpl 2 0", "gpl-2.0"), ("gpl 3 0", "gpl-3.0"), ("isc", "isc"),
    ("lgpl 2 1", "lgpl-2.1"), ("lgpl 3 0", "lgpl-3.0"), ("mit", "mit"), ("mpl 2 0", "mpl-2.0"), ("unlicense", "unlicense"), ("zlib", "zlib"),
)
SPDX = ("spdx", "license", "identifier")
TEMPLATES += tuple((label, f"{' '.join(SPDX)} {x}", f"{' '.join(SPDX)} {x}") for x, label in IDENTIFIERS)
TEMPLATES += tuple((label, f"licensed under {the}{x}", f"under {the}{x}") for x, label in IDENTIFIERS for the in ("", "the "))
RARE, MIN_AGREE, MIN_SCORE = 4, 0.5, 0.6

_VOCAB = frozenset(w for _, t, _ in TEMPLATES for w in t.split())
_BASE = [(tuple(p.split()), label) for p, label in BASE]
_TEMPLATES = [(label, tuple(t.split()), tuple(k.split())) for label, t, k in TEMPLATES]
#: A label of either kind needs a base or a mandatory phrase in the text, so all words of one.
_NEEDED = sorted({frozenset(p) for p, _ in _BASE} | {frozenset(k) for _, _, k in _TEMPLATES}, key=sorted)
#: Identifiers as words, longest first, and the words that join them or say more about the one before.
_BY_LENGTH = sorted(((tuple(x.split()), label) for x, label in IDENTIFIERS), key=lambda x: (-len(x[0]), x))
_JOINS, _SAYS_MORE = ("or", "and"), (("or", "later"), ("only",))
_WANTED = _VOCAB.union(*_NEEDED)
_POSTINGS: dict[str, dict[int, list[int]]] = defaultdict(dict)  # word -> template -> its places there
for _t, (_, _words, _) in enumerate(_TEMPLATES):
    for _p, _w in enumerate(_words):
        _POSTINGS[_w].setdefault(_t, []).append(_p)


def words_of(text: str) -> list[str]:
    return WORD.findall(ascii_lower(text))


def frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of texts, and for each word of the templates (a fixed vocabulary) how many texts have it."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        seen: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                seen.update(_VOCAB.intersection(words_of(text)))
                seen[""] += 1
        if seen:
            yield {"word": list(seen), "n": list(seen.values())}

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    got = {r["word"]: r["n"] for r in arrow_map(docs, rows, schema).groupBy("word").agg(F.sum("n").alias("n")).limit(len(_VOCAB) + 1).collect()}
    return got.pop("", 0), got


def _stands(words: list[str], phrase: tuple[str, ...], at: int) -> bool:
    return at >= 0 and tuple(words[at : at + len(phrase)]) == phrase


def expression(words: list[str], at: int) -> set[str]:
    """Labels of the identifiers of an SPDX expression that begins at a word: joined by or and and, exceptions passed over."""
    found: set[str] = set()
    while True:
        own = next(((x, label) for x, label in _BY_LENGTH if tuple(words[at : at + len(x)]) == x), None)
        if own is None:
            return found
        found.add(own[1])
        at += len(own[0])
        at += next((len(x) for x in _SAYS_MORE if tuple(words[at : at + len(x)]) == x), 0)
        if words[at : at + 1] == ["with"]:  # an exception's name of a few words, up to the next join
            at = next((i for i in range(at + 1, min(at + 7, len(words))) if words[i] in _JOINS), len(words))
        if at >= len(words) or words[at] not in _JOINS:
            return found
        at += 1


def scan(words: list[str], idf: dict[str, float]) -> tuple[list[int], set[str], set[str], float]:
    """Starts of all base phrases, base labels, the method's labels, score."""
    wanted = _WANTED.intersection(words)
    if not any(phrase <= wanted for phrase in _NEEDED):
        return [], set(), set(), 0.0
    there = _VOCAB & wanted
    places: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        if w in wanted:
            places[w].append(i)
    starts, base = [], set()
    for phrase, label in _BASE:
        at = [i for i in places.get(phrase[0], ()) if _stands(words, phrase, i)]
        starts += at
        if at:
            base.add(label)
    rare = sorted(there, key=lambda w: (-idf.get(w, 0.0), w))
    found: dict[str, float] = {}
    chosen: dict[int, list[str]] = defaultdict(list)  # a template's rarest words that the file has
    for w in rare:
        for t in _POSTINGS[w]:
            if len(chosen[t]) < RARE:
                chosen[t].append(w)
    for t, mine in sorted(chosen.items()):
        label, template, mandatory = _TEMPLATES[t]
        if not wanted.issuperset(mandatory):
            continue
        offsets: Counter = Counter()  # votes for where the template would begin
        for w in mine:
            offsets.update({i - p for p in _POSTINGS[w][t] for i in places[w]})
        best = 0.0
        for at, votes in offsets.items():
            if votes < MIN_AGREE * len(mine) and votes < 2:
                continue
            share = sum(0 <= at + p < len(words) and words[at + p] == w for p, w in enumerate(template)) / len(template)
            if share > best and any(_stands(words, mandatory, at + p) for p in range(-2, len(template) - len(mandatory) + 3)):
                best = share
        if best >= MIN_SCORE:
            found[label] = max(best, found.get(label, 0.0))
    for i in places.get(SPDX[0], ()):
        if _stands(words, SPDX, i):
            found |= {label: 1.0 for label in expression(words, i + len(SPDX))}
    score = max([*found.values(), 0.5 if base else 0.0])
    return starts, base, set(found), score


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    small_batches(docs.sparkSession)
    texts = doc_texts(docs)
    n, df = frequencies(texts)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in sorted(_VOCAB)}

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for text in b["text"]:
                words = words_of(text)
                starts, base, more, score = scan(words, idf)
                made = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score)
                for k, v in zip(out, made, strict=True):
                    out[k].append(v)
            yield {"doc_id": b["doc_id"]} | out

    kinds = {"base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType()}
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return arrow_map(texts, rows, T.StructType([T.StructField(k, kinds.get(k, T.LongType())) for k in names]))
