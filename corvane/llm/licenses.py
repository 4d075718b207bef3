"""Licence scans with a positional index of rare words; DataFrame functions only.

Templates are licence notices of some twenty to fifty words with mandatory key phrases, and short phrases that must
stand as they are. A notice is filed under its highest-IDF words with their places in it, so many of them that a text
that has SHARE of its words in place must have one of the filed ones; a phrase is filed under its rarest word. A text's
words are looked up once. Each place of a filed word proposes a start, the place less the word's own in the template;
starts are intersected over the filed words of a template, the key phrases are verified from there, and the share of
the template's words that stand in place decides. Words put in or left out end the alignment; changed ones don't.

Texts don't move; the only shuffle sums document frequencies of the templates' words, some hundred rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: The method's own phrases, a label and the phrases that all must be found.
TEMPLATES = [
    ("apache-2.0", ("apache license version 2 0",)),
    ("bsd", ("redistribution and use in source and binary forms",)),
    ("cc-by-nc", ("cc by nc",)),
    ("cc-by-sa", ("cc by sa",)),
    ("cc0", ("cc0 1 0",)),
    ("gpl-3", ("gnu general public license", "version 3")),
    ("mit", ("mit license",)),
    ("mpl-2.0", ("mozilla public license",)),
]
#: Licence notices, each with its label and the key phrases that must stand at their places.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("public domain",)),
]
#: Percent of a notice's words that must stand in place.
SHARE = 80
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Phrase:
    text: str
    words: tuple[str, ...]
    anchor: int


def words_of(text: Column) -> Column:
    """The words of a whole text, A-Z lower-cased; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), lambda w: w != "")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts each of the phrases' words stands; one row for each such word."""
    listed = F.array(*[F.lit(w) for w in vocabulary])
    held = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), listed)).alias("word"))
    return {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def phrases(texts: list[str], frequency: dict[str, int]) -> list[Phrase]:
    """Each phrase with the place of its rarest word (the first in alphabetical order, then in place, of those as rare)."""
    out = []
    for text in dict.fromkeys(texts):
        words = tuple(text.split())
        out.append(Phrase(text, words, min(range(len(words)), key=lambda i: (frequency.get(words[i], 0), words[i], i))))
    return out


@dataclass(frozen=True)
class Notice:
    """A notice's words, its key phrases with their places, and the places of the words it is filed under."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]
    filed: tuple[int, ...]


def notices(texts: list[tuple[str, str, tuple[str, ...]]], frequency: dict[str, int]) -> list[Notice]:
    """Notices filed under their rarest places: one more than the words that may differ, so that no match is missed."""
    out = []
    for label, text, keys in texts:
        words = tuple(text.split())
        at = tuple((next(i for i in range(len(words)) if words[i : i + len(k)] == k), k) for k in (tuple(k.split()) for k in keys))
        most = len(words) - -(-SHARE * len(words) // 100)
        out.append(Notice(label, words, at, tuple(sorted(range(len(words)), key=lambda i: (frequency.get(words[i], 0), words[i], i))[: most + 1])))
    return out


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, tuple[str, ...]]] = TEMPLATES, texts: list[tuple[str, str, tuple[str, ...]]] = NOTICES) -> DataFrame:
    """Licence phrases and notices in whole texts; one row for each row of docs(doc_id, text, ...), other columns ignored.

    doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and largest start,
    words from 0; null without), base_labels and labels (distinct, sorted, joined by commas; empty without), score
    (the largest share of a found template's words that stand in place: 1 for a phrase; 0 where nothing is found).
    A null text has no words; repeated rows give a row each.
    """
    key = [p for _, ps in templates for p in ps]
    listed = [p for p, _ in base] + key
    frequency = document_frequencies(docs, sorted({w for t in [*listed, *(t for _, t, _ in texts)] for w in t.split()}))
    filed, longer = phrases(listed, frequency), notices(texts, frequency)
    anchors = sorted({p.words[p.anchor] for p in filed} | {n.words[i] for n in longer for i in n.filed})
    rows = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    at = F.filter(F.transform("w", lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "w", at.alias("at"))
    stand = lambda i, words: F.slice("w", i + 1, len(words)) == F.array(*[F.lit(x) for x in words])

    def places(p: Phrase) -> Column:
        anchor = p.words[p.anchor]
        there = F.filter("at", lambda i: (F.get("w", i) == anchor) & (i >= p.anchor))
        return F.transform(F.filter(there, lambda i: stand(i - p.anchor, p.words)), lambda i: i - p.anchor)

    def shares(x: Notice) -> Column:
        """The share of words in place of each start from which the key phrases and enough words stand."""
        n = len(x.words)

        def starts_by(k: int) -> Column:
            return F.transform(F.filter("at", lambda i: F.get("w", i) == x.words[k]), lambda i: i - k)

        proposed = F.flatten(F.array(*map(starts_by, x.filed)))

        def verified(i: Column) -> Column:
            ok = (i >= 0) & (i + n <= F.size("w"))
            for k, phrase in x.keys:
                ok = ok & stand(i + k, phrase)
            return ok

        same = lambda i: F.size(F.filter(F.zip_with(F.slice("w", i + 1, n), F.array(*[F.lit(w) for w in x.words]), lambda a, b: a == b), lambda e: e))
        counts = F.transform(F.filter(F.array_distinct(proposed), verified), same)
        return F.transform(F.filter(counts, lambda c: c * 100 >= SHARE * n), lambda c: c / n)

    # of most texts no filed word is in the words, and nothing is left to verify
    some = F.size("at") > 0
    found = F.when(some, F.map_from_arrays(F.array(*[F.lit(p.text) for p in filed]), F.array(*[places(p) for p in filed])))
    aligned = F.when(some, F.array(*[F.array_max(shares(x)) for x in longer])) if longer else F.lit(None).cast("array<double>")
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), found.alias("found"), aligned.alias("aligned"))
    of = lambda t: F.coalesce(F.element_at("found", t), F.array().cast("array<int>"))
    has = lambda t: F.size(of(t)) > 0
    starts = F.flatten(F.array(*[of(p) for p, _ in base]))
    any_phrase = F.when(F.exists(F.map_values("found"), lambda x: F.size(x) > 0), 1.0)

    def joined(pairs: list[tuple[str, Column]]) -> Column:
        names = F.array(*[F.when(given, F.lit(label)) for label, given in pairs])
        return F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))), ",")

    base_pairs = [(label, has(p)) for p, label in base]
    own = []
    for label, ps in templates:
        given = has(ps[0])
        for p in ps[1:]:
            given = given & has(p)
        own.append((label, given))
    own += [(x.label, F.get("aligned", F.lit(k)).isNotNull()) for k, x in enumerate(longer)]
    return rows.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base_pairs).alias("base_labels"), joined(base_pairs + own).alias("labels"), F.coalesce(any_phrase, F.array_max("aligned"), F.lit(0.0)).alias("score"),
    )
