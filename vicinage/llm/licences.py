"""Licence scans by a positional index of rare words.

Phrases and notices of licences are templates; the index has, for each of their words, the templates and places
that it stands at. A first scan counts in how many documents each of these words is. The second looks a document's licence
words up, the one with the highest inverse document frequency first, and intersects their postings by
relative position: words of a template stand in the document at one distance from its start. What is left is
weighed on all words of the template, and its mandatory key phrases are verified word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vicinage.llm.tables import text_of

#: Byte values that words consist of once A-Z are lower-cased; all others separate.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STRETCH = 1 << 20  # bytes whose words are listed at once

RARE = 8  # words of a notice, of the highest inverse document frequency, whose postings are intersected
DRIFT = 3  # words that an edit may move the rest of a notice by
COVERED = 0.75  # share of a notice's words, weighed by inverse document frequency, that must stand in place


class Template(NamedTuple):
    """A label and its words. With phrases it is a notice, found up to small edits if all of the phrases stand in it; without, every word must stand in its place."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()


#: Phrases that make the base labels.
PHRASES = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)

#: Names, short notices and key sentences of public licences.
NOTICES = (
    Template("agpl", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl-2.0", "mozilla public license version 2 0"),
    Template("cc-by-4.0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "cc by nc 4 0"),
    Template("cc-by-nd-4.0", "cc by nd 4 0"),
    Template("cc0-1.0", "cc0 1 0 universal"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template(
        "apache-2.0",
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        ("except in compliance with the license", "without warranties or conditions of any kind"),
    ),
    Template(
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ("terms of the gnu general public license", "version 2 of the license"),
    ),
    Template(
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("terms of the gnu general public license", "version 3 of the license"),
    ),
    Template(
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    Template(
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("to endorse or promote products derived from this software",),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted", "appear in all copies"),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        ("subject to the terms of the mozilla public license v 2 0",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        ("free and unencumbered software released into the public domain",),
    ),
)


def words_of(data: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text in UTF-8, in stretches: the number of words before, and those of the stretch."""
    begin, seen = 0, 0
    while begin < len(data):
        end = begin + STRETCH
        while end < len(data) and LOWERED[data[end]] != 32:
            end += 1
        found = data[begin:end].translate(LOWERED).split()
        yield seen, found
        seen, begin = seen + len(found), end


def listed(text: str) -> list[bytes]:
    return [w for _, words in words_of(text.encode()) for w in words]


class Entry:
    """A template in the index: words and their places, the rare ones that find it, and how many of these must agree."""

    def __init__(self, template: Template, idf: dict[bytes, float]):
        self.label, self.words, self.exact = template.label, listed(template.text), not template.phrases
        self.phrases = [listed(p) for p in template.phrases]
        self.weight = np.array([idf[w] for w in self.words])
        ranked = sorted(range(len(self.words)), key=lambda q: (-self.weight[q], q))
        self.rare = ranked if self.exact else ranked[:RARE]
        self.needed = len(self.rare) if self.exact else (len(self.rare) + 1) // 2
        self.drift = 0 if self.exact else DRIFT


def near(places: np.ndarray, wanted: np.ndarray, drift: int) -> np.ndarray:
    """Whether any of the sorted places is within the drift of each of the wanted ones."""
    return np.searchsorted(places, wanted - drift) < np.searchsorted(places, wanted + drift, side="right")


class Index:
    """Postings of all templates' words. idf: of each of these words."""

    def __init__(self, phrases: tuple[Template, ...], notices: tuple[Template, ...], idf: dict[bytes, float]):
        self.idf = idf
        self.entries = [Entry(t, idf) for t in (*phrases, *notices)]
        self.base = len(phrases)
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, e in enumerate(self.entries):
            for q in e.rare:
                self.postings.setdefault(e.words[q], []).append((t, q))
        #: A match has one of these words: of those that an entry needs, one is among the first ones.
        self.gate = frozenset(e.words[q] for e in self.entries for q in e.rare[: len(e.rare) - e.needed + 1])

    def scan(self, data: bytes) -> tuple[int, list[tuple[str, int, int, float, bool]]]:
        """Number of words of a text, and (label, start, length, coverage, whether of a phrase) of what is found."""
        held: dict[bytes, list[int]] = {}
        count, idf = 0, self.idf
        for before, words in words_of(data):
            count = before + len(words)
            if len(data) <= STRETCH and self.gate.isdisjoint(words):  # the whole text is here, and no word that a match has
                continue
            for k, w in enumerate(words, before):
                if w in idf:
                    held.setdefault(w, []).append(k)
        return count, self.found({w: np.array(p) for w, p in held.items()})

    def found(self, places: dict[bytes, np.ndarray]) -> list[tuple[str, int, int, float, bool]]:
        agreeing: dict[int, list[int]] = {}  # by template: places in it of the document's words, the rarest first
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            for t, q in self.postings.get(w, ()):
                agreeing.setdefault(t, []).append(q)
        out = []
        for t, ranked in sorted(agreeing.items()):
            e = self.entries[t]
            if len(ranked) < e.needed:
                continue
            starts = np.unique(np.concatenate([places[e.words[q]] - q for q in ranked[: len(ranked) - e.needed + 1]]))
            votes = np.zeros(len(starts), np.int64)
            for q in ranked:
                votes += near(places[e.words[q]], starts + q, e.drift)
            starts = starts[votes >= e.needed]
            weight = np.zeros(len(starts))
            for q, w in enumerate(e.words):
                if w in places:
                    weight += e.weight[q] * near(places[w], starts + q, e.drift)
            coverage = np.ones(len(starts)) if e.exact else weight / e.weight.sum()
            keep = coverage >= COVERED
            for phrase in e.phrases:
                keep &= self.holds(phrase, places, starts, len(e.words), e.drift)
            for start, share in self.apart(starts[keep], coverage[keep], 2 * e.drift):
                out.append((e.label, start, len(e.words), share, t < self.base))
        return out

    @staticmethod
    def holds(phrase: list[bytes], places: dict[bytes, np.ndarray], starts: np.ndarray, length: int, drift: int) -> np.ndarray:
        """Whether the phrase stands, word by word, in the stretch of a template that begins at each start."""
        if any(w not in places for w in phrase):
            return np.zeros(len(starts), bool)
        whole = places[phrase[0]]
        for q, w in enumerate(phrase):
            whole = whole[near(places[w], whole + q, 0)]
        return np.searchsorted(whole, starts - drift) < np.searchsorted(whole, starts + length - len(phrase) + drift, side="right")

    @staticmethod
    def apart(starts: np.ndarray, coverage: np.ndarray, gap: int) -> Iterator[tuple[int, float]]:
        """Of starts that follow within the gap the one that covers most, the first of several."""
        if not gap:
            yield from zip(starts.tolist(), coverage.tolist())
            return
        cuts = np.flatnonzero(np.diff(starts) > gap) + 1
        for run in np.split(np.arange(len(starts)), cuts):
            if len(run):
                best = run[np.argmax(coverage[run])]
                yield int(starts[best]), float(min(1.0, coverage[best]))


def inverse_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, float]:
    """Inverse document frequency over all documents of each word of a vocabulary; the answer is as large as the vocabulary."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, dict.fromkeys(vocabulary, 0)
        for b in batches:
            total += len(b)
            for text in b.column("text").cast(pa.large_binary()):
                for w in set().union(*(vocabulary.intersection(words) for _, words in words_of(text.as_py()))):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.binary()), pa.array([total, *seen.values()], pa.int64())], ["word", "n"])

    found = docs.select(text_of().alias("text")).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in found}
    total = counts.pop(None, 0)
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1 for w in vocabulary}


def scan_licences(docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, found (array of label, start, length, coverage, phrase).

    Words are what separators leave of the text with A-Z in lower case; start counts them from 0. Every place of
    a phrase and of a template without key phrases is found, overlapping ones too; notices with key phrases are found up to small edits,
    once for each stretch. Null texts count as empty: no words, nothing found. Rows are independent: repeated rows and null ids
    give rows of their own, other columns are not read, an empty table gives no rows. Texts of any length are
    read as a whole, in stretches. Two scans, without a shuffle of rows.
    """
    vocabulary = frozenset(w for t in (*phrases, *notices) for text in (t.text, *t.phrases) for w in listed(text))
    index = Index(phrases, notices, inverse_frequencies(docs, vocabulary))
    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int32()), ("coverage", pa.float64()), ("phrase", pa.bool_())])
    names = [place.field(k).name for k in range(place.num_fields)]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found = [], []
            for text in b.column("text").cast(pa.large_binary()):
                n, hits = index.scan(text.as_py())
                counts.append(n)
                found.append([dict(zip(names, h)) for h in hits])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(place))], ["doc_id", "n_words", "found"])

    rows = docs.select("doc_id", text_of().alias("text"))
    fields = StructType.fromDDL("n_words long, found array<struct<label: string, start: long, length: int, coverage: double, phrase: boolean>>").fields
    return rows.mapInArrow(scanned, StructType([rows.schema["doc_id"], *fields]))


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of what scan_licences gives.

    n_base counts all places of phrases, first_word and last_word are their smallest and largest start, or null. Labels
    are distinct, sorted and joined by commas, empty if there are none; score is the largest coverage, or 0.
    """
    base = F.filter("found", lambda x: x["phrase"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
    start: Column = F.transform(base, lambda x: x["start"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["coverage"])), F.lit(0.0)).alias("score"),
    )
