"""Licence scan by a generalised suffix automaton.

Licence templates (rows of lower-case words) build one automaton. Each text streams through it; after
each word the state tells the longest suffix of the text so far that stands in some template (matching
statistics) and in which templates, and where. Maximal matches are chained in template order, a short gap
of text between two links being allowed; a chain that covers enough of its template labels the span.

Edge cases: a null or empty text, or one without words, has no places, no spans and the score 0; ties
between templates give all of them; repeated rows give repeated results.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

# Words of public licence notices, by label.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
]

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a match that may be a link of a chain; words of text between two links; share of a template that a chain covers.
LINK_WORDS, GAP_WORDS, LEAST_COVER = 4, 12, 0.6


class Automaton:
    """Suffix automaton of several word rows; states know the templates, and where their string first ends in each."""

    def __init__(self, rows: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        tails = []
        for t, row in enumerate(rows):
            last = 0
            for at, word in enumerate(row):
                last = self._extend(last, word)
                self.ends[last].setdefault(t, at)
            tails.append(last)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            into = self.ends[self.link[state]]
            for t, at in self.ends[state].items():
                into[t] = min(at, into.get(t, at))

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of the string of p and word, made by splitting a longer one if need be."""
        q = self.next[p][word]
        if self.length[p] + 1 == self.length[q]:
            return q
        made = self._state(self.length[p] + 1)
        self.next[made] = dict(self.next[q])
        self.link[made] = self.link[q]
        self.link[q] = made
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = made
            p = self.link[p]
        return made

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # this string is known from an earlier row
            return self._split(last, word)
        made, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = made
            p = self.link[p]
        self.link[made] = self._split(p, word) if p >= 0 else 0
        return made

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        rows = [(label, text.split(), True) for label, text in phrases.items()] + [(label, text.split(), False) for label, text in templates]
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w.encode(), len(self.vocabulary)) for w in words] for _, words, _ in rows]
        self.labels = [label for label, _, _ in rows]
        self.sizes = [len(words) for _, words, _ in rows]
        self.auto = Automaton(coded)
        self.shortest = min(min(len(p.split()) for p in phrases.values()), LINK_WORDS)
        goal = {}
        for k, row in enumerate(coded[: len(phrases)]):
            state = length = 0
            for w in row:
                state, length = self.auto.step(state, length, w)
            goal.setdefault(state, []).append((len(row), self.labels[k]))
        self.goals = []  # of each state: the phrases that are suffixes of its strings
        for state in range(len(self.auto.link)):
            found, s = [], state
            while s > 0:
                found += goal.get(s, [])
                s = self.auto.link[s]
            self.goals.append(found)
        self.first_template = len(phrases)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Number of words, (first word, label) of each phrase, (label, first word, last word, covered share) of each chained span."""
        words = WORD.findall((text or "").encode("utf-8", "replace").lower())
        codes = [self.vocabulary.get(w, -1) for w in words]
        n, at = len(codes), 0
        places: list[tuple[int, str]] = []
        matches: list[tuple[int, int, dict[int, int]]] = []  # words before its end, length, templates
        codes.append(-1)
        step, goals, ends = self.auto.step, self.goals, self.auto.ends
        while at < n:
            try:
                while codes[at] < 0:
                    at += 1
            except IndexError:
                break
            stop = codes.index(-1, at)
            if stop - at >= self.shortest:
                state = length = 0
                for i in range(at, stop):
                    before, had = state, length
                    state, length = step(state, length, codes[i])
                    if had >= LINK_WORDS and length <= had:
                        matches.append((i, had, ends[before]))
                    for size, label in goals[state]:
                        if size <= length:
                            places.append((i - size + 1, label))
                if length >= LINK_WORDS:
                    matches.append((stop, length, ends[state]))
            at = stop + 1
        return n, places, self._chains(matches)

    def _chains(self, matches):
        """Matches begin ever later, so a chain whose gap is passed is closed: only those within GAP_WORDS are tried."""
        open_: dict[int, list[list[int]]] = {}  # by template: chains of [first word, end, template end, words covered]
        closed: list[tuple[int, list[int]]] = []
        for end, length, where in matches:
            begin = end - length
            for t, last in where.items():
                if t < self.first_template:
                    continue
                near = []
                for chain in open_.get(t, ()):
                    if begin - chain[1] <= GAP_WORDS:
                        near.append(chain)
                    else:
                        closed.append((t, chain))
                open_[t] = near
                for chain in reversed(near):
                    fresh = min(length, end - chain[1], last - chain[2])
                    if fresh > 0:
                        chain[1], chain[2], chain[3] = end, last, chain[3] + fresh
                        break
                else:
                    near.append([begin, end, last, length])
        closed += [(t, chain) for t, chains in open_.items() for chain in chains]
        done = {(self.labels[t], first, end - 1, covered / self.sizes[t]) for t, (first, end, _, covered) in closed if covered >= LEAST_COVER * self.sizes[t]}
        return sorted(done, key=lambda x: (x[1], x[2], x[0], x[3]))


def scan(df: DataFrame, text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Add n_words, places array<struct<word,label>> (phrases) and license_spans array<struct<label,first_word,last_word,covered>>."""
    place = T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())])
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("covered", T.DoubleType())])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place)), T.StructField("license_spans", T.ArrayType(span))]
    kinds = [common.to_arrow_type(f.dataType) for f in fields]

    def make():
        scanner = Scanner(phrases, templates)

        def work(columns):
            found = [scanner.scan(t) for t in columns[0].to_pylist()]
            return [
                pa.array([x[0] for x in found], kinds[0]),
                pa.array([[dict(word=w, label=k) for w, k in x[1]] for x in found], kinds[1]),
                pa.array([[dict(label=k, first_word=a, last_word=b, covered=c) for k, a, b, c in x[2]] for x in found], kinds[2]),
            ]

        return work

    return common.append_arrow(df, [text_col], make, fields)
