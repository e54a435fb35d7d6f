"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of all templates. A text streams through it and gives, at each word, the
longest run of template words that ends there (matching statistics). Maximal matches that are long for their
template are chained, in order of both text and template, into the span of the template that they cover.
Phrases of a fixed list are found in the same stream: a phrase ends at a word if the match there is at least as
long and the phrase's state is the current one or one of its suffix links.

A task keeps one text at a time. Only the stated templates go to the executors.

Defined cases: null texts are empty; a text without words has no labels, null places and score 0. Repeated rows
are scanned as often as they occur.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices as they are usually written, by label.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "reserved": ("All rights reserved.", "All rights reserved. No part of this publication may be reproduced without permission.",),
}

#: Matches of fewer words are not chained, unless they are the whole template; a chain of this share of a template names it.
LEAST, COVERED = 3, 0.8
#: Words of text that may lie between two matches of a chain.
GAP = 12

#: A word of the contract is a run of letters, digits and bytes above ASCII: in bytes, all else reads as a blank.
_SPACES = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
RESULT = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,spans:array<struct<label:string,start:long,stop:long,covered:double>>>"
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("covered", pa.float64())])
_TYPE = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(_SPACES).split()


class Automaton:
    """Generalised suffix automaton over lists of numbers, with the places where each state's runs end."""

    def __init__(self, lines: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, line in enumerate(lines):
            last = 0
            for at, x in enumerate(line):
                last = self._extend(last, x)
                self.ends[last].append((number, at))
        # a state's runs end wherever those of states that link to it do
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(x)) for x in self.ends]

    def _state(self, length: int, link: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, x: int, q: int) -> int:
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            return self._split(last, x, self.next[last][x])
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, x, self.next[p][x])
        return new

    def step(self, state: int, length: int, x: int) -> tuple[int, int]:
        while state and x not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if x in self.next[state]:
            return self.next[state][x], length + 1
        return 0, 0


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        self.number: dict[bytes, int] = {}
        lines, self.labels = [], []
        for label, texts in templates.items():
            for text in texts:
                lines.append([self.number.setdefault(w, len(self.number) + 1) for w in words(text)])
                self.labels.append(label)
        self.sizes = [len(x) for x in lines]
        phrase = {p: [self.number.setdefault(w, len(self.number) + 1) for w in words(p)] for p in phrases}
        self.auto = Automaton([*lines, *phrase.values()])
        # the phrases that end wherever a state's longest run does, shorter ones too
        own: dict[int, list[tuple[str, int]]] = {}
        for p, line in phrase.items():
            state = 0
            for x in line:
                state = self.auto.next[state][x]
            own.setdefault(state, []).append((phrases[p], len(line)))
        self.base: list[tuple[tuple[str, int], ...]] = []
        for state in range(len(self.auto.length)):
            found, s = [], state
            while s >= 0:
                found += own.get(s, [])
                s = self.auto.link[s]
            self.base.append(tuple(found))

    def scan(self, text: str | None) -> dict:
        line, get, auto = words(text), self.number.get, self.auto
        hits: list[tuple[int, str]] = []
        maximal: list[tuple[int, int, int]] = []  # end, length, state
        state = length = 0
        before = -2
        for at, x in [(i, n) for i, n in enumerate(map(get, line)) if n]:
            if at != before + 1:
                if length >= 2:
                    maximal.append((before, length, state))
                state = length = 0
            old, long = state, length
            state, length = auto.step(state, length, x)
            if length <= long and long >= 2:
                maximal.append((at - 1, long, old))
            if self.base[state]:
                hits += [(at - n + 1, label) for label, n in self.base[state] if n <= length]
            before = at
        if length >= 2:
            maximal.append((before, length, state))
        spans = self.chain(maximal)
        base = sorted({label for _, label in hits})
        best = max((s["covered"] for s in spans), default=0.0)
        return {
            "n_words": len(line), "n_base": len(hits), "first_word": min(hits)[0] if hits else None, "last_word": max(hits)[0] if hits else None,
            "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *(s["label"] for s in spans)})), "score": max(best, 0.5 if base else 0.0), "spans": spans,
        }

    def chain(self, maximal: list[tuple[int, int, int]]) -> list[dict]:
        """Spans of templates: matches in order of text and template, at most ``GAP`` words of text apart."""
        open_: dict[int, tuple[int, int, int, int]] = {}  # template: start, end in text, end in template, words covered
        spans = []

        def close(number: int) -> None:
            start, stop, _, covered = open_.pop(number)
            if covered >= COVERED * self.sizes[number]:
                spans.append({"label": self.labels[number], "start": start, "stop": stop + 1, "covered": covered / self.sizes[number]})

        for end, length, state in maximal:
            for number, at in self.auto.ends[state]:
                if number >= len(self.sizes) or length < min(LEAST, self.sizes[number]):
                    continue
                start = end - length + 1
                got = open_.get(number)
                if got and (start > got[1] + GAP or at <= got[2] or end <= got[1]):
                    if start <= got[1] + GAP and length < got[3]:
                        continue  # a lesser match beside the chain
                    close(number)
                    got = None
                if got:
                    fresh = min(length, at - got[2], end - got[1])
                    open_[number] = (got[0], end, at, got[3] + fresh)
                else:
                    open_[number] = (start, end, at, length)
        for number in list(open_):
            close(number)
        # of templates that cover the same words, those with the most
        spans.sort(key=lambda s: (-s["covered"] * (s["stop"] - s["start"]), s["start"], s["label"]))
        kept: list[dict] = []
        for s in spans:
            if all(s["stop"] <= k["start"] or k["stop"] <= s["start"] or s["label"] == k["label"] or (s["covered"], s["start"], s["stop"]) == (k["covered"], k["start"], k["stop"]) for k in kept):
                kept.append(s)
        return sorted(kept, key=lambda s: (s["start"], s["stop"], s["label"]))


def scan(text: Column, scanner: Scanner | None = None) -> Column:
    """Column of ``RESULT`` for a text column. Places count words from 0; a span's ``stop`` is the word after it."""
    use = scanner or Scanner()

    @F.arrow_udf(RESULT)
    def licences(column: pa.Array) -> pa.Array:
        return pa.array([use.scan(x) for x in common.strings(column)], _TYPE)

    return licences(text)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates of every document."""
    found = common.table(spark, sf_dir, "documents").select("doc_id", scan(F.col("text").cast("string")).alias("s"))
    return found.select("doc_id", "s.n_words", "s.n_base", "s.first_word", "s.last_word", "s.base_labels", "s.labels", "s.score")


#: The contract's word, for tests.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
