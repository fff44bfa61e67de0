"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds the words of all templates and phrases. A text is streamed
through it word by word; the matching statistics (longest match that ends at
each word) give the places of phrases, and maximal matches of a template that
continue each other are chained into the span it covers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import ALNUM, LOWER_DIGITS, chunks, row_of, span_hashes, word_spans
from .common import bounded

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices by which licences are declared, in their usual words.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution NonCommercial 4.0 International License"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "reserved": ["All rights reserved."],
}
#: Words a chained span must cover, as a share of the template, for its label.
COVER = 0.8
#: Shortest maximal match that enters a chain, and words that a chain may miss between two.
LEAST_MATCH, GAP = 2, 3


class Automaton:
    """Suffix automaton of several word sequences, built one word at a time."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)

    def _split(self, state: int, word: int, target: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[target]))
        self.length.append(self.length[state] + 1)
        self.link.append(self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new, state = len(self.next), last
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def reach(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state


def _hashes(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = word_spans(data, np.array([0, len(data)]), ALNUM)
    return span_hashes(data, starts, ends, LOWER_DIGITS).tolist()


class Scanner:
    """Phrases and templates compiled into one automaton."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.automaton = Automaton()
        named = [(label, _hashes(p)) for p, label in phrases.items()]
        self.templates = [(label, _hashes(t)) for label, texts in templates.items() for t in texts]
        self.words = np.unique(np.array([w for _, s in named + self.templates for w in s], np.uint64))
        for _, sequence in named + self.templates:
            self.automaton.add(sequence)
        # Phrases that end in a state: those of the states on its suffix links.
        at = {}
        for label, sequence in named:
            at.setdefault(self.automaton.reach(sequence), []).append((label, len(sequence)))
        self.phrases_at = []
        for state in range(len(self.automaton.next)):
            found, up = [], state
            while up >= 0:
                found += at.get(up, [])
                up = self.automaton.link[up]
            self.phrases_at.append(found)
        # Where each state's longest match ends in the templates.
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.automaton.next]
        for t, (_, sequence) in enumerate(self.templates):
            state = 0
            for i, word in enumerate(sequence):
                state = self.automaton.next[state][word]
                self.ends[state].append((t, i + 1))
        for state in sorted(range(1, len(self.ends)), key=lambda s: -self.automaton.length[s]):
            up = self.automaton.link[state]
            self.ends[up] = list({*self.ends[up], *self.ends[state]})

    def scan(self, words: list[int], first: int, bases: list[tuple[int, str]], matches: list[tuple[int, int, int, int]]) -> None:
        """Stream a run of known words that starts at word ``first``: adds (start, label) of phrases and (template, place in it, start, length) of maximal matches."""
        step, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        state = size = 0
        n = len(words)
        for i, word in enumerate(words):
            before, before_size = state, size
            while state and word not in step[state]:
                state = link[state]
                size = length[state]
            if before_size >= LEAST_MATCH and size < before_size:
                self._add(before, before_size, first + i, matches)
            target = step[state].get(word)
            if target is None:
                size = 0
                continue
            state, size = target, size + 1
            for label, m in self.phrases_at[state]:
                if m <= size:
                    bases.append((first + i - m + 1, label))
        if size >= LEAST_MATCH:
            self._add(state, size, first + n, matches)

    def _add(self, state: int, size: int, end: int, matches: list) -> None:
        for t, stop in self.ends[state]:
            matches.append((t, stop - size, end - size, size))

    def covered(self, matches: list[tuple[int, int, int, int]]) -> dict[str, float]:
        """For each label the largest share of a template that one chain of matches covers."""
        best: dict[str, float] = {}
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for t, place, start, size in matches:
            by_template.setdefault(t, []).append((start, place, size))
        for t, found in by_template.items():
            label, sequence = self.templates[t]
            chains: dict[tuple[int, int], int] = {}  # (end in text, end in template): words covered
            for start, place, size in sorted(set(found)):
                near = (chains.get((start - i, place - j), 0) for i in range(GAP + 1) for j in range(GAP + 1))
                total, end = size + max(near), (start + size, place + size)
                chains[end] = max(total, chains.get(end, 0))
                best[label] = max(best.get(label, 0.0), min(1.0, total / len(sequence)))
        return best


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(PHRASES, TEMPLATES)


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = scanner()
    low = np.zeros(1 << 16, bool)
    low[own.words & np.uint64(0xFFFF)] = True
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(1)):
            starts, ends = word_spans(data, offsets, ALNUM)
            hashes = span_hashes(data, starts, ends, LOWER_DIGITS)
            rows = row_of(starts, offsets)
            n = hi - lo
            at = np.searchsorted(rows, np.arange(n + 1))
            known = np.flatnonzero(low[hashes & np.uint64(0xFFFF)])
            place = np.minimum(np.searchsorted(own.words, hashes[known]), len(own.words) - 1)
            known = known[own.words[place] == hashes[known]]
            # Runs of at least two neighbouring known words of one row.
            joined = np.zeros(len(known) + 1, bool)
            joined[1:-1] = (known[1:] == known[:-1] + 1) & (rows[known[1:]] == rows[known[:-1]])
            begin, end = np.flatnonzero(~joined[:-1] & joined[1:]), np.flatnonzero(joined[:-1] & ~joined[1:]) + 1
            found: dict[int, tuple[list, list]] = {}
            for a, b in zip(begin.tolist(), end.tolist()):
                r = int(rows[known[a]])
                bases, matches = found.setdefault(r, ([], []))
                own.scan(hashes[known[a:b]].tolist(), int(known[a] - at[r]), bases, matches)
            base_n, first, last, base_labels, labels, score = [0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n
            for r, (bases, matches) in found.items():
                if bases:
                    base_n[r], first[r], last[r] = len(bases), min(bases)[0], max(bases)[0]
                mine = {label for _, label in bases}
                cover = own.covered(matches)
                base_labels[r] = ",".join(sorted(mine))
                labels[r] = ",".join(sorted(mine | {x for x, share in cover.items() if share >= COVER}))
                score[r] = max(cover.values(), default=0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), pa.array(np.diff(at).astype(np.int64)), pa.array(base_n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())],
                names=[x.split()[0] for x in _OUT.split(", ")],
            )


def license_scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every whole text.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters
    beyond ASCII. n_base counts all places of the base phrases, first_word and
    last_word are their least and largest start (null without any). labels
    adds those of templates of which one chain of matches covers at least
    four fifths; score is the largest covered share of any template. Null and
    wordless texts have counts 0, empty labels and score 0. Rows are
    independent; other columns are not read.
    """
    bounded(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _OUT)
