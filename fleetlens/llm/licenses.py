"""Licence scans with a generalised suffix automaton over the words of licence texts.

The automaton knows every run of words of every template. Streaming a text through it gives, at each word, the longest run
ending there that some template has, and in which templates it stands. Long runs are chained, in the order of the template
and with few words between, into covered spans; a template counts as found when enough of it is covered. Short phrases are
templates too: one ends at a word if it is a suffix of the run matched there.

Texts are streamed many at a time: only stretches of words that licences use are followed, all stretches of a block in step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.names import Named, blocks, bounds, small, texts

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: The wording of public licences and of the notices that name them, with their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "licensed under the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

LEAST_RUN = 4
MAX_GAP = 6
LEAST_COVER = 0.6

_WORD = np.ones(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _WORD[_a : _b + 1] = False


def words_of(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode().lower(), np.uint8)
    return [data[a:b].tobytes() for a, b in zip(*bounds(_WORD[data]))]


class Automaton:
    """Generalised suffix automaton of word sequences, with its failure moves worked out for every word."""

    def __init__(self, sequences: list[list[bytes]]):
        vocabulary = sorted({w for s in sequences for w in s})
        joined = np.frombuffer(b" ".join(vocabulary) + b" ", np.uint8)
        ends = np.flatnonzero(joined == 0x20)
        names = Named(joined).between(np.append(0, ends[:-1] + 1), ends)
        order = np.argsort(names)
        self.names, self.word = names[order], order
        number = {w: i for i, w in enumerate(vocabulary)}
        coded = [[number[w] for w in s] for s in sequences]
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        for sequence in coded:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        n, v = len(self.moves), len(vocabulary)
        by_length = sorted(range(n), key=self.longest.__getitem__)
        self.goto, self.keep = np.zeros((n, v), np.int32), np.zeros((n, v), np.int32)  # next state, most of the run that stays
        for state in by_length:
            if state:
                self.goto[state], self.keep[state] = self.goto[self.link[state]], self.keep[self.link[state]]
            for word, to in self.moves[state].items():
                self.goto[state, word], self.keep[state, word] = to, self.longest[state]
        self.place = np.full((n, len(coded)), -1, np.int32)  # where the run of a state first ends in each sequence
        for k, sequence in enumerate(coded):
            state = 0
            for i, word in enumerate(sequence):
                state = self.moves[state][word]
                up = state
                while up > 0 and self.place[up, k] < 0:
                    self.place[up, k] = i
                    up = self.link[up]

    def _state(self, moves: dict[int, int], link: int, longest: int) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.moves) - 1

    def _clone_if_needed(self, p: int, q: int, word: int) -> int:
        """The state of the run (longest of p, then word), split off from q if q stands for longer runs too."""
        if self.longest[q] == self.longest[p] + 1:
            return q
        clone = self._state(dict(self.moves[q]), self.link[q], self.longest[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.moves[p].get(word) == q:
            self.moves[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.moves[last]:
            return self._clone_if_needed(last, self.moves[last][word], word)
        new = self._state({}, 0, self.longest[last] + 1)
        p = last
        while p >= 0 and word not in self.moves[p]:
            self.moves[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._clone_if_needed(p, self.moves[p][word], word)
        return new

    def code(self, names: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.word[at], -1)

    def matches(self, words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics: at each word the automaton's state and the length of the longest run ending there."""
        state, length = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        known = words >= 0
        begins = known & np.append(True, (of[1:] != of[:-1]) | ~known[:-1])[: len(words)]
        at = np.flatnonzero(begins)
        now, run = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        while len(at):
            word = words[at]
            run = np.minimum(run, self.keep[now, word]) + 1
            now = self.goto[now, word]
            state[at], length[at] = now, run
            follows = at + 1 < len(words)
            follows[follows] = known[at[follows] + 1] & ~begins[at[follows] + 1]
            at, now, run = at[follows] + 1, now[follows], run[follows]
        return state, length


class Scanner:
    def __init__(self) -> None:
        self.phrases = [(words_of(text), label) for text, label in PHRASES]
        self.templates = [(words_of(text), label) for label, text in TEMPLATES]
        self.automaton = Automaton([w for w, _ in self.phrases + self.templates])
        a = self.automaton
        self.ends_phrase = np.full(len(a.moves), -1)  # a phrase that ends every run of a state, or its own longest run
        self.least = np.zeros(len(a.moves), np.int64)
        for state in sorted(range(len(a.moves)), key=a.longest.__getitem__):
            up = a.link[state]
            if up > 0 and self.ends_phrase[up] >= 0:
                self.ends_phrase[state], self.least[state] = self.ends_phrase[up], 0
            for k, (words, _) in enumerate(self.phrases):
                if a.place[state, k] == len(words) - 1 and a.longest[up] < len(words) <= a.longest[state]:
                    self.ends_phrase[state], self.least[state] = k, len(words)

    def scan(self, values: list[bytes]) -> list[tuple]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of each text."""
        out: list[tuple] = []
        for _, data, ends in blocks(values):
            starts, stops = bounds(_WORD[data])
            of = np.searchsorted(ends, starts, side="right")
            counts = np.bincount(of, minlength=len(ends))
            begin = np.cumsum(counts) - counts
            # names need equal bytes only, so long blocks are named in pieces of whole words
            words = self.automaton.code(_names(data, starts, stops))
            state, length = self.automaton.matches(words, of)
            phrase = self.ends_phrase[state]
            base = np.flatnonzero((phrase >= 0) & (length >= self.least[state]))
            runs = np.flatnonzero(length >= LEAST_RUN)
            hits: dict[int, list] = {}
            for i in base.tolist():
                hits.setdefault(int(of[i]), [[], []])[0].append((i - len(self.phrases[phrase[i]][0]) + 1, int(phrase[i])))
            for i in runs.tolist():
                hits.setdefault(int(of[i]), [[], []])[1].append((i, int(state[i]), int(length[i])))
            for k, n in enumerate(counts.tolist()):
                found = hits.get(k)
                if not found:
                    out.append((n, 0, None, None, "", "", 0.0, []))
                    continue
                places, first = found[0], int(begin[k])
                labels = {self.phrases[p][1] for _, p in places}
                spans, score = self._chains(found[1], first)
                at = [p - first for p, _ in places]
                out.append(
                    (n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})), max(score, float(bool(places))), spans)
                )
        return out

    def _chains(self, runs: list[tuple[int, int, int]], first: int) -> tuple[list[tuple[str, int, int]], float]:
        """Spans (label, first word, last word) of templates that are covered enough, and the best cover."""
        spans, best = [], 0.0
        place = self.automaton.place
        for k, (words, label) in enumerate(self.templates):
            column, chains = len(self.phrases) + k, []
            for i, state, length in runs:
                end = int(place[state, column])
                if end < 0:
                    continue
                new = min(length, end + 1)
                if chains and 0 < i - chains[-1][1] <= new + MAX_GAP and end > chains[-1][2]:
                    chain = chains[-1]
                    chain[3] += min(new, i - chain[1], end - chain[2])
                    chain[1], chain[2] = i, end
                else:
                    chains.append([i - new + 1, i, end, new])
            for a, b, _, covered in chains:
                cover = min(1.0, covered / len(words))
                if covered >= min(len(words), 2 * LEAST_RUN) and cover >= (LEAST_COVER if len(words) > 2 * LEAST_RUN else 1.0):
                    spans.append((label, a - first, b - first))
                    best = max(best, cover)
        return spans, best


def _names(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + piece)))
        named = Named(data[starts[i] : stops[j - 1]])
        out[i:j] = named.between(starts[i:j] - starts[i], stops[i:j] - starts[i])
        i = j
    return out


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
_RESULT = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:bigint,last_word:bigint>>"
)
_scanners: list[Scanner] = []


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _scanners:
        _scanners.append(Scanner())
    for batch in small(batches):
        rows = _scanners[0].scan([t.lower() for t in texts(batch)])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS)
        columns = list(zip(*rows)) or [()] * len(kinds)
        columns[-1] = [[{"label": s[0], "first_word": s[1], "last_word": s[2]} for s in spans] for spans in columns[-1]]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        yield pa.RecordBatch.from_arrays([batch.column("d"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["d", *names])


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Words are runs of digits, ASCII letters in lower case and bytes beyond ASCII. ``score`` is 1 with a phrase, else the best cover of a template
    that counts as found, else 0. A null text is empty. Rows that repeat an id are scanned one by one; other columns are ignored.
    """
    read = docs.select(F.col(id_column).cast("long").alias("d"), F.col(text_column).alias("text"))
    return read.mapInArrow(_scanned, f"d bigint, {_RESULT}").withColumnRenamed("d", id_column)
