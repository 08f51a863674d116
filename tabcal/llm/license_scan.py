"""License scans: matching statistics over a suffix automaton of licence texts, chained into covered spans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabcal.llm.common import append_columns, table

# Base phrases with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Public licence texts (the notices that are copied into files), with their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
            "shall be included in all copies or substantial portions of the Software."),
    ("mit", "Licensed under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
               "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
               "law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES "
               "OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
            "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl", "under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Shortest match that is chained, most words between two matches of a chain, least covered share of a template for its label.
LEAST_MATCH, MOST_GAP, LEAST_COVER = 4, 16, 0.6
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters and other characters beyond ASCII; A-Z lower-cased."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class Automaton:
    """Suffix automaton of token sequences, joined by separators that no text holds (so no match runs over a border)."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]  # (sequence, index of its last token), of all occurrences of the state
        last = 0
        for number, sequence in enumerate(sequences):
            for index, token in enumerate(sequence):
                last = self._extend(last, token)
                self.places[last].append((number, index))
            last = self._extend(last, number)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]

    def _new(self, length: int, link: int, step: dict) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.link) - 1

    def _extend(self, last: int, token) -> int:
        current, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = current
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            if self.length[q] == self.length[p] + 1:
                self.link[current] = q
            else:
                copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
                self.link[q] = self.link[current] = copy
                while p >= 0 and self.next[p].get(token) == q:
                    self.next[p][token] = copy
                    p = self.link[p]
        return current

    def step(self, state: int, length: int, token) -> tuple[int, int]:
        """State and length of the longest match that ends with `token`."""
        while token not in self.next[state]:
            if state == 0:
                return 0, 0
            state = self.link[state]
            length = self.length[state]
        return self.next[state][token], length + 1


class Scanner:
    def __init__(self, templates, phrases, least_match=LEAST_MATCH, most_gap=MOST_GAP, least_cover=LEAST_COVER):
        self.templates = [(label, words(text)) for label, text in templates]
        self.phrases = [(label, words(text)) for text, label in phrases]
        self.automaton = Automaton([t for _, t in self.templates] + [t for _, t in self.phrases])
        self.vocabulary = {w for _, t in self.templates + self.phrases for w in t}
        self.least_match, self.most_gap, self.least_cover = least_match, most_gap, least_cover
        # Per state: (phrase number, its length) of the phrases that are suffixes of its strings, own or through suffix links.
        links, lengths = self.automaton.link, self.automaton.length
        self.ends: list[tuple] = [()] * len(links)
        for state in sorted(range(1, len(links)), key=lengths.__getitem__):
            own = {(s - len(self.templates), lengths[state]) for s, i in self.automaton.places[state]
                   if s >= len(self.templates) and i + 1 == lengths[state] == len(self.phrases[s - len(self.templates)][1])}
            self.ends[state] = self.ends[links[state]] + tuple(sorted(own))

    def scan(self, text: str | None):
        """n_words, base places [(start, phrase)], spans [(label, start, end, covered share)]: in one pass over the words."""
        found = words(text)
        vocabulary, step, ends, least = self.vocabulary, self.automaton.step, self.ends, self.least_match
        base, matches = [], []
        state = length = 0
        before = -2
        for at in [i for i, w in enumerate(found) if w in vocabulary]:
            if at != before + 1:
                if length >= least:
                    matches.append((before + 1, length, state))
                state = length = 0
            was = (state, length)
            state, length = step(state, length, found[at])
            if length <= was[1] and was[1] >= least:  # the match that ended one word before was maximal
                matches.append((at, was[1], was[0]))
            for phrase, size in ends[state]:
                if size <= length:
                    base.append((at + 1 - size, phrase))
            before = at
        if length >= least:
            matches.append((before + 1, length, state))
        return len(found), base, self._chain(matches)

    def _chain(self, matches):
        """Joins successive matches that keep a template's order into spans; linear in the matches."""
        spans, chains = [], {}

        def close(number):
            start, end, covered, _ = chains.pop(number)
            label, template = self.templates[number]
            spans.append((label, start, end, covered / len(template)))

        for end, length, state in matches:
            best: dict[int, tuple[bool, int]] = {}  # per template: the first occurrence behind its chain, else any
            for number, index in self.automaton.places[state]:
                if number < len(self.templates):
                    place = (number in chains and index - length + 1 <= chains[number][3], index)
                    best[number] = min(best.get(number, place), place)
            for number, (_, index) in best.items():
                if number in chains:
                    start, stop, covered, after = chains[number]
                    if index - length + 1 > after and end - length - stop <= self.most_gap:
                        chains[number] = (start, end, covered + length, index)
                        continue
                    if covered >= length and end - length < stop:  # an overlapping, shorter match of the same place
                        continue
                    close(number)
                chains[number] = (end - length, end, length, index)
        for number in list(chains):
            close(number)
        return spans


def scan_licenses(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, templates=TEMPLATES, phrases=PHRASES,
    least_match: int = LEAST_MATCH, most_gap: int = MOST_GAP, least_cover: float = LEAST_COVER,
) -> DataFrame:
    """docs (or its columns `keep`) with n_words, n_base, first_word, last_word, base_labels, labels, score and license_spans.

    A word is looked up in one automaton of all templates and phrases, which gives the longest match that ends there;
    phrases are read off it, matches of at least least_match words are chained (gaps of up to most_gap words) into spans,
    each with the share of its template that it covers; from least_cover on it gives the label. score is the largest covered
    share, also below least_cover, and halfway to 1 if a phrase was found. Null text is empty: no words, no labels, score 0. Rows are independent; nothing is shuffled.
    """
    def start():
        scanner = Scanner(templates, phrases, least_match, most_gap, least_cover)

        def call(texts):
            out = [[] for _ in range(8)]
            for text in texts:
                n, base, spans = scanner.scan(text)
                starts = [s for s, _ in base]
                base_labels = {scanner.phrases[p][0] for _, p in base}
                cover = min(1.0, max((s[3] for s in spans), default=0.0))
                row = (n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
                       ",".join(sorted(base_labels | {s[0] for s in spans if s[3] >= scanner.least_cover})), 1 - (1 - cover) / 2 if base else cover,
                       [{"label": a, "start": b, "end": c, "covered": d} for a, b, c, d in spans])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return call

    return append_columns(
        docs, [text_col], "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, license_spans array<struct<label: string, start: bigint, end: bigint, covered: double>>", start, keep)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs, keep=["doc_id"]).drop("license_spans")


QUERIES = {"op2_license_scan": (op2_license_scan, None)}
