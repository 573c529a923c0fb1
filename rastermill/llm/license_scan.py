"""Licence scans with a generalised suffix automaton of licence word sequences.

Documents stream through the automaton, which gives at each word the length of
the longest match with any phrase or template that ends there.  Stretches with a
long match stream through the automaton of each template as well, so that a
passage that several templates share counts for all of them, at all its places.
Long matches are chained into covered spans of the templates.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ..functions.store import read_table
from .words import ALNUM, chunks, split_words, text_bytes

#: Phrases, each with its label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Labels of licence texts by the start of their file's name.
FILES = {"Apache": "apache", "Artistic": "artistic", "BSD": "bsd", "CC0": "cc0", "GFDL": "gfdl", "GPL": "gpl", "LGPL": "lgpl", "MPL": "mpl"}

#: Short public licence notices, each with its label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


#: The full public licence texts that come with the package.
LICENCES = Path(__file__).parent / "licences"


def licence_files(folder: str | Path = LICENCES) -> list[tuple[str, str]]:
    """(label, text) of the full licence texts in a folder; a folder without any is an error.

    Read on the driver, a few hundred KB.  Links to other files count once.
    """
    files = {p.resolve() for p in Path(folder).glob("*") if p.is_file()}
    found = [(label, p.read_text(errors="replace")) for p in sorted(files) for start, label in FILES.items() if p.name.startswith(start)]
    if not found:
        raise FileNotFoundError(f"no licence texts in {folder}")
    return found


@dataclass
class SuffixAutomaton:
    """All substrings of several word sequences; each state knows the places where its longest string ends as a prefix."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _new(self, length: int, edges: dict[int, int] | None = None, link: int = -1) -> int:
        self.next.append(dict(edges or {}))
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, at: int, word: int, to: int) -> int:
        """A copy of state `to` for the strings that reach it from `at` without longer ones."""
        copy = self._new(self.length[at] + 1, self.next[to], self.link[to])
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, which: int, words: list[int]) -> None:
        last = 0
        for k, word in enumerate(words):
            there = self.next[last].get(word)
            if there is not None:  # an earlier sequence has this string
                last = there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
            else:
                new, at = self._new(self.length[last] + 1), last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at < 0:
                    self.link[new] = 0
                else:
                    there = self.next[at][word]
                    self.link[new] = there if self.length[there] == self.length[at] + 1 else self._split(at, word, there)
                last = new
            self.ends[last].append((which, k))

    @functools.cached_property
    def longer(self) -> list[list[int]]:
        """The states whose strings end with each state's."""
        out: list[list[int]] = [[] for _ in self.link]
        for state, up in enumerate(self.link):
            if up >= 0:
                out[up].append(state)
        return out

    def places(self, state: int) -> list[tuple[int, int]]:
        """All (sequence, last word) where the state's strings end."""
        found, open_ = [], [state]
        while open_:
            at = open_.pop()
            found += self.ends[at]
            open_ += self.longer[at]
        return sorted(found)

    def walk(self, words: list[int]) -> Iterator[tuple[int, int, int, bool]]:
        """Matching statistics: for each word, its place, the state and length of the longest match that ends there, and whether the one before it ended.

        A match that can't go on falls back to its longest suffix that can.
        """
        state = length = 0
        for k, w in enumerate(words):
            there = self.next[state].get(w)
            ended = there is None
            while there is None and state:
                state = self.link[state]
                length = self.length[state]
                there = self.next[state].get(w)
            state, length = (0, 0) if there is None else (there, length + 1)
            yield k, state, length, ended

    def matches(self, words: list[int], least: int) -> list[tuple[int, int, int]]:
        """(state, word after it, words) of each match of `least` words or more that couldn't go on."""
        out, before = [], (0, 0)
        for k, state, length, ended in self.walk(words):
            if ended and before[1] >= least:
                out.append((before[0], k, before[1]))
            before = state, length
        if before[1] >= least:
            out.append((before[0], len(words), before[1]))
        return out


class LicenseScanner:
    """Phrases and templates in one automaton, one for each template, and what is needed to skip text that can't match."""

    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]], least: int, share: float):
        self.least, self.share = least, share
        texts = [p for p, _ in phrases] + [t for _, t in templates]
        self.labels = [x for _, x in phrases] + [x for x, _ in templates]
        self.n_phrases = len(phrases)
        data, off = text_bytes(pa.array(texts, pa.string()))
        words = split_words(data, off, ALNUM, True)
        self.vocabulary, ids = np.unique(words.hash, return_inverse=True)
        self.texts = [ids[words.offsets[k] : words.offsets[k + 1]].tolist() for k in range(len(texts))]
        self.pairs, self.phrase_pairs = self._pairs(self.texts), self._pairs(self.texts[: self.n_phrases])
        self.single = np.unique([t[0] for t in self.texts[: self.n_phrases] if len(t) == 1]).astype(np.int64)
        self.automaton, self.of = SuffixAutomaton(), []
        for k, t in enumerate(self.texts):
            self.automaton.add(k, t)
            self.of.append(SuffixAutomaton())
            if k >= self.n_phrases:
                self.of[k].add(k, t)
        self.ends = self._phrase_ends()

    def _pairs(self, texts: list[list[int]]) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(t[:-1], np.int64) * len(self.vocabulary) + np.array(t[1:], np.int64) for t in texts)]))

    def _phrase_ends(self) -> list[tuple[tuple[int, int], ...]]:
        """For each state, the (phrase, words) that are suffixes of its strings."""
        a = self.automaton
        own: dict[int, list[tuple[int, int]]] = {}
        for k in range(self.n_phrases):
            at = 0
            for w in self.texts[k]:
                at = a.next[at][w]
            if self.texts[k]:
                own.setdefault(at, []).append((k, len(self.texts[k])))
        out: list[tuple[tuple[int, int], ...]] = [()] * len(a.next)
        for state in sorted(range(len(a.next)), key=a.length.__getitem__):
            out[state] = (*own.get(state, ()), *(out[a.link[state]] if a.link[state] >= 0 else ()))
        return out

    def runs(self, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs (first, after the last) of words in which all neighbours stand side by side in some phrase or template, and word ids.

        Only those that are long enough for a match or may hold a phrase.
        """
        none = np.zeros(0, np.int64)
        if not len(hashes) or not len(self.vocabulary):
            return none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        pair = known[:-1] & known[1:] & (text[:-1] == text[1:])
        code = at[:-1][pair] * len(self.vocabulary) + at[1:][pair]
        pair[pair] = np.isin(code, self.pairs)
        telling = np.zeros(len(hashes) + 1, np.int64)  # words that may begin a phrase
        telling[np.flatnonzero(pair)[np.isin(at[:-1][pair] * len(self.vocabulary) + at[1:][pair], self.phrase_pairs)]] = 1
        alone = known & np.isin(at, self.single)
        telling[:-1][alone] = 1
        edge = np.diff(np.concatenate([[False], pair, [False]]).astype(np.int8))
        first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        inside = np.zeros(len(hashes) + 1, np.int64)
        inside[first] += 1
        inside[after] -= 1
        apart = np.flatnonzero(alone & (np.cumsum(inside)[:-1] == 0))  # one-word phrases outside of runs
        total = np.concatenate([[0], np.cumsum(telling)])
        stay = (after - first >= self.least) | (total[after] > total[first])
        first, after = np.concatenate([first[stay], apart]), np.concatenate([after[stay], apart + 1])
        order = np.argsort(first)
        return first[order], after[order], at

    def stream(self, words: list[int], first: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Phrases (start, phrase) and long matches (template, template start, start, words) of one run."""
        phrases, longest = [], 0
        for k, state, length, _ in self.automaton.walk(words):
            longest = max(longest, length)
            phrases += [(first + k + 1 - n, p) for p, n in self.ends[state] if n <= length]
        found = []
        if longest >= self.least:
            for t in range(self.n_phrases, len(self.texts)):
                own = self.of[t]
                for state, after, n in own.matches(words, self.least):
                    found += [(t, end + 1 - n, first + after - n, n) for _, end in own.places(state)]
        return phrases, found

    def chain(self, matches: list[tuple[int, int, int, int]]) -> dict[int, float]:
        """The share of each template that its chained matches cover.

        Matches of a template chain while they advance in both the text and the
        template; the best chain counts.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for t, at, start, n in matches:
            by.setdefault(t, []).append((start, at, n))
        out = {}
        for t, found in by.items():
            best: list[tuple[int, int]] = []  # (template end reached, words covered), for ends that pay
            top = 0
            for _, at, n in sorted(set(found)):
                covered = max((c + at + n - max(at, end) for end, c in best if end < at + n), default=n)
                covered = max(covered, n)
                best = [(e, c) for e, c in best if e < at + n or c > covered]
                if not any(e <= at + n and c >= covered for e, c in best):
                    best.append((at + n, covered))
                top = max(top, covered)
            out[t] = min(1.0, top / len(self.texts[t]))
        return out


@functools.cache
def _scanner(phrases: tuple, templates: tuple, least: int, share: float) -> LicenseScanner:
    return LicenseScanner(list(phrases), list(templates), least, share)


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,words:long>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))


def _scan(key: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*key.value)
        for batch in batches:
            for i, j, data, off in chunks(batch.column(1)):
                words = split_words(data, off, ALNUM, True)
                text = words.text_of()
                first, after, ids = scanner.runs(words.hash, text)
                phrases: dict[int, list] = {}
                matches: dict[int, list] = {}
                for a, b in zip(first.tolist(), after.tolist(), strict=True):
                    t = int(text[a])
                    p, m = scanner.stream(ids[a:b].tolist(), a - int(words.offsets[t]))
                    if p:
                        phrases.setdefault(t, []).extend(p)
                    if m:
                        matches.setdefault(t, []).extend(m)
                yield _rows(scanner, batch.column(0).slice(i, j - i), words.counts, phrases, matches)

    return run


def _rows(s: LicenseScanner, ids: pa.Array, counts: np.ndarray, phrases: dict[int, list], matches: dict[int, list]) -> pa.RecordBatch:
    n = len(ids)
    n_base, first, last, base, labels, score, spans = [0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n, [[]] * n
    for t in phrases.keys() | matches.keys():
        places = sorted(phrases.get(t, []))
        found = {s.labels[p] for _, p in places}
        covered = s.chain(matches.get(t, []))
        more = {s.labels[k] for k, share in covered.items() if share >= s.share}
        n_base[t] = len(places)
        if places:
            first[t], last[t] = places[0][0], places[-1][0]
        base[t], labels[t] = ",".join(sorted(found)), ",".join(sorted(found | more))
        score[t] = max([1.0 if places else 0.0, *covered.values()])
        spans[t] = [{"label": s.labels[p], "first": at, "words": len(s.texts[p])} for at, p in places] + [{"label": s.labels[k], "first": at, "words": m} for k, _, at, m in sorted(matches.get(t, []), key=lambda x: x[2])]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(counts, pa.int64()), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base), pa.array(labels), pa.array(score), pa.array(spans, _SPANS)],
        names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
    )


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] | None = None, least: int = 6, share: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one for each row of docs.

    phrases maps a phrase, of one word or more, to its label; templates are
    (label, text), by default the notices of TEMPLATES.  n_base counts the
    places of phrases, overlapping ones included; labels adds those of templates
    of which chained matches of `least` words or more cover `share`.  score is
    the largest share covered of a phrase or template.  A null or empty text has
    no words, no labels and score 0; repeated rows and ids are each scanned;
    other columns are not read.  One pass, no shuffle.
    """
    key = (tuple(phrases.items()), tuple(TEMPLATES.items() if templates is None else templates), least, share)
    held = docs.sparkSession.sparkContext.broadcast(key)  # the templates: what the caller gives, a few hundred KB
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_scan(held), _SCHEMA)


def op9_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` against licence phrases, notices and the full texts that come with the package."""
    return scan_licenses(read_table(spark, sf_dir, "documents"), templates=[*TEMPLATES.items(), *licence_files()]).drop("spans")
