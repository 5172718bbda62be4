"""Licence scans with a generalised suffix automaton.

One automaton holds every run of words of all licence templates. The words of a text stream through it, which tells for each word
how long a run ending there some template has, and where (matching statistics). Maximal runs of at least LEAST words are
chained per template, in order on both sides and with small gaps, and a chain that covers enough of its template is a span
of that licence. Phrases that name a licence are templates of their own, found wherever the run at a word ends in them.

Words are cut from many texts at once, and only stretches in which each pair of neighbours is a pair of some template are streamed:
no run of two words or more can lie elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmend.llm.common import held
from driftmend.llm.words import cut_words, slices

LEAST, GAP, SHARE = 5, 12, 0.5  # words of a run that is chained; words between runs of a chain; share of a template that a span covers

# Phrases that name a licence, and passages of public licence texts.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code
must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions"""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
)

_KINDS = np.ones(256, np.uint8)
_KINDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 0


def tokens(text: str) -> list[bytes]:
    """The words of one text."""
    found = cut_words(pa.array([text]), _KINDS)
    words = found.words.to_pylist()
    return [words[c] for c in found.codes.tolist()]


@dataclass
class Automaton:
    """All runs of words of some sequences: a state is a set of runs that end at the same places."""

    moves: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])

    def _new(self, longest: int, moves: dict[int, int], link: int) -> int:
        self.moves.append(moves)
        self.longest.append(longest)
        self.link.append(link)
        return len(self.moves) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the runs that end in c after p: q, or what is split off it."""
        if self.longest[q] == self.longest[p] + 1:
            return q
        part = self._new(self.longest[p] + 1, dict(self.moves[q]), self.link[q])
        self.link[q] = part
        while p >= 0 and self.moves[p].get(c) == q:
            self.moves[p][c] = part
            p = self.link[p]
        return part

    def add(self, sequence: list[int]) -> list[int]:
        """The states of the beginnings of a sequence, which is added from the root on."""
        last, found = 0, []
        for c in sequence:
            if c in self.moves[last]:
                last = self._split(last, c, self.moves[last][c])
            else:
                new, p = self._new(self.longest[last] + 1, {}, 0), last
                while p >= 0 and c not in self.moves[p]:
                    self.moves[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c, self.moves[p][c])
                last = new
            found.append(last)
        return found


@dataclass
class Model:
    labels: list[str]  # of each template
    sizes: list[int]  # words of each template
    vocabulary: dict[bytes, int]
    automaton: Automaton
    ends: list[list[tuple[int, int]]]  # of each state, (template, place after the run) of its runs
    phrases: list[list[tuple[int, str]]]  # of each state, (words, label) of the phrases that its longest run ends in
    pairs: np.ndarray  # sorted: first * words + second of all neighbours
    naming: np.ndarray  # the same of the first two words of each phrase
    least: int
    gap: int
    share: float

    def streamed(self, run: list[int]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """(first word, label) of the phrases and (first word, word after, state) of the maximal runs in a stretch of words."""
        moves, link, longest = self.automaton.moves, self.automaton.link, self.automaton.longest
        named, found, state, size = [], [], 0, 0
        for i, c in enumerate(run):
            was, length = state, size
            while state and c not in moves[state]:
                state = link[state]
                size = longest[state]
            if c in moves[state]:
                state, size = moves[state][c], size + 1
            if size <= length and length >= self.least:
                found.append((i - length, i, was))
            named += [(i - m + 1, label) for m, label in self.phrases[state] if size >= m]
        if size >= self.least:
            found.append((len(run) - size, len(run), state))
        return named, found

    def chained(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first word, word after, words covered) of the chains of the runs of one text, in its order.

        A run follows another of its template if both sides go on from where that ended, at most gap words later; what
        overlaps counts once. Only runs that ended less than gap words before are looked at, of which there are few.
        """
        open_: dict[int, list[list[int]]] = {}  # by template: text begin, text end, template end, covered, followed
        done = []
        for start, stop, state in runs:
            for t, after in self.ends[state]:
                own, best = open_.setdefault(t, []), None
                for x in reversed(own):
                    if x[1] < start - self.gap:
                        break
                    over = max(0, x[1] - start)  # words of this run that the other has in the text
                    step = after - (stop - start) + over - x[2]  # words of the template between them
                    if stop - start - over > 0 and 0 <= step <= self.gap and (best is None or x[3] - over > best[0][3] - best[1]):
                        best = (x, over)
                if best is None:
                    own.append([start, stop, after, stop - start, 0])
                else:
                    best[0][4] = 1
                    own.append([best[0][0], stop, after, best[0][3] + stop - start - best[1], 0])
        for t, own in open_.items():
            done += [(t, x[0], x[1], x[3]) for x in own if not x[4]]
        return sorted(done, key=lambda x: (x[1], x[2], x[0]))


def build(templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: int = LEAST, gap: int = GAP, share: float = SHARE) -> Model:
    """A model of (label, text) templates and of phrases of two words or more by label."""
    cut = [(label, tokens(text)) for label, text in templates]
    named = [(label, tokens(text)) for text, label in phrases.items()]
    if any(len(w) < 2 for _, w in named):
        raise ValueError("a phrase needs two words at least")
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in cut + named for w in words))}
    ids = [[vocabulary[w] for w in words] for _, words in cut + named]
    whole = Automaton()
    for sequence in ids:
        whole.add(sequence)
    walks = []
    for sequence in ids:  # states may be split until the last sequence is in
        state, walk = 0, []
        for c in sequence:
            state = whole.moves[state][c]
            walk.append(state)
        walks.append(walk)
    ends: list[set] = [set() for _ in whole.moves]
    for t, walk in enumerate(walks[: len(cut)]):
        for i, state in enumerate(walk):
            ends[state].add((t, i + 1))
    own: list[list] = [[] for _ in whole.moves]
    for (label, words), walk in zip(named, walks[len(cut) :]):
        own[walk[-1]].append((len(words), label))
    by_length = sorted(range(1, len(whole.moves)), key=lambda s: whole.longest[s])
    for s in reversed(by_length):
        ends[whole.link[s]] |= ends[s] if whole.link[s] else set()
    told: list[list] = [[] for _ in whole.moves]
    for s in by_length:
        told[s] = own[s] + told[whole.link[s]]
    n = max(len(vocabulary), 1)
    pair = lambda s: [a * n + b for a, b in zip(s, s[1:])]
    return Model(
        [label for label, _ in cut], [len(w) for _, w in cut], vocabulary, whole, [sorted(e) if whole.longest[s] >= least else [] for s, e in enumerate(ends)], told,
        np.unique(np.array([p for s in ids for p in pair(s)], np.int64)), np.unique(np.array([pair(s)[0] for s in ids[len(cut) :]], np.int64)), least, gap, share,
    )


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
    return known[at] == values if len(known) else np.zeros(len(values), bool)


def scan(texts: pa.Array, model: Model) -> list[dict]:
    """n_words, places (first word, label), spans (label, first, after, covered, share) and score of each text."""
    found = cut_words(texts, _KINDS)
    names = np.fromiter((model.vocabulary.get(w, -1) for w in found.words.to_pylist()), np.int64, len(found.words))
    ids = names[found.codes]
    pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0) & (found.text[:-1] == found.text[1:]), ids[:-1] * max(len(model.vocabulary), 1) + ids[1:], -1)
    good = _among(pair, model.pairs)
    edge = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # of stretches of pairs; the last word is at end
    says = np.concatenate([[0], np.cumsum(_among(pair, model.naming) & good)])
    some = (end - begin + 1 >= model.least) | (says[end] > says[begin])
    first = np.searchsorted(found.text, np.arange(len(texts)))
    out = [{"n_words": n, "places": [], "runs": []} for n in np.bincount(found.text, minlength=len(texts)).tolist()]
    for b, e in zip(begin[some].tolist(), end[some].tolist()):
        t = int(found.text[b])
        at = b - int(first[t])
        named, runs = model.streamed(ids[b : e + 1].tolist())
        out[t]["places"] += [(at + i, label) for i, label in named]
        out[t]["runs"] += [(at + i, at + j, s) for i, j, s in runs]
    for x in out:
        chains = [(t, a, b, c, c / model.sizes[t]) for t, a, b, c in model.chained(x.pop("runs"))]
        x["spans"] = [{"label": model.labels[t], "first": a, "after": b, "covered": c, "share": s} for t, a, b, c, s in chains if s >= model.share]
        x["score"] = max([1.0 if x["places"] else 0.0, *(s for *_, s in chains)])
        x["places"] = [{"first": i, "label": label} for i, label in sorted(x["places"])]
    return out


_TOLD = "n_words long, places array<struct<first:long,label:string>>, spans array<struct<label:string,first:long,after:long,covered:long,share:double>>, score double"
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("first", pa.int64()), ("label", pa.string())]))),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))), ("score", pa.float64()),
])


def find_licenses(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with a column license: n_words; places (first word, label) of phrases; spans (label, first word, word after, words covered, share
    of the template covered) of chains with the model's share or more; score, the largest share that any chain covers, 1 where there is a phrase.

    Words are runs of letters a-z (A-Z in lower case), digits and other than ASCII characters, counted from 0. A null or empty
    text has no words and score 0. Rows, repeated ones too, are independent of each other and keep their other columns;
    a column license is replaced. Texts are read whole, whatever their length; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or build())

    @F.arrow_udf(_TOLD)
    def tell(texts: pa.Array) -> pa.Array:
        known, told = held(getattr, shared, "value"), []
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
            told += scan(part.column("text"), known)
        pa.default_memory_pool().release_unused()
        return pa.array(told, _ARROW)

    tell = tell.asNondeterministic()  # it isn't, but else each field that is read would run it again
    return docs.withColumn("license", tell(F.col("text").cast("string")))


def _listed(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:first:after:covered)."""
    places, spans = F.col("license.places"), F.col("license.spans")
    starts, base = F.transform(places, lambda p: p["first"]), F.transform(places, lambda p: p["label"])
    text = F.transform(spans, lambda s: F.concat_ws(":", s["label"], s["first"], s["after"], s["covered"]))
    return scanned.select(
        "doc_id", F.col("license.n_words").alias("n_words"), F.size(places).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _listed(base).alias("base_labels"), _listed(F.concat(base, F.transform(spans, lambda s: s["label"]))).alias("labels"), F.col("license.score").alias("score"), F.array_join(text, ",").alias("spans"),
    )
