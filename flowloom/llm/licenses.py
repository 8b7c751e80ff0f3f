"""License scans by an exact set-similarity join of text blocks with the paragraphs of public licenses.

Templates are the sets of words of notices and license paragraphs. A block meets a template if it holds THRESHOLD of its words, whatever
the template's length. Blocks of a template are all windows of twice its words, with stride one, that stay in a paragraph (lines up to
one without words), so notices are found however they are wrapped, and words scattered over a long text are none. Of
blocks that overlap, the one with most words of a template is its match (the shortest of equals, then the first).

Tokens are put in one global order, rarest first, by the number of lines of the whole table that hold them (counted in each
task, then by token; the result has a row for each word of a template). Filters leave the windows to be counted: a template of n words that
must share t of them indexes only its first n - t + 1 (prefix); a window of fewer than t of its words goes (length); and so does one
whose rarest template word stands so late in the template's order that fewer than t follow it (positional, which is what
the prefix says of that word).

`matches` has every match of every template. A match gives a label unless one at the same place beats it: one whose words stand in the
template's order beats one whose don't (two notices in a row may hold the words of a third); of others, one that meets all its template words and more
(notices contain each other, as "Attribution" in "Attribution-NonCommercial"), or the same ones as a larger part of its template.

Besides, `phrases` are looked for wherever their words stand consecutively, over line ends too.

All is narrow: each text is read whole in one task, twice, and nothing is shuffled but the token counts.

Cases: null and empty texts have no words and no labels; repeated words count once in a block; very long texts and lines are read whole;
repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import slices, table, text_column, utf8
from flowloom.llm.words import ALNUM, lowered, word_hashes, word_spans

THRESHOLD, SPAN = 0.9, 2

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices and paragraphs of public licenses and their labels.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Released under the BSD License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
]

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class Vocabulary:
    """The words of templates and phrases, each with a number."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.words = sorted({w for _, t in templates for w in words_of(t)} | {w for p in phrases for w in words_of(p)})
        self.number = {w: k for k, w in enumerate(self.words)}
        raw = np.frombuffer(b" ".join(self.words) + b" ", dtype=np.uint8)
        ends = np.cumsum([len(w) + 1 for w in self.words]) - 1
        starts = np.r_[0, ends[:-1] + 1]
        hashes = word_hashes(raw, starts, ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.raw, self.starts, self.sizes = raw, starts, ends - starts

    def numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word of raw, -1 for words that aren't in the vocabulary. Hashes find them, bytes decide."""
        h = word_hashes(raw, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == h, self.order[at], -1)
        out[out >= 0] = np.where(self.sizes[out[out >= 0]] == (ends - starts)[out >= 0], out[out >= 0], -1)
        hits = np.flatnonzero(out >= 0)
        sizes = self.sizes[out[hits]]
        word = np.repeat(np.arange(len(hits)), sizes)
        place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        other = word[raw[starts[hits][word] + place] != self.raw[self.starts[out[hits]][word] + place]]
        out[hits[other]] = -1
        return out


def _read(batch: pa.RecordBatch, text: str, vocabulary: Vocabulary):
    """Of a batch: words' numbers and texts, each text's first word, and the block of each word."""
    raw, offsets = utf8(text_column(batch, text))
    low = lowered(raw)
    starts, ends, doc = word_spans(low, offsets, ALNUM)
    numbers = vocabulary.numbers(low, starts, ends)
    first = np.searchsorted(doc, np.arange(batch.num_rows))
    lines = np.searchsorted(np.flatnonzero(raw == 10), starts)
    block = np.r_[0, np.cumsum((lines[1:] != lines[:-1]) | (doc[1:] != doc[:-1]))] if len(doc) else doc
    return numbers, doc, first, lines, block


def token_counts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> dict[int, int]:
    """The number of blocks that hold each word of the vocabulary, over all of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(vocabulary.words), dtype=np.int64)
        for batch in slices(batches, text):
            numbers, _, _, _, block = _read(batch, text, vocabulary)
            hit = numbers >= 0
            seen += np.bincount(np.unique(block[hit] * len(seen) + numbers[hit]) % len(seen), minlength=len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen)), pa.int32()), pa.array(seen)], names=["token", "n"])

    rows = docs.select(text).mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


@dataclass
class Match:
    template: int
    first: int  # words of the batch
    last: int
    met: frozenset[int]  # words of the template, by rank
    share: float
    in_order: bool

    def beats(self, other: Match) -> bool:
        if self.first > other.last or other.first > self.last or self.template == other.template:
            return False
        if self.in_order != other.in_order:
            return self.in_order
        return other.met < self.met or other.met == self.met and self.share > other.share


class Join:
    """Templates in the global token order, with their prefixes indexed."""

    def __init__(self, templates: list[tuple[str, str]], vocabulary: Vocabulary, counts: dict[int, int], threshold: float = THRESHOLD):
        n = len(vocabulary.words)
        order = sorted(range(n), key=lambda k: (counts.get(k, 0), vocabulary.words[k]))
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[order] = np.arange(n)
        self.labels = [label for label, _ in templates]
        self.words = [[int(self.rank[vocabulary.number[w]]) for w in words_of(t)] for _, t in templates]
        self.sets = [sorted(set(w)) for w in self.words]
        self.least = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.place = np.full((len(self.sets), n), -1)  # of a token among a template's
        for k, s in enumerate(self.sets):
            self.place[k, s] = np.arange(len(s))

    def matches(self, numbers: np.ndarray, paragraph: np.ndarray, piece: int = 1 << 15) -> list[Match]:
        """All matches in a batch of texts."""
        at = np.flatnonzero(numbers >= 0)
        ranks = self.rank[numbers[at]]
        out = []
        for k, least in enumerate(self.least):
            places = self.place[k][ranks]
            size = len(self.sets[k])
            if not least or not ((places >= 0) & (places <= size - least)).any():  # no window has a word of the prefix
                continue
            p, places = at[places >= 0], places[places >= 0]
            left = np.arange(len(p))
            right = np.minimum(np.searchsorted(p, p + SPAN * len(self.words[k])), np.searchsorted(paragraph[p], paragraph[p], side="right"))
            hits = np.r_[0, np.cumsum(places <= size - least)]
            go = np.flatnonzero((right - left >= least) & (hits[right] > hits[left]))
            sites = []
            for a in range(0, len(go), piece):
                some = go[a : a + piece]
                low, high = int(left[some[0]]), int(right[some].max())
                seen = np.zeros((high - low + 1, size), dtype=np.int32)
                seen[np.arange(1, high - low + 1), places[low:high]] = 1
                seen = np.cumsum(seen, axis=0, dtype=np.int32)
                met = (seen[right[some] - low] > seen[left[some] - low]).sum(axis=1)
                sites += [self._site(k, p, places, x, int(right[x])) for x in some[met >= least].tolist()]
            starts: list[int] = []
            ends: list[int] = []
            for _, _, a, b, met, in_order in sorted(sites, key=lambda x: x[:4]):
                x = bisect.bisect_right(ends, a - 1)  # the first taken site that ends at a or later
                if x == len(ends) or starts[x] > b:
                    starts.insert(x, a)
                    ends.insert(x, b)
                    out.append(Match(k, a, b, met, len(met) / size, in_order))
        return sorted(out, key=lambda m: (m.first, m.last, m.template))

    def _site(self, k: int, p: np.ndarray, places: np.ndarray, a: int, b: int) -> tuple[int, int, int, int, frozenset[int], bool]:
        """Of the window p[a:b]: words met (negative), length, first and last word up to which all are met, the words, and whether
        they stand in the template's order."""
        found, first = np.unique(places[a:b], return_index=True)
        last = a + int(first.max())
        longest = [0] * (last - a + 1)  # the longest common sequence of the template's words and the window's up to each
        ranks = [self.sets[k][x] for x in places[a : last + 1].tolist()]
        for word in self.words[k]:
            before = 0
            for x, rank in enumerate(ranks):
                here = longest[x]
                longest[x] = max(longest[x], longest[x - 1] if x else 0, before + 1 if rank == word else 0)
                before = max(before, here)
        return -len(found), int(p[last] - p[a]), int(p[a]), int(p[last]), frozenset(self.sets[k][x] for x in found.tolist()), longest[-1] >= self.least[k]


_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, line: long, containment: double>>"


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and, for each text: its words, the places of phrases, labels, the largest containment met (1 where a phrase
    stands), and the blocks that meet a template, with their line."""
    vocabulary = Vocabulary(templates, phrases)
    join = Join(templates, vocabulary, token_counts(docs, vocabulary, text), threshold)
    wanted = [([vocabulary.number[w] for w in words_of(p)], label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            numbers, doc, first, lines, block = _read(batch, text, vocabulary)
            n = batch.num_rows
            base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            for phrase, label in wanted:
                m = len(numbers) - len(phrase) + 1
                if m <= 0:
                    continue
                hit = doc[:m] == doc[len(phrase) - 1 :]
                for k, token in enumerate(phrase):
                    hit &= numbers[k : m + k] == token
                for at in np.flatnonzero(hit).tolist():
                    base[doc[at]].append((at - int(first[doc[at]]), label))
            found: list[list[Match]] = [[] for _ in range(n)]
            gap = (doc[1:] != doc[:-1]) | (lines[1:] - lines[:-1] > 1)
            paragraph = np.r_[0, np.cumsum(gap)] if len(doc) else doc
            for match in join.matches(numbers, paragraph):
                found[doc[match.first]].append(match)
            rows = []
            words = np.bincount(doc, minlength=n).tolist()
            for k in range(n):
                places = [p for p, _ in base[k]]
                own = {label for _, label in base[k]}
                shown = [m for m in found[k] if not any(o.beats(m) for o in found[k])]
                score = 1.0 if places else max((m.share for m in shown), default=0.0)
                every = [{"label": join.labels[m.template], "line": int(lines[m.first] - lines[first[k]]), "containment": m.share} for m in found[k]]
                labels = sorted(own | {join.labels[m.template] for m in shown})
                rows.append((words[k], len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(labels), score, every))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("line", pa.int64()), ("containment", pa.float64())]))]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), *columns], names=names)

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id long, {_OUT}")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
