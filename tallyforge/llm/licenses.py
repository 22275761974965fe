"""License scans by templates with optional and replaceable regions.

A template is text with markup: ``<<beginOptional>> ... <<endOptional>>`` encloses words that
may be missing, ``<<var;max=N>>`` stands for up to N arbitrary words and ``<<var>>`` for any number.  It is compiled to an
automaton over word hashes.  A text has the template where the automaton accepts a run of its
words, that is where all mandatory words stand exactly and in order.  The places at which a
template can begin are those of its first mandatory run of words, which is found for a whole
batch at a time; only there does the automaton run.

Base phrases, places where given words follow each other, are reported beside the templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyforge.llm.common import LOWER_ALNUM, Words, segments, words

#: Words of the lower-cased text, as a pattern.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed values: (label, phrase).
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>>
shall be included in all copies or substantial portions of the Software."""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=10>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL <<var;max=10>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GNU = """under the <<beginOptional>>terms of the<<endOptional>> GNU {0}General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>
<<beginOptional>>, either<<endOptional>> version {1} <<beginOptional>>of the License<<endOptional>> <<beginOptional>>, or (at your option) any later version<<endOptional>>"""
#: Fixed values: (label, template).  Whole licences first, then the notices by which a text refers to one.
TEMPLATES = (
    ("mit", f"{_MIT_GRANT} {_MIT_DISCLAIMER}"),
    ("bsd-2-clause", f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{_BSD_CONDITIONS} <<beginOptional>>3.<<endOptional>> Neither the name of <<var>> nor the names of <<var>> may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}"),
    ("isc", f"Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}"),
    ("0bsd", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_DISCLAIMER}"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("bsl-1", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("mit", "<<beginOptional>>is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT license"),
    ("apache-2", """Licensed under the Apache License <<beginOptional>>Version<<endOptional>> 2 <<beginOptional>>0<<endOptional>> <<beginOptional>>(the "License"); you may not use this file except in compliance with the License
<<beginOptional>>. You may obtain a copy of the License at <<var;max=8>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License<<endOptional>><<endOptional>>"""),
    ("cc-by-nc", "Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC <<var;max=2>> <<beginOptional>>license<<endOptional>>"),
    ("cc-by-nc", "Licensed under <<beginOptional>>a<<endOptional>> Creative Commons Attribution NonCommercial <<var;max=3>> license"),
    ("cc0-1", "To the extent possible under law, <<var;max=20>> waived all copyright and related or neighboring rights to <<var;max=20>> This work is published from"),
    ("gpl-2", _GNU.format("", "2")),
    ("gpl-3", _GNU.format("", "3")),
    ("lgpl-2.1", _GNU.format("<<beginOptional>>Library<<endOptional>> <<beginOptional>>Lesser<<endOptional>> ", "2 1")),
    ("lgpl-3", _GNU.format("Lesser ", "3")),
    ("agpl-3", _GNU.format("Affero ", "3")),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License <<beginOptional>>v<<endOptional>> 2 0"),
)

MARK = re.compile(r"<<\s*(beginOptional|endOptional|var(?:;[^<>]*)?)\s*>>")


def _hashes(text: str) -> list[int]:
    return words(pa.array([text]), LOWER_ALNUM, lower=True).hash.tolist()


_NOWHERE: frozenset[int] = frozenset()


@dataclass
class Automaton:
    """States with edges by word hash, by any word, and without a word; it accepts at ``end``."""

    label: str
    start: list[int]  # the mandatory run of words at its beginning
    by_word: list[dict[int, set[int]]] = field(default_factory=lambda: [{}])
    by_any: list[set[int]] = field(default_factory=lambda: [set()])
    free: list[set[int]] = field(default_factory=lambda: [set()])
    end: int = 0

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append(set())
        self.free.append(set())
        return len(self.free) - 1

    def word(self, at: int, value: int) -> int:
        self.by_word[at].setdefault(value, set()).add(new := self._state())
        return new

    def anything(self, at: int, most: int | None) -> int:
        end = self._state()
        self.free[at].add(end)
        if most is None:
            self.by_any[end].add(end)
            return end
        for _ in range(most):
            self.by_any[at].add(new := self._state())
            self.free[new].add(end)
            at = new
        return end

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()] - states:
                states.add(s)
                todo.append(s)
        return states

    def longest(self, tokens: np.ndarray, starts: Sequence[int] = (0,)) -> list[int]:
        """Words of the longest accepted run at each of the ascending ``starts`` of ``tokens``; 0 where there is none.

        One pass serves all starts: those that have come to the same states at a word have the same future, and go on as one
        group.  A group knows the last word at which it was accepted, and the larger group that it has become part of.
        """
        last: list[int] = []
        part_of: list[int] = []

        def group(*parts: int) -> int:
            last.append(0)
            part_of.append(-1)
            for g in parts:
                part_of[g] = len(last) - 1
            return len(last) - 1

        values, todo, of = tokens.tolist(), list(reversed(starts)), {}
        begin, active, at = frozenset(self.closed({0})), {}, 0
        while todo or active:
            at = at if active else todo[-1]
            if at >= len(values):
                break
            if todo and todo[-1] == at:
                of[todo.pop()] = own = group()
                active[begin] = group(own, active[begin]) if begin in active else own
            after: dict[frozenset[int], int] = {}
            for states, g in active.items():
                new = frozenset(self.closed({t for s in states for t in self.by_word[s].get(values[at], _NOWHERE) | self.by_any[s]}))
                if new:
                    after[new] = group(g, after[new]) if new in after else g
            at += 1
            for states, g in after.items():
                if self.end in states:
                    last[g] = at
            active = after
        past = [0] * len(last)
        for g in reversed(range(len(last))):  # a larger group came later, and so did what happened to it
            past[g] = (past[part_of[g]] if part_of[g] >= 0 else 0) or last[g]
        return [max(past[of[s]] - s, 0) if s in of else 0 for s in starts]


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of a template, which has to begin with two mandatory words at least, after optional ones if any."""
    parts = MARK.split(markup)
    lead, depth, anchored = [], 0, False
    for i, part in enumerate(parts):  # the first run of mandatory words outside of all regions
        if i % 2:
            depth += {"beginOptional": 1, "endOptional": -1}.get(part, 0)
            anchored |= bool(lead)
        elif not depth and not anchored:
            lead = _hashes(part)
    if len(lead) < 2:
        raise ValueError(f"the template of {label} needs two mandatory words before any other region")
    out, at, opened, begun = Automaton(label, lead), 0, [], False
    for i, part in enumerate(parts):
        if i % 2 and part == "beginOptional":
            opened.append(at)
        elif i % 2 and part == "endOptional":
            if not opened:
                raise ValueError(f"the template of {label} ends a region that it did not begin")
            out.free[opened.pop()].add(end := out._state())
            out.free[at].add(end)
            at = end
        elif i % 2:
            most = re.search(r"max=([0-9]+)", part)
            at = out.anything(at, int(most[1]) if most else None)
        else:
            own = _hashes(part)
            if own and not opened and not begun:  # the anchor; optional words before it can't make a text that lacks it fit
                begun = True
                at = 0
                out.by_word, out.by_any, out.free = [{}], [set()], [set()]
            for value in own:
                at = out.word(at, value)
    if opened:
        raise ValueError(f"the template of {label} does not end a region")
    out.end = at
    return out


def _doc_of(found: Words) -> np.ndarray:
    return np.repeat(np.arange(len(found.bounds) - 1), found.counts())


def places(found: Words, doc: np.ndarray, phrase: Sequence[int]) -> np.ndarray:
    """Words at which the words of ``phrase`` begin to stand, all in one document."""
    m = len(phrase)
    if len(found.hash) < m:
        return np.zeros(0, np.int64)
    hit = np.flatnonzero(found.hash[: len(found.hash) - m + 1] == np.uint64(phrase[0]))
    hit = hit[doc[hit] == doc[hit + m - 1]]
    for k, value in enumerate(phrase):
        if not len(hit):
            break
        hit = hit[found.hash[hit + k] == np.uint64(value)]
    return hit


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and what each whole text says of licenses.

    ``n_words``; ``n_base``, ``first_word`` and ``last_word``: number, smallest and largest start of
    the phrases' places, overlapping ones too; ``base_labels``, and ``labels`` with those of the
    templates, distinct, sorted and joined by commas; ``spans``: label, first word and number of words
    of each template match; ``score``: the share of words that places and matches cover.
    A null or empty text has no words and the score 0.  Other columns are not returned.
    """
    base = [(label, _hashes(text)) for label, text in phrases]
    automata = [compile_template(label, text) for label, text in templates]
    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL(
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, spans array<struct<label:string,first:long,words:long>>, score double").fields])
    names = schema.names
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))

    def look(texts: pa.Array) -> list[pa.Array]:
        found = words(texts, LOWER_ALNUM, lower=True)
        doc, n = _doc_of(found), len(texts)
        covered = np.zeros(len(doc) + 1, np.int64)
        starts, base_labels = [[] for _ in range(n)], [set() for _ in range(n)]
        spans = [[] for _ in range(n)]
        for label, phrase in base:
            for w in places(found, doc, phrase).tolist():
                starts[doc[w]].append(w - int(found.bounds[doc[w]]))
                base_labels[doc[w]].add(label)
                covered[w] += 1
                covered[w + len(phrase)] -= 1
        for automaton in automata:
            at = places(found, doc, automaton.start)
            for d in np.unique(doc[at]):
                begin = int(found.bounds[d])
                own = (at[doc[at] == d] - begin).tolist()
                for w, size in zip(own, automaton.longest(found.hash[begin : found.bounds[d + 1]], own), strict=True):
                    if size:
                        spans[d].append({"label": automaton.label, "first": w, "words": size})
                        covered[begin + w] += 1
                        covered[begin + w + size] -= 1
        inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
        count = found.counts()
        share = np.diff(inside[found.bounds]) / np.maximum(count, 1)
        all_labels = [b | {s["label"] for s in x} for b, x in zip(base_labels, spans, strict=True)]
        return [
            pa.array(count, pa.int64()), pa.array([len(x) for x in starts], pa.int64()), pa.array([min(x, default=None) for x in starts], pa.int64()), pa.array([max(x, default=None) for x in starts], pa.int64()),
            pa.array([",".join(sorted(x)) for x in base_labels], pa.string()), pa.array([",".join(sorted(x)) for x in all_labels], pa.string()), pa.array(spans, span_type), pa.array(share, pa.float64()),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in segments(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *look(batch.column(1)[i:j])], names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
