"""Licence scans: matching statistics of whole texts against a generalised suffix automaton of licence tokens.

The automaton holds every template and every base phrase, word by word; of each state it knows all places in them where
its words end. A text streams through it once; at each word the state tells the longest run of words, ending there, that
occurs in any template. Places of the base phrases and long matches are read off the states. Long matches that follow
each other in a text and in a template are chained into spans. A span adds its template's label if it covers enough of
the template's words, and enough of its runs of words that tell its licence from the others.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, batch_of, keyed, map_batches

# Phrases whose every place counts, and paragraphs of public licence texts and of the notices that they ask for.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
    "boost": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "cc0": ("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",),
}

#: A match counts from MIN_MATCH words on; matches of a template chain over at most MAX_GAP words; a span must cover
#: MIN_COVER of its template's words, and of its runs of MIN_MATCH words that no other licence's templates hold, for its label to count.
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 6, 0.5

_OTHER = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _OTHER, bytes(range(97, 123)) + b" " * len(_OTHER))


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z in lower case."""
    return text.translate(_FOLD).split()


@dataclass
class Automaton:
    """Generalised suffix automaton over word ids.

    Of each state: the transitions, the suffix link, the greatest length and, once `settle` has run, all places (name,
    last position) where its words end.
    """

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    places: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, step: dict, link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.step) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(dict(self.step[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, ids: Iterable[int], name: int) -> None:
        last = 0
        for k, c in enumerate(ids):
            last = self.extend(last, c)
            self.places[last].append((name, k))

    def settle(self) -> None:
        """Give every state the places of the longer ones that end with its words."""
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.places[self.link[s]] += self.places[s]


class LicenseIndex:
    """Automaton, vocabulary and templates, built once and sent to the executors; its size is that of the templates."""

    def __init__(self, phrases: dict[str, str] | None = None, templates: dict[str, tuple[str, ...]] | None = None, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> None:
        phrases = BASE_PHRASES if phrases is None else phrases
        templates = TEMPLATES if templates is None else templates
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = Automaton()
        number = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text.encode())]
        self.templates = [(label, number(text)) for label, texts in templates.items() for text in texts]
        self.phrases = [(label, number(text)) for text, label in phrases.items()]
        for k, (_, ids) in enumerate(self.templates + self.phrases):
            self.automaton.add(ids, k)
        self.automaton.settle()
        # Of each state, the phrases that end where its words end: those that are its longest words, and those of its suffix link.
        first, auto = len(self.templates), self.automaton
        self.ends: list[list[int]] = [[] for _ in auto.step]
        for s in sorted(range(1, len(auto.step)), key=auto.length.__getitem__):
            own = [p - first for p, k in auto.places[s] if p >= first and k + 1 == len(self.phrases[p - first][1]) == auto.length[s]]
            self.ends[s] = own + self.ends[auto.link[s]]
        self.shortest = min([len(ids) for _, ids in self.phrases] + [min_match])
        holders: dict[tuple[int, ...], set[str]] = defaultdict(set)
        runs = lambda ids: ((j, tuple(ids[j : j + min_match])) for j in range(len(ids) - min_match + 1))
        for label, ids in self.templates:
            for _, run in runs(ids):
                holders[run].add(label)
        # Of each template, where the runs of min_match words begin that no other licence's templates hold.
        self.telling = [{j for j, run in runs(ids) if len(holders[run]) == 1} for _, ids in self.templates]

    def stream(self, ids: list[int]) -> Iterable[tuple[int, int, int]]:
        """(word, state, matched length) for each word of ids: the matching statistics."""
        step, link, length = self.automaton.step, self.automaton.link, self.automaton.length
        state = matched = 0
        for k, c in enumerate(ids):
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            if c in step[state]:
                state = step[state][c]
                matched += 1
            yield k, state, matched

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of known words long enough to hold a phrase or a long match. An unknown word ends every match."""
        known = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(known))
        lo, hi = edges[::2], edges[1::2]
        keep = hi - lo >= self.shortest
        return list(zip(lo[keep].tolist(), hi[keep].tolist(), strict=True))

    def scan(self, words: list[bytes]) -> dict:
        """Base places (start, label), long matches (start, size, state) and spans (start, end, label, covered part)."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        base, matches = [], []
        for lo, hi in self._runs(ids):
            last, held = 0, 0
            for k, state, matched in self.stream(ids[lo:hi].tolist()):
                for p in self.ends[state]:
                    if len(self.phrases[p][1]) <= matched:
                        base.append((lo + k + 1 - len(self.phrases[p][1]), self.phrases[p][0]))
                if matched != held + 1 and held >= self.min_match:
                    matches.append((lo + k - held, held, last))
                last, held = state, matched
            if held >= self.min_match:
                matches.append((hi - held, held, last))
        return {"n_words": len(words), "base": sorted(base), "matches": matches, "spans": self._spans(matches)}

    def _spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Of each template the chains of matches that cover most of it, none of which share a match."""
        placed: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # (start in the text, start in the template, words)
        for start, size, state in matches:
            end = start + size
            seen: set[tuple[int, int]] = set()
            while state > 0 and size >= self.min_match:
                for k, last in self.automaton.places[state]:
                    if k < len(self.templates) and (k, last) not in seen:
                        seen.add((k, last))
                        placed[k].append((end - size, last + 1 - size, size))
                state = self.automaton.link[state]
                size = self.automaton.length[state]
        spans = []
        for k, parts in placed.items():
            label, template = self.templates[k]
            for chain in self._chains(sorted(parts)):
                held = {j + d for _, j, n in chain for d in range(n)}
                covered, telling = len(held) / len(template), self.telling[k]
                told = {j + d for _, j, n in chain for d in range(n - self.min_match + 1)} & telling
                if covered >= self.min_cover and telling and len(told) >= self.min_cover * len(telling):
                    spans.append((chain[0][0], chain[-1][0] + chain[-1][2], label, covered))
        return sorted(spans)

    def _chains(self, parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        """Chains of parts that go on in text and template over gaps of max_gap words at most, the longest first."""
        best: list[tuple[int, int]] = []  # (words covered by the best chain that ends here, the part before)
        near: deque[int] = deque()
        for i, (start, at, n) in enumerate(parts):
            near = deque(x for x in near if parts[x][0] + parts[x][2] + self.max_gap >= start)
            own = (n, -1)
            for x in near:
                s, a, m = parts[x]
                if s < start and a < at and a + m < at + n:
                    own = max(own, (best[x][0] + n - max(0, a + m - at), x))
            best.append(own)
            near.append(i)
        out, used = [], set()
        for i in sorted(range(len(parts)), key=lambda x: (-best[x][0], x)):
            chain, x = [], i
            while x >= 0 and x not in used:
                chain.append(x)
                x = best[x][1]
            if chain:
                used.update(chain)
                out.append([parts[x] for x in reversed(chain)])
        return out


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: LicenseIndex | None = None) -> DataFrame:
    """One row for each row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of base phrases; first_word and last_word are the least and largest word where one starts,
    null if none does. labels are the base labels and those of covered spans, distinct, sorted, comma-joined; "" if
    none. score is the largest part of a template that a span covers, 1 where a base phrase stands, else 0. spans are
    (start, end, label, covered). A null text counts as empty: no words. Repeated rows give repeated rows, a null id
    stays null, other columns are not read, and an empty table gives an empty table.
    """
    index = index or LicenseIndex()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.float64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]

    def row(text: bytes) -> tuple:
        found = index.scan(words_of(text))
        base, spans = found["base"], found["spans"]
        labels = {x[1] for x in base}
        score = 1.0 if base else max([0.0, *(x[3] for x in spans)])
        first, last = (base[0][0], base[-1][0]) if base else (None, None)
        rows = [dict(zip(("start", "end", "label", "covered"), x, strict=True)) for x in spans]
        return found["n_words"], len(base), first, last, ",".join(sorted(labels)), ",".join(sorted(labels | {x[2] for x in spans})), score, rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [row(x) for x in as_bytes(batch.column(1))]
        return batch_of(names, [batch.column(0), *map(list, zip(*rows, strict=True))], types)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, end: long, label: string, covered: double>>"
    return map_batches(keyed(df, id_col, text_col), run, schema)
