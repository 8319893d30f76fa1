"""License scans: template markup compiled to token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, chunks

#: Bytes of words: digits, a-z and everything beyond ASCII; A-Z become a-z, the rest white space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of public licences and notices, in template markup. A var's match .{a,b} takes from a to b words.
TEMPLATES = {
    "mit-text": """<<beginOptional>>The MIT License<<beginOptional>> (MIT)<<endOptional>><<endOptional>>
<<var;name="copyright";original="Copyright (c) <year> <holders>";match=".{0,60}">>
Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="thing";original="this software and associated documentation files (the "Software")";match=".{1,20}">>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice<<beginOptional>> (including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".{1,20}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """<<beginOptional>>ISC License<<endOptional>>
<<var;name="copyright";original="Copyright (c) <year> <holder>";match=".{0,60}">>
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";original="THE AUTHOR";match=".{1,20}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="holder";original="THE AUTHOR";match=".{1,20}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
<<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="holder";original="the copyright holder";match=".{1,20}">> nor the names of <<var;name="whose";original="its";match=".{1,4}">> contributors may be used to endorse or promote products derived from this software without specific prior written permission.<<endOptional>>
THIS SOFTWARE IS PROVIDED BY <<var;name="holder";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".{1,20}">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="holder";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".{1,20}">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
<<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.""",
    "mit-notice": """<<beginOptional>>This <<var;name="work";original="software";match=".{1,4}">> is <<endOptional>>released under the MIT License""",
    "apache-2.0-notice": """Licensed under the Apache License<<beginOptional>>,<<endOptional>> Version 2.0""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
<<var;name="address";original="http://www.apache.org/licenses/LICENSE-2.0";match=".{1,10}">>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;name="address";original="https://mozilla.org/MPL/2.0/";match=".{1,8}">>""",
    "gpl-header": """<<var;name="work";original="This program";match=".{1,6}">> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser <<endOptional>><<beginOptional>>Affero <<endOptional>>General Public License as published by the Free Software Foundation<<beginOptional>>,<<endOptional>> either version <<var;name="version";original="3";match=".{1,2}">> of the License, or (at your option) any later version.""",
    "gpl-notice": """<<beginOptional>>This <<var;name="work";original="program";match=".{1,4}">> is <<endOptional>>licensed under the GNU General Public License<<beginOptional>>, version <<var;name="version";original="3";match=".{1,1}">><<endOptional>>""",
}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class Automaton:
    """step[state]: word -> next states; free[state]: states reached without a word; wild[state]: state after any word."""

    label: str
    step: list[dict[bytes, list[int]]]
    free: list[list[int]]
    wild: list[list[int]]
    final: int
    needed: list[bytes]  # runs of mandatory words, each as b" a b c "

    def __post_init__(self) -> None:
        """Before the first word that the template fixes, and after the last one, replaceable regions take no words."""
        back: list[list[int]] = [[] for _ in self.step]
        for s, (free, wild) in enumerate(zip(self.free, self.wild, strict=True)):
            for t in (*free, *wild):
                back[t].append(s)
        ahead = [[*f, *w] for f, w in zip(self.free, self.wild, strict=True)]
        self.begin, self.end = _reached({0}, ahead), _reached({self.final}, back)
        self.first = {w for s in self.begin for w in self.step[s]}

    def spans(self, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
        """Leftmost longest matches, not overlapping, from the first fixed word to the last."""
        if any(run not in joined for run in self.needed):
            return []
        out, i = [], 0
        while i < len(words):
            end = -1
            if words[i] in self.first:
                states, j, fresh = self.begin, i, True
                while states and j < len(words):
                    fixed = _reached({t for s in states for t in self.step[s].get(words[j], ())}, self.free)
                    states = fixed if fresh else fixed | _reached({t for s in states for t in self.wild[s]}, self.free)
                    fresh, j = False, j + 1
                    if not self.end.isdisjoint(fixed):
                        end = j
            if end > 0:
                out.append((i, end))
            i = max(i + 1, end)
        return out


def _reached(states: set[int], edges: list[list[int]]) -> set[int]:
    out, todo = set(states), list(states)
    while todo:
        for s in edges[todo.pop()]:
            if s not in out:
                out.add(s)
                todo.append(s)
    return out


def compile_template(label: str, markup: str) -> Automaton:
    """Template markup -> automaton. Optional regions may nest."""
    step, free, wild, opened, needed, run = [{}], [[]], [[]], [], [], []

    def new() -> int:
        step.append({}), free.append([]), wild.append([])
        return len(step) - 1

    def ended() -> None:
        if run:
            needed.append(b" " + b" ".join(run) + b" ")
            run.clear()

    at = 0
    for part in re.split(r"(<<.*?>>)", markup, flags=re.S):
        if part == "<<beginOptional>>":
            ended()
            opened.append(at)
        elif part == "<<endOptional>>":
            begin, after = opened.pop(), new()
            free[at].append(after)
            free[begin].append(after)
            at = after
            run.clear()
        elif part.startswith("<<var"):
            ended()
            low, high = map(int, re.search(r"\.\{(\d+),(\d+)\}", part).groups())
            for k in range(high):
                after = new()
                wild[at].append(after)
                if k >= low:
                    free[at].append(after)
                at = after
        else:
            for word in words_of(part.encode()):
                after = new()
                step[at].setdefault(word, []).append(after)
                at = after
                if not opened:
                    run.append(word)
    ended()
    if opened:
        raise ValueError(f"{label}: an optional region isn't closed")
    return Automaton(label, step, free, wild, at, needed)


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Words at which the phrase starts; joined and phrase have a blank before and after every word."""
    out, at, seen, word = [], joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = joined.find(phrase, at + 1)
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Phrase places and accepted templates in every whole text.

    Returns doc_id, n_words, n_base, first_word, last_word (null: no place), base_labels, labels
    (base and templates; distinct, sorted, comma-joined, empty string if none), score (share of the
    words that places and accepted spans cover; 0 without words), spans (label, start, end in words).
    A template is accepted where its mandatory words stand consecutively, optional regions present
    or not, replaceable ones with as many words as they allow; a replaceable region at a match's edge isn't part of it. Null and
    empty texts have no words. Very long texts are scanned whole, in time that grows with their words. Null ids are handed on,
    repeated rows each have their row, other columns play no part, and an empty table gives no rows.
    """
    phrases = PHRASES if phrases is None else phrases
    automata = [compile_template(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]
    sought = [(b" " + p.encode() + b" ", len(p.split()), label) for p, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            rows = []
            for text in texts:
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                spans, base = [], []
                for phrase, n, label in sought:
                    base += [(i, i + n, label) for i in _places(joined, phrase)]
                for a in automata:
                    spans += [(a.label, i, j) for i, j in a.spans(words, joined)]
                covered = set().union(*(range(i, j) for i, j, _ in base), *(range(i, j) for _, i, j in spans)) if base or spans else ()
                starts, found = [i for i, _, _ in base], {x for _, _, x in base}
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(found)), ",".join(sorted(found | {x for x, _, _ in spans})), len(covered) / len(words) if words else 0.0, [{"label": x, "start": i, "end": j} for x, i, j in spans]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    own = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    return arrow_map(own, scan, f"doc_id {own.schema['id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>")
