"""License scans: Dice coefficient over word bigrams against license templates.

The whole text, its paragraphs, lines and sentences are normalised (lower case, letters and
digits only, copyright lines dropped) and compared with each template by the Dice coefficient
of their bigram multisets. So is every window of the words, with and without copyright lines, that
starts and ends with a bigram of the template: the best window is one of these. Two texts of a and b bigrams cannot exceed 2 min(a, b) / (a + b), so a
unit only meets the templates within those bounds, found by bisection in the sorted sizes.
Texts with too few of every template's bigrams are passed over.

One pass without a shuffle; the templates are a fixed, small list. Cases: null, empty and
wordless texts match nothing; long texts are compared whole and by parts; repeated rows each
give their rows; null ids are kept; an empty table gives no rows; other columns, whatever their
names, are ignored; ties go to the larger unit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.textkit import LOWER, NON_WORD, Words, chunked, window_hash

# Public license notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEMPLATES["BSD-3-Clause"] = [TEMPLATES["BSD-2-Clause"][0] + _BSD_NAMES + _BSD_END]
TEMPLATES["BSD-2-Clause"].append(TEMPLATES["BSD-2-Clause"][0] + _BSD_END)
#: Whole license texts, by file name.
for _file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    TEMPLATES.setdefault(_file.stem, []).append(_file.read_text(encoding="utf-8"))

RESULT = "doc_id long, license string, dice double, unit string, unit_words int"
_BARE, _SENTENCE, _PARAGRAPH = re.compile(r"[^0-9a-z\x80-\U0010ffff]+"), re.compile(r"(?<=[.;!?])\s+"), re.compile(r"\n\s*\n")
_COPYRIGHT = re.compile(r"^\s*(?:copyright|\(c\)|©).*$", re.I | re.M)


def words_of(text: str) -> list[str]:
    return [w for w in _BARE.split(text.lower()) if w]


def bigrams(text: str) -> Counter:
    words = words_of(_COPYRIGHT.sub(" ", text))
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


class Templates:
    def __init__(self, templates: dict[str, list[str]]):
        rows = sorted(((sum((b := bigrams(t)).values()), name, b) for name, texts in templates.items() for t in texts), key=lambda r: r[:2])
        self.sizes, self.rows = [r[0] for r in rows], rows
        self.places: dict[tuple, list[tuple[int, int]]] = {}
        self.caps = []
        for k, (_, _, b) in enumerate(rows):
            self.caps.append(np.array(list(b.values()), np.int64))
            for i, pair in enumerate(b):
                self.places.setdefault(pair, []).append((k, i))
        raw = "\0".join(_COPYRIGHT.sub(" ", t) for texts in templates.values() for t in texts).encode()
        data = LOWER[np.frombuffer(raw, np.uint8)]
        cuts = np.flatnonzero(data == 0)
        words = Words(data, np.concatenate([[0], cuts, [len(data)]]), NON_WORD)
        both = words.owner()[1:] == words.owner()[:-1]
        h, owner = window_hash(words.hashes(), 2, 0x9FB21C651E98DF25)[both], words.owner()[1:][both]
        self.hashes, at = np.unique(h, return_inverse=True)
        self.counts = np.zeros((len(self.hashes), int(owner.max()) + 1), np.int64)
        np.add.at(self.counts, (at, owner), 1)
        marks = "copyright c ©".encode()
        self.marks = Words(np.frombuffer(marks, np.uint8), np.array([0, len(marks)]), NON_WORD).hashes()

    def possible(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> np.ndarray:
        """Texts with enough bigrams of some template. A Dice coefficient of t with b bigrams needs
        t * b / (2 - t) common ones; texts that may have copyright lines to drop pass with any."""
        words = Words(LOWER[data], offsets, NON_WORD)
        h = words.hashes()
        pairs = window_hash(h, 2, 0x9FB21C651E98DF25)
        at = np.flatnonzero(np.isin(pairs, self.hashes))
        place = np.searchsorted(self.hashes, pairs[at])
        key = np.unique(np.repeat(np.arange(len(offsets) - 1), words.counts)[at] * len(self.hashes) + place)
        doc, place = key // len(self.hashes), key % len(self.hashes)
        total = np.zeros((len(offsets) - 1, self.counts.shape[1]), np.int64)
        np.add.at(total, doc, self.counts[place])
        need = np.ceil(threshold / (2 - threshold) * self.counts.sum(0) - 1e-9)
        marked = np.zeros(len(offsets) - 1, bool)
        marked[words.owner()[np.isin(h, self.marks)]] = True
        signs = np.flatnonzero(data == 0xA9)
        marked[np.searchsorted(offsets, signs, "right") - 1] = True
        return np.flatnonzero((total >= need).any(1) | marked & (total > 0).any(1))

    def match(self, unit: Counter, threshold: float):
        """(name, dice) of templates that the size bounds admit and the threshold keeps."""
        a = sum(unit.values())
        low, high = a * threshold / (2 - threshold), a * (2 - threshold) / threshold
        for _, name, b in self.rows[bisect_left(self.sizes, low - 1e-9) : bisect_right(self.sizes, high + 1e-9)]:
            if (d := dice(unit, b)) >= threshold:
                yield name, d

    def windows(self, text: str, threshold: float):
        """(name, dice, words) of the best window of each template that reaches the threshold."""
        stripped = _COPYRIGHT.sub(" ", text)
        for part in (text, stripped) if stripped != text else (text,):
            words = words_of(part)
            hits: dict[int, list[tuple[int, int]]] = {}
            for at, pair in enumerate(zip(words, words[1:], strict=False)):
                for k, i in self.places.get(pair, ()):
                    hits.setdefault(k, []).append((at, i))
            for k, found in hits.items():
                size, name, _ = self.rows[k]
                if len(found) < threshold / (2 - threshold) * size - 1e-9:
                    continue
                if (got := best_window(np.array(found, np.int64), self.caps[k], size, threshold))[0] >= threshold:
                    yield name, got[0], got[1] + 1


def best_window(found: np.ndarray, caps: np.ndarray, size: int, threshold: float) -> tuple[float, int]:
    """Largest Dice coefficient and bigrams of a window, the longer of equals. ``found`` has the places of template
    bigrams and which they are, ``caps`` how often the template has each."""
    at, which = found[:, 0], found[:, 1]
    stops = np.searchsorted(at, at + int(size * (2 - threshold) / threshold + 1e-9), "left")
    order = np.argsort(which, kind="stable")
    nth = np.empty(len(at), np.int64)
    nth[order] = np.arange(len(at)) - np.searchsorted(which[order], which[order])
    best, gone = (0.0, 0), np.zeros(len(caps), np.int64)
    need = threshold / (2 - threshold) * size - 1e-9
    for s, e in enumerate(stops):
        if e - s >= need:
            w = which[s:e]
            d = 2 * np.cumsum(nth[s:e] - gone[w] < caps[w]) / (at[s:e] - at[s] + 1 + size)
            j = len(d) - 1 - int(np.argmax(d[::-1]))
            best = max(best, (float(d[j]), int(at[s + j] - at[s] + 1)))
        gone[which[s]] += 1
    return best


def units(text: str):
    """The text and its parts, larger ones first."""
    yield "text", text
    for p in _PARAGRAPH.split(text) if "\n\n" in text else ():
        yield "paragraph", p
    for line in text.split("\n") if "\n" in text else ():
        yield "line", line
    for line in text.split("\n"):
        parts = _SENTENCE.split(line)
        if len(parts) > 1:
            for s in parts:
                yield "sentence", s


def scan(docs: DataFrame, threshold: float = 0.9, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each document and license found, with the best unit."""
    chosen = templates or TEMPLATES

    def run(batches):
        table = Templates(chosen)
        for batch, data, offsets in chunked(batches):
            rows = []
            for k in table.possible(data, offsets, threshold):
                best: dict[str, tuple] = {}
                text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                for kind, unit in units(text):
                    b = bigrams(unit)
                    for name, d in table.match(b, threshold) if b else ():
                        if name not in best or d > best[name][0]:
                            best[name] = (d, kind, sum(b.values()) + 1)
                for name, d, n in table.windows(text, threshold):
                    if name not in best or d > best[name][0]:
                        best[name] = (d, "window", n)
                rows += [(batch.column("doc_id")[int(k)].as_py(), name, *best[name]) for name in sorted(best)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int32()), strict=True)], ["doc_id", "license", "dice", "unit", "unit_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)
