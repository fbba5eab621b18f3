"""License scans: normalised text against licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Container, Iterator
from dataclasses import dataclass
from importlib.resources import files
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame

# Wording of public licences, of their headers and of the notices that name them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the "
        "License.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        'COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
        "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
        "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        'specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
        "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY "
        "OF SUCH DAMAGE.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
        "subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this "
        "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative "
        "works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated "
        'by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL "
        "THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        'that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        'in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
        "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate "
        "any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at "
        "large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        'perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT '
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE. For more information, please refer to <https://unlicense.org>",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
        "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
        "altered from any source distribution.",
    ),
}
#: The whole texts of licences too long to stand here, as published; a file each, named after its licence.
TEXTS = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in files(__package__).joinpath("license_texts").iterdir()}
#: All that is looked for unless told otherwise.
EVERY = TEMPLATES | {name: (*TEMPLATES.get(name, ()), text) for name, text in TEXTS.items()}
WORD = re.compile("[a-z0-9]+")
LINE_END = re.compile("\r\n|\r|\n")


def bigrams(text: str) -> frozenset[str]:
    """Distinct word pairs of the normalised text: lower case, runs of ASCII letters and digits."""
    words = WORD.findall(text.lower())
    return frozenset(map(" ".join, zip(words, words[1:])))


@dataclass(frozen=True)
class Scanner:
    """Templates with the sizes that a unit may have to reach the threshold against each; a licence may have several."""

    templates: tuple[tuple[str, frozenset[str], int, int], ...]
    known: frozenset[str]
    least: int
    most: int
    dice: float

    @classmethod
    def of(cls, templates: dict[str, tuple[str, ...]], dice: float) -> Scanner:
        """Dice of at least d needs sizes within d / (2 - d) of each other."""
        rows = []
        for name, text in sorted((name, text) for name, forms in templates.items() for text in forms):
            if own := bigrams(text):
                rows.append((name, own, ceil(len(own) * dice / (2 - dice) - 1e-9), floor(len(own) * (2 - dice) / dice + 1e-9)))
        known = frozenset().union(*(r[1] for r in rows)) if rows else frozenset()
        return cls(tuple(rows), known, min((r[2] for r in rows), default=1), max((r[3] for r in rows), default=0), dice)

    def unit(self, text: str) -> dict[int, float]:
        """Scores of the templates, by their places, that the whole of the text reaches."""
        own = bigrams(text)
        if not self.least <= len(own) <= self.most or own.isdisjoint(self.known):
            return {}
        out = {}
        for k, (_, template, low, high) in enumerate(self.templates):
            if low <= len(own) <= high:
                score = 2 * len(own & template) / (len(own) + len(template))
                if score >= self.dice - 1e-12:
                    out[k] = score
        return out

    def document(self, text: str | None) -> dict[str, tuple[float, int]]:
        """Best score and number of distinct units, or of runs if there is no unit, for each licence that the text holds."""
        found: dict[str, tuple[float, int]] = {}
        if text:
            lines = text.split("\n")
            units = {*lines, *text.split("\n\n"), text} if len(lines) > 1 else {text}
            reached: set[int] = set()
            for u in units:
                best = self.unit(u)
                reached.update(best)
                for name in {self.templates[k][0] for k in best}:
                    score, n = found.get(name, (0.0, 0))
                    found[name] = (max(score, *(x for k, x in best.items() if self.templates[k][0] == name)), n + 1)
            for name, (score, n) in self.runs(text, reached).items():
                best_unit, units_of = found.get(name, (0.0, n))
                found[name] = (max(score, best_unit), units_of)
        return found

    def runs(self, text: str, but: Container[int] = ()) -> dict[str, tuple[float, int]]:
        """Best score over all runs of consecutive lines, and the number of runs apart of one template, for each licence, by all templates but those.

        A run that reaches the threshold shares ``low`` pairs at least, so a text with fewer has
        none. It stays one, of no lower score, without the lines at its start in which no pair of
        the template starts; so only the other lines are tried as starts. From each, the distinct
        pairs are gone through in the order of their first places, up to the size bound.
        """
        if len(lines := LINE_END.split(text)) < 2:
            return {}
        words: list[str] = []
        ends = []  # for each word, the place of its line's last word
        starts = []
        for line in lines:
            if own := WORD.findall(line.lower()):
                starts.append(len(words))
                words += own
                ends += [len(words) - 1] * len(own)
        pairs = list(map(" ".join, zip(words, words[1:])))
        there = self.known.intersection(pairs)
        wanted = [(k, *t) for k, t in enumerate(self.templates) if k not in but and len(there) >= t[2] and len(there & t[1]) >= t[2]]
        if not wanted:
            return {}
        most = max(t[4] for t in wanted)
        hits: dict[int, list[tuple[float, int, int]]] = {t[0]: [] for t in wanted}
        ahead: OrderedDict[str, int] = OrderedDict()  # where each pair comes next, nearest first
        left = len(pairs)
        for start in reversed(starts):
            for p in range(left - 1, start - 1, -1):
                ahead[pairs[p]] = p
                ahead.move_to_end(pairs[p], last=False)
            left = min(left, start)
            tried = [t for t in wanted if any(p in t[2] for p in pairs[start : ends[start] + 1])]
            if not tried:
                continue
            near = []
            for pair, p in ahead.items():
                near.append((pair, p))
                if len(near) > most:
                    break
            for k, _, template, low, high in tried:
                same, best = 0, (0.0, 0, 0)
                for size, (pair, p) in enumerate(near[: high], 1):
                    same += pair in template
                    stop = ends[p + 1]
                    # the run may end with this line only if no other new pair lies before its end
                    if size >= low and (size == len(near) or near[size][1] >= stop):
                        best = max(best, (2 * same / (size + len(template)), start, stop))
                if best[0] >= self.dice - 1e-12:
                    hits[k].append(best)
        out: dict[str, tuple[float, int]] = {}
        for k, own in hits.items():
            apart: list[tuple[int, int]] = []
            last = len(words)
            for _, a, b in sorted(own, key=lambda x: -x[1]):
                if b < last:
                    apart.append((a, b))
                    last = a
            if own:
                score, n = out.get(self.templates[k][0], (0.0, 0))
                out[self.templates[k][0]] = (max(score, *(x[0] for x in own)), max(n, len(apart)))
        return out


def scan(
    docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, dice: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, license, dice, n_units)``: the licences of which each document holds a notice or the text.

    Compared are each whole text, its paragraphs (between empty lines) and its lines, each distinct
    unit once. A licence may have several templates (a notice, a header, the text); by default ``EVERY``. For a template that
    no unit reaches, every run of consecutive lines is compared (``\\r\\n`` and ``\\r`` end lines too).
    ``dice`` is the best score of all, rounded to six places; ``n_units`` counts the units that reach a
    template or, if there are none, the runs that don't overlap. Licences of nearly
    the same words (BSD of two and three clauses) are both reported; ``dice`` says which is nearer. Size bounds rule
    out templates before any comparison. Null and empty texts hold none; every row of a repeated id
    reports. The templates are a fixed list and go with the task; nothing is shuffled.
    """
    scanner = Scanner.of(EVERY if templates is None else templates, dice)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                rows += [(i, name, round(best, 6), n) for name, (best, n) in sorted(scanner.document(text).items())]
            at = pa.array([r[0] for r in rows], pa.int32())
            cols = [batch.column(0).take(at), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "license", "dice", "n_units"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, license string, dice double, n_units long")
