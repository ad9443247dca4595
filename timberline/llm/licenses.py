"""License scans by an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import materialize, read_table, spread

#: Fixed: the phrases that count wherever their words stand consecutively.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Fixed: notices and license texts, as their publishers word them. Punctuation and case don't count.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software
Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for
more details. You should have received a copy of the GNU {0}"""
_CC = "licensed under a Creative Commons {} 4.0 International License"
TEMPLATES = {
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. """
        + _WARRANTY
        + """ OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "SPDX-License-Identifier: MIT",
        "released under the MIT license",
        "licensed under the MIT license",
    ],
    "apache-2": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
        "SPDX-License-Identifier: Apache-2.0",
        "licensed under the Apache License, Version 2.0",
    ],
    "bsd-2": [_BSD, "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-3": [
        _BSD
        + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission.""",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
        "SPDX-License-Identifier: ISC",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software.""",
        "SPDX-License-Identifier: Zlib",
    ],
    "bsl": [
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
        derivative works of the Software""",
        "Distributed under the Boost Software License, Version 1.0",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "gpl-2": [_GNU.format("General Public License", "2"), "SPDX-License-Identifier: GPL-2.0", "under the GNU General Public License version 2"],
    "gpl-3": [_GNU.format("General Public License", "3"), "SPDX-License-Identifier: GPL-3.0", "under the GNU General Public License version 3"],
    "lgpl": [_GNU.format("Lesser General Public License", "3"), _GNU.format("Lesser General Public License", "2.1"), "SPDX-License-Identifier: LGPL", "under the terms of the GNU Lesser General Public License"],
    "agpl-3": [_GNU.format("Affero General Public License", "3"), "SPDX-License-Identifier: AGPL-3.0", "under the terms of the GNU Affero General Public License"],
    "mpl-2": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [_CC.format("Attribution"), "SPDX-License-Identifier: CC-BY-4.0", "creativecommons.org/licenses/by/4.0"],
    "cc-by-sa": [_CC.format("Attribution-ShareAlike"), "SPDX-License-Identifier: CC-BY-SA-4.0", "creativecommons.org/licenses/by-sa/4.0"],
    "cc-by-nd": [_CC.format("Attribution-NoDerivatives"), "SPDX-License-Identifier: CC-BY-ND-4.0", "creativecommons.org/licenses/by-nd/4.0"],
    "cc-by-nc": [_CC.format("Attribution-NonCommercial"), "licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0", "creativecommons.org/licenses/by-nc/4.0"],
    "cc-by-nc-sa": [_CC.format("Attribution-NonCommercial-ShareAlike"), "licensed under CC BY-NC-SA 4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "creativecommons.org/licenses/by-nc-sa/4.0"],
    "cc-by-nc-nd": [_CC.format("Attribution-NonCommercial-NoDerivatives"), "licensed under CC BY-NC-ND 4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0", "creativecommons.org/licenses/by-nc-nd/4.0"],
    "cc0": [
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work""",
        "To the extent possible under law, the authors have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
        "SPDX-License-Identifier: CC0-1.0",
        "creativecommons.org/publicdomain/zero/1.0",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""",
        "SPDX-License-Identifier: Unlicense",
    ],
}
#: A block holds a template if it has so much of the template's distinct shingles; words of a shingle.
CONTAINED, SHINGLE = 0.8, 5
#: Words of a block; blocks begin at half of them, so a passage of that half is whole in one.
BLOCK = 512
#: Bytes that end words; letters A-Z are lower-cased.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def shingles_of(text: str) -> list[bytes]:
    """The five-word shingles of a template; a shorter one is a shingle itself."""
    ws = words_of(text)
    return [b" ".join(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))]


@dataclass
class Vocabulary:
    """Numbers of all shingles of templates and phrases, and their lengths by first word."""

    number: dict[bytes, int] = field(default_factory=dict)
    lengths: dict[bytes, tuple[int, ...]] = field(default_factory=dict)
    phrase: dict[int, str] = field(default_factory=dict)

    @classmethod
    def built(cls) -> Vocabulary:
        own = cls()
        for s in [s for ts in TEMPLATES.values() for t in ts for s in shingles_of(t)] + [b" ".join(words_of(p)) for p in PHRASES.values()]:
            own.number.setdefault(s, len(own.number))
            head, n = s.split()[0], s.count(b" ") + 1
            own.lengths[head] = tuple(sorted({*own.lengths.get(head, ()), n}))
        own.phrase = {own.number[b" ".join(words_of(p))]: label for label, p in PHRASES.items()}
        return own

    def found(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Places and numbers of the shingles that stand in a text, in order."""
        at, which = [], []
        get, number = self.lengths.get, self.number.get
        for i, w in enumerate(words):
            for n in get(w, ()):
                k = number(b" ".join(words[i : i + n]))
                if k is not None and i + n <= len(words):
                    at.append(i)
                    which.append(k)
        return at, which


@dataclass
class Index:
    """Templates as their shingles' ranks, rarest first. Among the first |T| - need + 1 of these a block that contains ``need``
    of a template must have one: the prefixes, listed by shingle.

    rivals: for each template those of other labels that hold as much of it. A block that has one of these would seem to
    hold both, so of what the template has and the rival has not, the block must also have its share; where there is nothing
    such, the rival, which says more, goes before it.
    """

    rank: dict[int, int]
    label: list[str]
    parts: list[list[int]]
    need: list[int]
    prefix: dict[int, list[tuple[int, int]]]
    rivals: list[list[tuple[int, frozenset]]]
    contained: float

    @classmethod
    def built(cls, counts: dict[int, int], contained: float = CONTAINED) -> Index:
        number = Vocabulary.built().number
        rank = {k: i for i, k in enumerate(sorted(number.values(), key=lambda k: (counts.get(k, 0), k)))}
        own = cls(rank, [], [], [], {}, [], contained)
        for label, texts in TEMPLATES.items():
            for t in texts:
                ranks = sorted({rank[number[s]] for s in shingles_of(t)})
                need = -int(-contained * len(ranks) // 1)
                for at, r in enumerate(ranks[: len(ranks) - need + 1]):
                    own.prefix.setdefault(r, []).append((len(own.label), at))
                own.label.append(label)
                own.parts.append(ranks)
                own.need.append(need)
        sets = [set(p) for p in own.parts]
        for i, a in enumerate(sets):
            own.rivals.append([(j, frozenset(a - b)) for j, b in enumerate(sets) if own.label[j] != own.label[i] and len(a & b) >= contained * len(a)])
        return own

    def matches(self, block: list[int]) -> dict[int, float]:
        """Each template that a block (sorted distinct ranks) contains, with its containment.

        A template comes up by a prefix shingle; it is dropped if the block has too few (length) or if what stands after this
        first common shingle, in template or block, is too little (position); the rest are counted.
        """
        out, seen, has = {}, set(), set(block)
        for place, r in enumerate(block):
            for t, at in self.prefix.get(r, ()):
                if t in seen:
                    continue
                seen.add(t)
                parts, need = self.parts[t], self.need[t]
                if len(block) < need or 1 + min(len(parts) - at - 1, len(block) - place - 1) < need:
                    continue
                n = sum(x in has for x in parts)
                if n >= need:
                    out[t] = n / len(parts)
        return out

    def told_apart(self, found: dict[int, float], block: list[int]) -> dict[int, float]:
        """The matches that no rival explains better."""
        has = set(block)
        own = lambda t, rest: len(rest & has) >= self.contained * len(rest) if rest else False
        return {t: c for t, c in found.items() if all(own(t, rest) or (not rest and j not in found) for j, rest in self.rivals[t])}

    def labels(self, at: list[int], which: list[int]) -> dict[str, float]:
        """Labels of all blocks of a text, given places and ranks of its shingles, each with its best containment."""
        out: dict[str, float] = {}
        half, done = BLOCK // 2, -1
        for i in at:
            for start in (i // half - 1, i // half):
                if start <= done or start < 0:
                    continue
                done = start
                lo, hi = bisect.bisect_left(at, start * half), bisect.bisect_left(at, start * half + BLOCK)
                block = sorted(set(which[lo:hi]))
                found = self.matches(block)
                for t, c in self.told_apart(found, block).items() if found else ():
                    out[self.label[t]] = max(out.get(self.label[t], 0.0), c)
        return out


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def template_hits(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, and places and numbers of the template shingles that stand in each whole text."""

    def run(batches):
        words = Vocabulary.built()
        for b in batches:
            n, places, numbers = [], [], []
            for t in b.column(1):
                ws = words_of(t.as_py())
                at, which = words.found(ws)
                n.append(len(ws))
                places.append(at)
                numbers.append(which)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.int32()))], ["doc_id", "n_words", "at", "which"])

    return spread(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id bigint, n_words bigint, at array<int>, which array<int>")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Base places and labels of each document, with what the join of its blocks with the templates adds.

    Texts are read once, whole: each leaves the few shingles that some template has, in the shared folder. Their counts in all
    documents order the join, which then works on these alone; templates and counts, some thousand numbers, are
    broadcast. A null or empty text has no words and no labels, score 0; long texts go block by block; repeated
    rows have a result each; extra columns are ignored; an empty table gives none.
    """
    hits = materialize(template_hits(docs), "license-hits")
    counts = {r["k"]: r["n"] for r in hits.select(F.explode(F.array_distinct("which")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(Index.built(counts))

    def run(batches):
        index, phrase = shared.value, Vocabulary.built().phrase
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            rows = []
            for at, which in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                places = [i for i, k in zip(at, which) if k in phrase]
                base = {phrase[k] for k in which if k in phrase}
                more = index.labels(at, [index.rank[k] for k in which]) if at else {}
                rows.append((len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(more))), max([1.0] * bool(base) + list(more.values()), default=0.0)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    return hits.mapInArrow(run, SCHEMA)


def op5_licenses(spark, sf_dir):
    """License places and labels of every document."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))
