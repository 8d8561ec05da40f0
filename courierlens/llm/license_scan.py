"""License scans by patience alignment.

A text is aligned with a template as patience diff does: words that occur once
in both are anchors, the longest increasing run of their places is kept, and
the gaps between anchors are aligned the same way; a gap without anchors takes
the equal words at its ends. The share of the template's words so aligned is
its coverage.

Coverage alone does not tell one license from its neighbours, which differ in a
word: a template therefore has marks (its name, variant and version), and each
must be aligned; and a range that holds another variant's qualifier, such as
"Affero" or "NonCommercial", is not this license, nor is a short notice with a
foreign word in it, such as "Modified".

A text is aligned in ranges around the places where a key of the template
stands; a key is a mark, or one of the template's longest words, of which so
many are keys that none can be spared. Where repeats hide the anchors, a
longest common subsequence of the range is taken; it needs no anchors.
Every occurrence comes out; where ranges overlap, the one with the most aligned
words does, so a notice is not also reported as the shorter notice inside it.

Defined results: null, empty and wordless texts match nothing; texts of any
length are read whole, with memory in proportion to the text; rows with null
ids are scanned and keep the null; repeated rows are scanned each; of equal
overlapping hits the template named first comes out; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.llm.tables import table

COVERAGE = 0.8
#: Notices of fewer words stand for a license only if no foreign word is among them.
SHORT = 10

#: Notices of public licenses, as their authors publish them, and the marks that tell each from the others.
TEMPLATES: dict[str, tuple[str, str]] = {
    "apache-2.0-line": ("Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    "apache-2.0-name": ("Licensed under Apache License 2.0.", "apache license 2.0"),
    "mit-title": ("The MIT License (MIT)", "the mit license"),
    "gpl-2.0-title": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "general public license 2 1991"),
    "gpl-3.0-title": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "general public license 3 29 2007"),
    "lgpl-3.0-title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "lesser general public license 3 29 2007"),
    "agpl-3.0-title": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "affero general public license 3 19 2007"),
    "mit-line": ("Released under the MIT License.", "mit license"),
    "bsd-line": ("Released under the BSD License.", "bsd license"),
    "gpl-2.0-line": ("This work is licensed under the GNU General Public License, version 2.", "general public license 2"),
    "gpl-3.0-line": ("This work is licensed under the GNU General Public License, version 3.", "general public license 3"),
    "cc-by-4.0-short": ("Licensed under CC BY 4.0.", "cc by 4.0"),
    "cc-by-sa-4.0-short": ("Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    "cc-by-nc-4.0-line": ("Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    "cc-by-nc-sa-4.0-short": ("Licensed under CC BY-NC-SA 4.0.", "cc by-nc-sa 4.0"),
    "cc-by-nd-4.0-short": ("Licensed under CC BY-ND 4.0.", "cc by-nd 4.0"),
    "cc-by-4.0-line": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4.0"),
    "cc-by-sa-4.0-line": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution-sharealike 4.0"),
    "cc-by-nc-4.0-long-line": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution-noncommercial 4.0"),
    "cc-by-nd-4.0-line": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "creative commons attribution-noderivatives 4.0"),
    "cc0-1.0-line": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", "dedicated public domain"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mozilla public license 2.0"),
    "epl-2.0-notice": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "eclipse public license 2.0"),
    "apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "apache license 2.0"),
    "mit": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.', ""),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "fee"),
    "bsl-1.0": ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:', "organization"),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", ""),
    "bsd-2-clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ""),
    "bsd-3-clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "neither endorse"),
    "gpl-2.0-notice": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "general public 2"),
    "gpl-3.0-notice": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "general public 3"),
    "lgpl-2.1-notice": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lesser general public 2.1"),
    "lgpl-3.0-notice": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "lesser general public 3"),
    "agpl-3.0-notice": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "affero general public 3"),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered"),
    **{f"spdx-{i.lower()}": (f"SPDX-License-Identifier: {i}", f"spdx-license-identifier {i.lower()}") for i in "MIT ISC Apache-2.0 BSD-2-Clause BSD-3-Clause MPL-2.0 GPL-2.0 GPL-3.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-or-later AGPL-3.0-or-later EPL-2.0 CC0-1.0 Unlicense".split()},
}
#: Words that make another license of one that does not have them.
QUALIFIERS = frozenset("affero lesser library noncommercial nc sharealike sa noderivatives noderivs nd".split())

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_at(text: str) -> list[tuple[str, int, int]]:
    """The lower-cased words of a text and their character spans."""
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing run, by patience piles."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back[i] = ends[p - 1] if p else -1
        tops[p:p + 1], ends[p:p + 1] = [v], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _once(words: list[str], lo: int, hi: int) -> dict[str, int]:
    at: dict[str, int] = {}
    for i in range(lo, hi):
        at[words[i]] = -1 if words[i] in at else i
    return {w: i for w, i in at.items() if i >= 0}


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once = _once(b, b0, b1)
        shared = [(i, once[w]) for w, i in sorted(_once(a, a0, a1).items(), key=lambda x: x[1]) if w in once]
        kept = [shared[k] for k in increasing([j for _, j in shared])]
        if not kept:
            continue
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def common(masks: dict[str, int], n: int, b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, by bit rows; masks: the places of each word among the n words of the other side."""
    rows, v, full = [], (1 << n) - 1, (1 << n) - 1
    for w in b:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], n, len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if not j or rows[j - 1] >> (i - 1) & 1:
            i -= 1
            out.append((i, j))
    return out[::-1]


class Template:
    """A template's words, its marks, and the keys of which a text must hold one."""

    def __init__(self, name: str, text: str, marks: str, coverage: float):
        self.name, self.words, self.marks = name, [w for w, *_ in words_at(text)], frozenset(marks.split())
        if not self.marks <= set(self.words):
            raise ValueError(f"the marks of {name} must be words of it")
        self.others = QUALIFIERS - set(self.words)
        may_miss = len(self.words) - coverage * len(self.words)
        longest = sorted(self.marks or set(self.words), key=lambda w: (-len(w), w))
        self.keys: set[str] = set()
        for w in longest[:1] if self.marks else longest:
            if sum(x in self.keys for x in self.words) > may_miss:
                break
            self.keys.add(w)
        self.masks = {w: sum(1 << i for i, x in enumerate(self.words) if x == w) for w in self.words}
        self.places = {w: [i for i, x in enumerate(self.words) if x == w] for w in self.keys}

    def is_in(self, words: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether the aligned words hold every mark, and what is between them no other variant's qualifier."""
        if not self.marks <= {self.words[i] for i, _ in pairs}:
            return False
        if len(self.words) < SHORT and pairs[-1][1] - pairs[0][1] > pairs[-1][0] - pairs[0][0]:
            return False  # a foreign word makes another license of a short notice
        return self.others.isdisjoint(words[pairs[0][1] : pairs[-1][1] + 1])


def hits(words: list[str], t: Template, coverage: float) -> Iterator[tuple[int, float, int, int]]:
    """(aligned words, coverage, first, last word) of the ranges that hold a template; they may overlap."""
    n = len(t.words)
    starts = sorted({i - k for i, w in enumerate(words) if w in t.keys for k in t.places[w]})
    enough = _overlaps(words, t.words, 2 * n) if starts else []
    for start in starts:
        wide = max(0, start - n // 2), min(len(words), start + n + n // 2)
        if enough[wide[0]] < coverage * n:
            continue
        best: list[tuple[int, int]] = []
        for lo, hi in ((max(0, start), min(len(words), start + n)), wide):
            part = words[lo:hi]
            for pairs in (align(t.words, part), None):
                pairs = common(t.masks, n, part) if pairs is None else pairs
                if len(pairs) > len(best) and t.is_in(part, pairs):
                    best = [(i, lo + j) for i, j in pairs]
                if len(best) >= coverage * n:
                    break
            if len(best) == n:
                break
        if len(best) >= coverage * n and best:
            yield len(best), len(best) / n, best[0][1], best[-1][1]


def scan(text: str, templates: list[Template], coverage: float) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) of every notice that a text holds, places in characters, in the order of the text."""
    found = words_at(text)
    words = [w for w, *_ in found]
    have = set(words)
    every = [(-n, -share, last - first, k, first, last) for k, t in enumerate(templates) if t.keys & have for n, share, first, last in hits(words, t, coverage)]
    taken: list[tuple[int, int, str, float]] = []
    for _, share, _, k, first, last in sorted(set(every)):
        at = bisect_left(taken, (last + 1,))  # those before it start no later than this one ends
        if at and taken[at - 1][1] >= first:
            continue
        taken.insert(at, (first, last, templates[k].name, -share))
    return [(name, share, found[first][1], found[last][2]) for first, last, name, share in taken]


def _overlaps(words: list[str], wanted: list[str], size: int) -> list[int]:
    """How many wanted words, each as often as it is wanted, stand in the range of this size from each place on."""
    limit, have, n, out = Counter(wanted), Counter[str](), 0, []
    for i in range(-size, len(words)):
        if i + size < len(words):
            w = words[i + size]
            have[w] += 1
            n += have[w] <= limit[w]
        if i >= 0:
            out.append(n)
            w = words[i]
            n -= have[w] <= limit[w]
            have[w] -= 1
    return out


def _holds(low: str, keys: list[str]) -> bool:
    return any(k in low for k in keys)


def licenses(docs: DataFrame, coverage: float = COVERAGE, templates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, license, coverage, start, end) of every license notice that a document holds.

    templates: name -> (text, marks), the marks being words of the text that must be aligned.
    """
    texts = dict(templates or TEMPLATES)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(k, *v, coverage) for k, v in texts.items()]
        keys = {w for t in known for w in t.keys}
        keys = sorted(w for w in keys if not any(x != w and x in w for x in keys))  # a part of a key tells as much
        for batch in batches:
            rows = [(i, *hit) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if text and _holds(text.lower(), keys) for hit in scan(text, known, coverage)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "license", "coverage", "start", "end"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(of, "doc_id long, license string, coverage double, start long, end long")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice found in a document."""
    return licenses(table(spark, sf_dir, "documents"))
