"""License scans: Dice coefficient over word bigrams against licence templates.

A text's passages are runs of consecutive words, upper and lower case and punctuation put aside. The Dice coefficient of
a passage with a template counts bigrams as often as they occur in both: 2 |A and T| / (|A| + |T|). For a threshold t
it can be reached only if t / (2 - t) |T| <= |A| <= (2 - t) / t |T|; these size bounds prune templates (the text must
hold that many of the template's bigrams) and passages. The best passage begins and ends with a bigram of the template,
so trying those spans finds the exact maximum over all passages. One pass, no shuffle, whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
THRESHOLD = 0.8
#: The wording of public licences, notices first, then whole texts.
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause": "Released under the BSD 2-Clause License.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "isc": "Released under the ISC License.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This is free and unencumbered software released into the public domain.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-short": "Released under CC0 1.0 Universal.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
#: The notices of the GNU licences differ in the name only.
GNU = {"gpl": "", "lgpl": "Lesser ", "agpl": "Affero "}
for _k, _name in GNU.items():
    for _v in ("2", "2.1", "3"):
        if (_k, _v) not in (("gpl", "2.1"), ("lgpl", "2"), ("agpl", "2"), ("agpl", "2.1")):
            _full = _v if "." in _v else f"{_v}.0"
            NOTICES[f"{_k}-{_full}"] = f"This work is licensed under the GNU {_name}General Public License, version {_v}."
            NOTICES[f"{_k}-header" if _v == "3" else f"{_k}-{_full}-header"] = (
                f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_name}General Public License as published by "
                f"the Free Software Foundation, either version {_v} of the License, or (at your option) any later version."
            )
#: Those of the Creative Commons licences in the terms and the version.
CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
for _k, _name in CC.items():
    for _v, _port in (("3.0", "Unported"), ("4.0", "International")):
        NOTICES[f"cc-{_k}-{_v}"] = f"Licensed under CC {_k.upper()} {_v}."
        if (_k, _v) != ("by", "4.0"):
            NOTICES[f"cc-{_k}-{_v}-long"] = f"This work is licensed under a Creative Commons {_name} {_v} {_port} License."
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THREE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission. "
)
TEXTS = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software. " + _AS_IS,
    "bsd-2-clause-text": _BSD_TWO + _BSD_AS_IS,
    "bsd-3-clause-text": _BSD_TWO + _BSD_THREE + _BSD_AS_IS,
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
    'this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
    "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
    "SOFTWARE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
    "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
    "an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented "
    "as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
    "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the "
    "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
    "copyright law. " + _AS_IS.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "THE AUTHORS"),
    "boost-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
    '(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom '
    "the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this "
    "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
    "derivative works are solely in the form of machine-executable object code generated by a source language processor.",
}
TEMPLATES = NOTICES | TEXTS


def bigrams(text: str) -> list[tuple[str, str]]:
    w = WORD.findall(text.lower())
    return list(zip(w, w[1:]))


def dice(a: Counter, b: Counter) -> float:
    n = a.total() + b.total()
    return 2 * (a & b).total() / n if n else 0.0


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.templates = {k: c for k, t in sorted(templates.items()) if (c := Counter(bigrams(t)))}
        self.words = {w for c in self.templates.values() for b in c for w in b}
        self.of = {}
        for k, c in self.templates.items():
            for b in c:
                self.of.setdefault(b, []).append(k)

    def __call__(self, text: str | None) -> list[tuple[float, str, int, int]]:
        """(coefficient, template, first word, last word) of the best passage of each template that reaches the
        threshold, the earliest one; best first, larger templates before smaller, then by name. A passage inside another
        one half as long again comes after all that are not: a licence's first sentence is not the licence."""
        words, own = WORD.findall((text or "").lower()), self.words
        at = [i for i, w in enumerate(words) if w in own]
        hits: dict[str, list[int]] = {}
        for i, j in zip(at, at[1:]):
            if j == i + 1:
                for k in self.of.get((words[i], words[j]), ()):
                    hits.setdefault(k, []).append(i)
        out = []
        for k, where in hits.items():
            best = self._best(words, where, self.templates[k])
            if best[0] >= self.threshold - 1e-12:
                out.append((best[0], k, best[1], best[2]))
        inside = {k: any(a <= i and j <= b and 2 * (b - a) >= 3 * (j - i) for _, _, a, b in out) for _, k, i, j in out}
        return sorted(out, key=lambda x: (inside[x[1]], -x[0], -self.templates[x[1]].total(), x[1]))

    def _best(self, words: list[str], where: list[int], template: Counter) -> tuple[float, int, int]:
        size, t = template.total(), self.threshold
        least, most = math.ceil(t / (2 - t) * size - 1e-9), math.floor((2 - t) / t * size + 1e-9)
        best = (0.0, 0, 0)
        for x in range(len(where) - least + 1):
            start, common, left = where[x], 0, None
            if where[x + least - 1] - start >= most:
                continue  # too few of the template's bigrams within its largest passage
            left = dict(template)
            for y in range(x, len(where)):
                n = where[y] - start + 1
                if n > most:
                    break
                b = (words[where[y]], words[where[y] + 1])
                if left[b]:
                    left[b] -= 1
                    common += 1
                if n >= least:
                    d = 2 * common / (n + size)
                    if d > best[0]:
                        best = (d, start, where[y] + 1)
        return best


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (the best template, null if none), dice, first_word, last_word (of its passage), licenses (all that
    reach the threshold, best first): one row for each row of docs, repeated and null ids included. A template whose
    passage lies in that of a longer one is no better than it; of equally good ones the larger is, then the first by name; of equally good passages the earliest. Null and empty texts
    have none. An empty table has no rows; other columns are not looked at."""

    def run(batches):
        scanner = Scanner(templates, threshold)
        for b in batches:
            found = [scanner(t) for t in b.column("text").to_pylist()]
            first = [f[0] if f else (None, None, None, None) for f in found]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id"),
                    "license": pa.array([x[1] for x in first], pa.string()),
                    "dice": pa.array([x[0] for x in first], pa.float64()),
                    "first_word": pa.array([x[2] for x in first], pa.int32()),
                    "last_word": pa.array([x[3] for x in first], pa.int32()),
                    "licenses": pa.array([[x[1] for x in f] for f in found], pa.list_(pa.string())),
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, dice double, first_word int, last_word int, licenses array<string>")
