"""Licence scan: sparse TF-IDF cosine of headers and licence texts to templates, then inheritance by directory.

A template is a notice, header or licence text as a sparse vector of its words and word pairs, times inverse document
frequencies counted over all files. Line breaks and comment signs don't count, so that a header wrapped over many lines
is compared as a whole: at each place where one of a template's rarest words stands in a file, the run of as
many words as the template has is a window, and its cosine with the template is taken. The best window decides. If it is
as near to another licence's template, or isn't near enough for its length, the licence is unknown, not the nearest one's.
A file without a notice takes the licence of the licence file in the nearest directory above it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of
from .decontam import words_of

UNKNOWN = "unknown"
#: Windows with this cosine hold a notice of some licence, if the template has MANY words.
MIN_COSINE, MANY = 0.6, 5
#: The cosine that names the licence: 1 - 1 / words of the template, at most this for long ones; EXACT for those under SHORT words.
LONG_COSINE, SHORT, EXACT = 0.9, 8, 0.999
#: How much less near the best template of any other licence must be, at the same place.
MARGIN = 0.004
#: A template's rarest words, by which its windows are found.
SEEDS = 4


def _gnu(name: str, version: str, kind: str = "program", end: str = "If not, see <https://www.gnu.org/licenses/>.") -> str:
    # The header that the GNU licences ask for
    start = f"This {kind} is free software" + (": you can" if version[0] == "3" else "; you can")
    return (
        f"{start} redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the {name} for more details. You should have received a copy of the {name} along with this {kind}. {end}"
    )


def _cc(words: str, code: str, version: str) -> tuple[str, ...]:
    # The notices of Creative Commons
    name = f"Creative Commons {words} {version} {'International' if version == '4.0' else 'Unported'} License"
    return (f"This work is licensed under a {name}.", f"This work is licensed under the {name}.", f"Licensed under a {name}.", f"Licensed under CC {code} {version}.", f"This work is licensed under CC {code} {version}.")


_GPL, _LGPL, _LIBRARY, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Library General Public License", "GNU Affero General Public License"
_ADDRESS = "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_COPY = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_MIT_END = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
# Headers, licence texts (of long ones the beginning) and the short notices that they are commonly given by.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT", _MIT, _MIT + _MIT_END),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
    ),
    "Apache-1.1": ("The Apache Software License, Version 1.1", "Licensed under the Apache Software License, Version 1.1.", "Licensed under the Apache License, Version 1.1.", "SPDX-License-Identifier: Apache-1.1"),
    "Apache-1.0": ("Licensed under the Apache License, Version 1.0.", "SPDX-License-Identifier: Apache-1.0"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only", _gnu(_GPL, "3"),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> " + _COPY,
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", _gnu(_GPL, "2"), _gnu(_GPL, "2", end=_ADDRESS),
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA " + _COPY,
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-3.0-only", _gnu(_LGPL, "3"), _gnu(_LGPL, "3", "library"),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> " + _COPY,
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-only", _gnu(_LGPL, "2.1"), _gnu(_LGPL, "2.1", "library"), _gnu(_LGPL, "2.1", "library", _ADDRESS),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA " + _COPY,
    ),
    "LGPL-2.0": (_gnu(_LIBRARY, "2", "library"), _gnu(_LIBRARY, "2", "library", _ADDRESS), "SPDX-License-Identifier: LGPL-2.0-or-later", "SPDX-License-Identifier: LGPL-2.0-only"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only", _gnu(_AGPL, "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> " + _COPY),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", _GRANT + _BSD_TWO + _BSD_THREE, _GRANT + _BSD_TWO + _BSD_THREE + _BSD_END),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", _GRANT + _BSD_TWO + _BSD_END),
    "ISC": ("SPDX-License-Identifier: ISC", "Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "SPDX-License-Identifier: EPL-2.0"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "Zlib": ("SPDX-License-Identifier: Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    "CC-BY-4.0": _cc("Attribution", "BY", "4.0"), "CC-BY-3.0": _cc("Attribution", "BY", "3.0"),
    "CC-BY-SA-4.0": _cc("Attribution-ShareAlike", "BY-SA", "4.0"), "CC-BY-SA-3.0": _cc("Attribution-ShareAlike", "BY-SA", "3.0"),
    "CC-BY-NC-4.0": _cc("Attribution-NonCommercial", "BY-NC", "4.0"), "CC-BY-ND-4.0": _cc("Attribution-NoDerivatives", "BY-ND", "4.0"),
    "CC-BY-NC-SA-4.0": _cc("Attribution-NonCommercial-ShareAlike", "BY-NC-SA", "4.0"), "CC-BY-NC-ND-4.0": _cc("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND", "4.0"),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "Proprietary": ("All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([._-][^/]*)?$"


def _vocabulary(templates: dict[str, tuple[str, ...]]) -> list[bytes]:
    return sorted({w for texts in templates.values() for t in texts for w in words_of(t)})


def _count(vocabulary: list[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, known = Counter(), frozenset(vocabulary)
    for b in batches:
        for text in b.column(0).to_pylist():
            counts.update(known.intersection(words_of(text)))
    words = sorted(counts)
    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words]), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])


class Scorer:
    """Cosines of windows with templates. A word pair weighs as the rarer of its words, a word of no template as the mean one of them."""

    def __init__(self, templates: dict[str, tuple[str, ...]], counts: dict[bytes, int], total: int):
        self.idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1 for w in _vocabulary(templates)}
        self.other = sum(self.idf.values()) / max(1, len(self.idf))
        self.names: list[str] = []
        self.length: list[int] = []
        self.vectors: list[dict] = []
        self.seeds: list[dict[bytes, int]] = []
        for name, texts in sorted(templates.items()):
            for words in sorted({tuple(words_of(t)) for t in texts}):
                vector, norm = self.vector(words)
                self.vectors.append({k: x / norm for k, x in vector.items()})
                self.names.append(name)
                self.length.append(len(words))
                first = {w: j for j, w in reversed(list(enumerate(words)))}
                self.seeds.append({w: first[w] for w in sorted(first, key=lambda w: (-self.idf[w], first[w]))[:SEEDS]})
        self.by_seed: dict[bytes, list[tuple[int, int]]] = {}
        for t, seeds in enumerate(self.seeds):
            for w, j in seeds.items():
                self.by_seed.setdefault(w, []).append((t, j))

    def vector(self, words) -> tuple[dict, float]:
        idf, other = self.idf, self.other
        out = {w: n * idf.get(w, other) for w, n in Counter(words).items()}
        for (v, w), n in Counter(zip(words, words[1:], strict=False)).items():
            out[v, w] = n * max(idf.get(v, other), idf.get(w, other))
        return out, math.sqrt(sum(x * x for x in out.values()))

    def windows(self, words: list[bytes]) -> list[tuple[float, int, int]]:
        """(cosine, template, first word) of each window at a seed of a template most of whose seeds the text holds."""
        here = self.by_seed.keys() & set(words)
        if not here:
            return []
        hit = [sum(w in here for w in seeds) * 2 >= len(seeds) for seeds in self.seeds]
        starts = {(t, max(0, p - j)) for p, w in enumerate(words) if w in here for t, j in self.by_seed[w] if hit[t]}
        cache: dict[tuple[int, int], tuple[dict, float]] = {}
        found = []
        for t, p in sorted(starts):
            key = (p, self.length[t])
            if key not in cache:
                cache[key] = self.vector(words[p : p + key[1]])
            vector, norm = cache[key]
            template = self.vectors[t]
            small, large = (vector, template) if len(vector) < len(template) else (template, vector)
            found.append((sum(x * large[k] for k, x in small.items() if k in large) / norm, t, p))
        return found

    def needed(self, t: int) -> float:
        n = self.length[t]
        return EXACT if n < SHORT else min(LONG_COSINE, 1 - 1 / n)

    def best(self, words: list[bytes]) -> tuple[float, str | None, int]:
        """(cosine, licence or UNKNOWN or None, first word) of the best window; of equals that of the longer template, then the first.

        Windows near enough to name a licence go before nearer ones that aren't.
        """
        found = self.windows(words)
        if not found:
            return 0.0, None, 0
        sure = [f for f in found if f[0] >= self.needed(f[1]) - 1e-9]
        score, t, p = max(sure or found, key=lambda f: (round(f[0], 9), self.length[f[1]], -f[2], -f[1]))
        if not sure:
            return score, UNKNOWN if score >= MIN_COSINE and self.length[t] >= MANY else None, p
        # the same place under another name: as near, and no less of the text
        rivals = [s for s, u, q in found if self.names[u] != self.names[t] and q < p + self.length[t] and p < q + self.length[u] and 2 * self.length[u] >= self.length[t]]
        return score, UNKNOWN if max(rivals, default=0.0) > score - MARGIN else self.names[t], p

    def scan(self, text: str) -> tuple[float, str | None, int | None]:
        """(cosine, licence, line where its window starts) of a text."""
        score, name, at = self.best(words_of(text))
        if name is None:
            return score, None, None
        for i, line in enumerate(text.split("\n")):
            at -= len(words_of(line))
            if at < 0:
                return score, name, i
        return score, name, 0


def _scan(templates, counts, total, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(templates, counts, total)
    for b in batches:
        got = [scorer.scan(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([g[1] for g in got], pa.string()), pa.array([round(g[0], 6) for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())], ["path", "is_file", "own", "cosine", "line"])


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", is_license_file: Column | None = None, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(path_col, own_license, cosine, line, license, license_path) of every file.

    own_license is that of the best window (starting on ``line``, from 0), UNKNOWN where that is near a template but names no licence,
    null without a notice. license is the own one or else that of the nearest directory at or above the file that holds a licence
    file with a licence (of several, the least path), found at license_path. Null paths have no
    directory; null texts count as empty; ties go to the longer template, then to the first window and name; repeated rows are
    returned as they come; other columns aren't looked at; an empty table gives an empty result.
    """
    templates = templates or TEMPLATES
    p = F.col(path_col)
    named = is_license_file if is_license_file is not None else p.rlike(LICENSE_FILE)
    rows = files.select(p.cast("string").alias("path"), text_of(text_col).alias("text"), F.coalesce(named, F.lit(False)).alias("is_file"))
    counted = rows.select("text").mapInArrow(partial(_count, _vocabulary(templates)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # words of the templates
    total = rows.count()
    counts = {r["word"].encode(): r["n"] for r in counted}
    scanned = rows.mapInArrow(partial(_scan, templates, counts, total), "path string, is_file boolean, own string, cosine double, line long")
    scanned = scanned.withColumn("dir", F.when(F.col("path").isNotNull(), F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace("path", "^/+", "")), "/[^/]*$", "")))
    scanned, _ = materialize(scanned, "license-files")
    given = scanned.where(F.col("is_file") & F.col("own").isNotNull() & F.col("path").isNotNull()).groupBy("dir").agg(F.min(F.struct("path", "own")).alias("g"))
    given = given.select(F.col("dir").alias("at"), F.col("g.own").alias("license"), F.col("g.path").alias("license_path"))
    # ancestors of directories, not of files: '/a/b' -> '', '/a', '/a/b'
    parts = F.split("dir", "/")
    dirs = scanned.where("dir IS NOT NULL").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("at"))
    nearest = above.join(given, "at").groupBy("dir").agg(F.max(F.struct(F.length("at"), "at", "license", "license_path")).alias("n")).select("dir", F.col("n.license").alias("license"), F.col("n.license_path").alias("license_path"))
    nearest, _ = materialize(nearest, "license-dirs")
    j = scanned.join(nearest, "dir", "left")
    own = F.col("own").isNotNull()
    return j.select(F.col("path").alias(path_col), F.col("own").alias("own_license"), "cosine", "line", F.when(own, F.col("own")).otherwise(F.col("license")).alias("license"), F.when(own, F.col("path")).otherwise(F.col("license_path")).alias("license_path"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """The scan over ``documents``: (doc_id, own_license, cosine, line, license, license_path).

    They have neither paths nor file names, so that nothing is inherited: license is the own one, license_path is null.
    """
    out = scan_licenses(docs.select(F.col("doc_id").cast("string").alias("path"), "text"), is_license_file=F.lit(False))
    return out.select(F.col("path").cast("long").alias("doc_id"), "own_license", "cosine", "line", "license", F.lit(None).cast("string").alias("license_path"))
