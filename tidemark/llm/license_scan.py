"""License scans by sparse TF-IDF cosine and directory inheritance (operator 2).

Templates are headers, notices and short whole licences. A file's passages are windows of 1 to 28 consecutive lines, blank
lines left out, so that a notice that wraps over lines or paragraphs is one passage, and a comment's markers are no words.
A passage is a sparse vector of damped word counts (1 + ln n) times inverse document frequency over the templates (halved for ``COMMON`` words), and goes to
the template of the largest cosine if that reaches ``COSINE``. Words outside the templates' vocabulary add to a passage's
norm with the weight of a word that no template has, so that long prose with a few words in common stays below. A file's
own licence is that of its best passage; a licence whose text lies within another's gives way to that where a passage
matches the clause that the other adds (``ADDED``).

Windows begin at lines with a telling word. Telling words are chosen so that what a template has besides them has a norm
below ``COSINE``: by Cauchy's inequality no passage without one reaches it, so nothing is lost.

A file without a licence of its own inherits that of the nearest ancestor directory that has one. A directory's licence
is that which most of its licence files have (ties: the first by name); a licence file is a file whose name says so or
whose text consists of at most ``NOTICE_WORDS`` words with a licence among them. Ancestors are joined by path, one row
for each directory and ancestor, so only distinct directories meet in that join.

Defined results: a null text has no passage; a null path is a file without a directory, which inherits nothing; equal
cosines go to the licence that is first by name; repeated rows get equal results and count once for their directory for
each row; a very long line is one passage; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import map_steps
from tidemark.llm.common import cut

COSINE, NOTICE_WORDS = 0.6, 60
SALTS = 16
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense|copyright)([.-].*)?$"
#: Words that any text has; they have half of the weight that they would have else.
COMMON = frozenset(
    "a all an and any are as at be but by can do even for from had has have if in into is it its may more must no nor not of on one or other out "
    "see shall should so such than that the their then there this to use used was way were which who whom will with without would you your".split()
)
#: Lines of a passage.
WINDOWS = (1, 2, 3, 4, 5, 7, 9, 12, 15, 20, 28)

# Wording of well-known licences and their notices, by SPDX identifier.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. "
)
_GPL_TAIL = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
    "or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. "
    "If not, see <https://www.gnu.org/licenses/>."
)


def _gnu(name: str, version: str) -> list[str]:
    """The notices that ask to be put into a program under one of the GNU licences, with their usual ends and without."""
    head = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
        "Foundation, either version {version} of the License, or (at your option) any later version. "
    )
    library = (
        "This library is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
        "Foundation; either version {version} of the License, or (at your option) any later version."
    )
    texts = [head, head + _GPL_TAIL, library, "This work is licensed under the {name}, version {version}."]
    return [t.format(name=name, version=version) for t in texts]


#: By licence, what clause another licence of which it is a part adds to it.
ADDED = {"BSD-2-Clause": _BSD_THIRD}

TEMPLATES = [
    *(("AGPL-3.0", t) for t in _gnu("GNU Affero General Public License", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
     "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
     "License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_THIRD),
    ("BSD-3-Clause", _BSD + _BSD_THIRD),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_AS_IS),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal public domain dedication."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
     "https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")."),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    *(("GPL-2.0", t) for t in _gnu("GNU General Public License", "2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    *(("GPL-3.0", t) for t in _gnu("GNU General Public License", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    *(("LGPL-2.1", t) for t in _gnu("GNU Lesser General Public License", "2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    *(("LGPL-3.0", t) for t in _gnu("GNU Lesser General Public License", "3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", _MIT),
    ("MIT", _MIT + _AS_IS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

WORDS = r"[a-z0-9]+(?:[.][a-z0-9]+)*"


_words = re.compile(WORDS).findall


class Templates:
    """Unit vectors of templates over their words, and the words that tell them from anything else."""

    def __init__(self, templates: list[tuple[str, str]], least: float):
        bags = [Counter(_words(t.lower())) for _, t in templates]
        spread = Counter(w for b in bags for w in b)
        self.names = [name for name, _ in templates]
        self.added = {name: [i for i, (_, t) in enumerate(templates) if t == clause] for name, clause in ADDED.items()}
        self.place = {w: i for i, w in enumerate(sorted(spread))}
        self.idf = np.array([math.log((1 + len(bags)) / spread[w]) * (0.5 if w in COMMON else 1) for w in self.place] + [math.log(1 + len(bags))])
        self.units = np.zeros((len(bags), len(self.idf)))  # the last column is for all other words
        for row, bag in zip(self.units, bags, strict=True):
            for w, n in bag.items():
                row[self.place[w]] = (1 + math.log(n)) * self.idf[self.place[w]]
            row /= np.linalg.norm(row)
        self.least, self.telling = least, set()
        words = list(self.place)
        for row in self.units:
            left = 1.0
            for i in sorted(np.flatnonzero(row[:-1]), key=lambda i: (words[i] in COMMON, -row[i])):
                if left < least**2:
                    break
                self.telling.add(words[i])
                left -= row[i] ** 2

    def cosines(self, lines: list[list[str]], starts: list[int]) -> np.ndarray:
        """For each window that begins at ``starts`` its cosine with each template."""
        rows = []
        for start in starts:
            counts, other, last = np.zeros(len(self.idf)), 0.0, start
            seen: Counter[str] = Counter()
            for size in WINDOWS:
                if last > start and last >= len(lines):
                    break
                for line in lines[last : start + size]:
                    for w in line:
                        at = self.place.get(w)
                        if at is None:
                            n = seen[w] = seen[w] + 1
                            other += (1 + math.log(n)) ** 2 - (n > 1 and (1 + math.log(n - 1)) ** 2)
                        else:
                            counts[at] += 1
                last = min(start + size, len(lines))
                row = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * self.idf
                row[-1] = math.sqrt(other) * self.idf[-1]
                rows.append(row / np.linalg.norm(row))
        return np.array(rows) @ self.units.T

    def best(self, text: str) -> tuple[str | None, float | None]:
        """The licence of a whole text and its cosine; None if no passage has one."""
        low = text.lower()
        if self.telling.isdisjoint(_words(low)):
            return None, None
        lines = [found for line in low.split("\n") if (found := _words(line))]
        starts = [i for i, line in enumerate(lines) if not self.telling.isdisjoint(line)]
        top = np.zeros(len(self.names))
        for at in range(0, len(starts), 256):
            top = np.maximum(top, self.cosines(lines, starts[at : at + 256]).max(axis=0))
        found: dict[str, float] = {}
        for name, cosine in zip(self.names, np.round(top, 6).tolist(), strict=True):
            if cosine >= self.least:
                found[name] = max(cosine, found.get(name, 0.0))
        for name, clauses in self.added.items():
            if any(top[i] >= self.least for i in clauses):
                found.pop(name, None)
        return min(((n, c) for n, c in found.items()), key=lambda x: (-x[1], x[0]), default=(None, None))


def match(files: DataFrame, text: str, templates: list[tuple[str, str]], least: float, drop: tuple[str, ...] = ()) -> DataFrame:
    """``files``, without ``drop``, with the licence and cosine of the best template of each, from whole texts."""
    to = Templates(templates, least)

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [to.best(t) if t else (None, None) for t in part.column(text).to_pylist()]
        return {"licence": pa.array([x[0] for x in found], pa.string()), "cosine": pa.array([x[1] for x in found], pa.float64())}

    return map_steps(files, text, [T.StructField("licence", T.StringType()), T.StructField("cosine", T.DoubleType())], run, drop)


def ancestors(directory: Column) -> Column:
    """The directory and all above it, as an array of (directory, depth); the top is ''."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("directory"), n.alias("depth")))


def scan(
    files: DataFrame, id_col: str, path: str, text: str, templates: list[tuple[str, str]] | None = None,
    least: float = COSINE, notice_words: int = NOTICE_WORDS,
) -> DataFrame:
    """(id, path, licence, cosine, origin, inherited_from) for each row; origin is own, inherited or none."""
    clean = F.regexp_replace("path", "/+", "/")
    name, parent = F.regexp_extract(clean, "([^/]*)$", 1), F.regexp_replace(F.regexp_replace(clean, "/?[^/]*$", ""), "^/", "")
    rows = files.select(F.col(id_col).alias("id"), F.col(path).alias("path"), F.col(text).alias("text"))
    rows = rows.withColumns({"named": name.rlike(FILE_NAMES), "directory": parent, "short": F.regexp_count("text", F.lit(r"\S+")) <= notice_words})
    own = cut(match(rows, "text", TEMPLATES if templates is None else templates, least, drop=("text",)))
    votes = own.where(F.col("licence").isNotNull() & F.col("directory").isNotNull() & (F.col("named") | F.col("short")))
    votes = votes.groupBy("directory", "licence").count()
    stands = votes.groupBy(F.col("directory").alias("above")).agg(F.min(F.struct((-F.col("count")).alias("n"), "licence")).alias("best"))
    stands = stands.select("above", F.col("best.licence").alias("directory_licence"))
    # only directories that need one look upwards, each once
    asking = own.where(F.col("licence").isNull() & F.col("directory").isNotNull()).select("directory").distinct()
    up = asking.select("directory", F.explode(ancestors(F.col("directory"))).alias("up"))
    up = up.join(stands, F.col("up.directory") == F.col("above"))
    nearest = up.groupBy("directory").agg(F.max(F.struct("up.depth", "above", "directory_licence")).alias("nearest"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    nearest = nearest.select(F.col("directory").alias("d"), "nearest", salts)
    salted = own.where(F.col("licence").isNull()).withColumn("s", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    heirs = salted.join(nearest, (F.col("directory") == F.col("d")) & (F.col("s") == F.col("salt")), "left")
    heirs = heirs.select(
        "id", "path", F.col("nearest.directory_licence").alias("licence"), F.lit(None).cast("double").alias("cosine"),
        F.when(F.col("nearest").isNotNull(), "inherited").otherwise("none").alias("origin"), F.col("nearest.above").alias("inherited_from"),
    )
    kept = own.where(F.col("licence").isNotNull())
    kept = kept.select("id", "path", "licence", "cosine", F.lit("own").alias("origin"), F.lit(None).cast("string").alias("inherited_from"))
    return kept.unionByName(heirs).withColumnRenamed("id", id_col)
