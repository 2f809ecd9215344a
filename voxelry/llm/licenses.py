"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Lines, sentences and runs of three lines that hold a word of the licence vocabulary are compared with
templates of notices and headers; so are, with the texts of whole licences, all lines between the first
and the last such line, and the whole text. Inverse document frequencies cover all texts. A file whose
words are mostly in passages that match is a licence file of its directory; files without a licence of
their own inherit that of the nearest directory above that has one, by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.llm.common import join_by_key, salted, small_batches, texts, with_all_salts, written

# SPDX identifiers, and the wording of their notices, headers and, if short, whole texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License '
        "at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and '
        "limitations under the License.",
        "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "The MIT License (MIT)",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        'notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License",
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the "
        "name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        'permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License",
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS "
        'PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
        "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
        "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "Released under the ISC License",
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        'this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": (
        "Released under the zlib License",
        "The zlib License",
        'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this '
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
        "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        '(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third- '
        "parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the "
        "above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of "
        "the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE "
        'IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
        "Eclipse Public License - v 2.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC0-1.0": (
        "Dedicated to the public domain under CC0 1.0 Universal",
        "CC0 1.0 Universal Public Domain Dedication",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
        "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        'future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
}
#: Words that a line must hold to be looked at; every template holds one.
ANCHORS = ("licens", "licenc", "copyright", "permission", "redistribut", "public domain", "cc0", "this software")
THRESHOLD, FILE_SHARE = 0.8, 0.5
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)?")
_ANCHOR = re.compile("|".join(ANCHORS))


def terms(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def vocabulary() -> set[str]:
    return {w for t in TEMPLATES.values() for x in t for w in terms(x)}


def inverse_frequencies(docs: DataFrame) -> dict[str, float]:
    """Of each vocabulary word over all texts; as many as the templates have words."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, n = vocabulary(), Counter(), 0
        for batch in batches:
            for text in texts(batch):
                found.update(known.intersection(_WORD.findall(text.lower())))
                n += 1
        found[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    got = dict(docs.select("text").mapInArrow(counted, "term string, n bigint").groupBy("term").agg(F.sum("n")).collect())
    total = got.pop("", 0)
    return {w: math.log((1 + total) / (1 + got.get(w, 0))) + 1 for w in vocabulary()}


class Matcher:
    """Cosines of lines to the templates; words outside the vocabulary count with the largest inverse frequency."""

    def __init__(self, idf: dict[str, float]) -> None:
        self.idf, self.most = idf, max(idf.values())
        self.templates = [(name, self._vector(Counter(terms(x)))) for name, t in TEMPLATES.items() for x in t]

    def _vector(self, counts: Counter) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.most) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    def nearest(self, line: str) -> tuple[float, str]:
        """The largest cosine, negated, and its licence; of equal ones the first by name."""
        v = self._vector(Counter(terms(line)))
        scores = [(sum(x * v.get(w, 0.0) for w, x in t.items()), name) for name, t in self.templates]
        return min((-round(s, 6), name) for s, name in scores)

    def passages(self, lines: list[str]) -> Iterator[tuple[int, int, str]]:
        """(first line, line after the last, words to compare) of what may match a template."""
        held = [i for i, x in enumerate(lines) if _ANCHOR.search(x.lower())]
        for i in held:
            yield i, i + 1, lines[i]
            for part in re.split(r"(?<=[.!?])\s", lines[i]):
                if _ANCHOR.search(part.lower()):
                    yield i, i + 1, part
            for j in (i - 2, i - 1, i):
                if j >= 0 and j + 3 <= len(lines):
                    yield j, j + 3, " ".join(lines[j : j + 3])
        if held and held[-1] - held[0] > 2:
            yield held[0], held[-1] + 1, " ".join(lines[held[0] : held[-1] + 1])
        if len(lines) > 3:
            yield 0, len(lines), " ".join(lines)

    def scan(self, text: str) -> tuple[str | None, float, float]:
        """The text's licence, its cosine, and the share of the text's words in lines that match one.

        Of passages that match, the one with most words that do decides; of equal ones the first by name.
        """
        if not _ANCHOR.search(text.lower()):
            return None, 0.0, 0.0
        lines = [x for x in text.splitlines() if x.strip()]
        best, covered = (0.0, 0.0, ""), set()
        for a, b, part in self.passages(lines):
            score, name = self.nearest(part)
            if -score >= THRESHOLD:
                best = min(best, (score * len(terms(part)), score, name))
                covered.update(range(a, b))
        if not best[2]:
            return None, 0.0, 0.0
        words = len(terms(text))
        return best[2], -best[1], sum(len(terms(lines[i])) for i in covered) / max(words, 1)


def scan_licenses(files: DataFrame, keys: tuple[str, ...] = ("doc_id", "path")) -> DataFrame:
    """The key columns, license, score, share for each row; license is null without a match.

    Null texts are empty and match nothing; texts of any length are read whole. Repeated rows are kept;
    an empty table gives an empty result; columns but the keys and the text are ignored.
    """
    idf = inverse_frequencies(files)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(idf)
        for batch in batches:
            found = [matcher.scan(x) for x in texts(batch)]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *columns], [*keys, "license", "score", "share"])

    rows = files.select(*keys, "text")
    types = dict(rows.dtypes)
    return rows.mapInArrow(scanned, ", ".join([*[f"{k} {types[k]}" for k in keys], "license string, score double, share double"]))


def _folder(path: str) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherit(scanned: DataFrame, file_share: float = FILE_SHARE) -> DataFrame:
    """``scanned`` with its folder, inherited licence and that licence's folder.

    Licence files, those with a share of ``file_share`` at least, give their folder a licence: the one of
    the best score, then by name. Folders are few against files, so the ancestors of each folder are
    looked up once (the empty one of relative paths too), and files are joined to their folder's result;
    folders of many files meet a broadcast. Null paths inherit nothing. ``scanned`` is read several times.
    """
    scanned = scanned.withColumn("folder", F.when(F.col("path").isNotNull(), _folder("path")))
    best = F.min(F.struct(-F.col("score"), "license"))["license"]
    owners = scanned.where((F.col("share") >= file_share) & F.col("folder").isNotNull()).groupBy("folder").agg(best.alias("given"))
    parts = F.split("folder", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    root = F.when(F.startswith(F.col("folder"), F.lit("/")) | (F.col("folder") == ""), ancestors).otherwise(F.concat(F.array(F.lit("")), ancestors))
    folders = written(scanned.where("folder IS NOT NULL").groupBy("folder").agg(F.count(F.lit(1)).alias("n")), "folders")
    owners = owners.select(F.col("folder").alias("ancestor"), "given")
    above = salted(folders.select("folder", F.explode(root).alias("ancestor")), "folder").join(with_all_salts(owners), ["ancestor", "salt"])
    nearest = above.groupBy("folder").agg(F.max(F.struct(F.length("ancestor").alias("length"), "ancestor", "given")).alias("near"))
    nearest = folders.join(nearest, "folder", "left").select("folder", "n", F.col("near.given").alias("given"), F.col("near.ancestor").alias("given_by"))
    found = join_by_key(scanned.where("folder IS NOT NULL"), written(nearest, "nearest"), "folder")
    lost = scanned.where("folder IS NULL").withColumns({"given": F.lit(None).cast("string"), "given_by": F.lit(None).cast("string")})
    return found.unionByName(lost)


def resolve(files: DataFrame) -> DataFrame:
    """doc_id, path, license, score, origin, given_by for each row of (doc_id, path, text).

    ``origin`` is ``file`` or ``header`` for a licence of its own, ``inherited`` or ``none``. An empty
    table gives an empty result; repeated rows are kept; other columns are ignored.
    """
    found = inherit(written(scan_licenses(files), "scanned"))
    own = F.col("license").isNotNull()
    origin = F.when(own & (F.col("share") >= FILE_SHARE), "file").when(own, "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return found.select(
        "doc_id", "path", F.coalesce("license", "given").alias("license"), "score", origin.alias("origin"), F.when(~own, F.col("given_by")).alias("given_by")
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: a folder by source, one by language in it, and a name by id. Nulls count as ``none``."""
    part = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("none")), "/", "_")
    return docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), F.concat(part("doc_id"), F.lit(".txt"))).alias("path"), "text")
