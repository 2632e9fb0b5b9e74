"""License scans: sparse TF-IDF cosines of headers and licence files to templates, then inheritance from the nearest
ancestor directory that holds a licence file.

Inverse document frequencies of the templates' words come from all files. A header is a line near a notice; a licence file
is a file whose whole text is near a notice or a licence text. Words outside the templates weigh like a word that no file
holds. Lines and files are scored only where they hold an *anchor* word: without one, by the Cauchy-Schwarz inequality, no line can reach the cosine
asked for, so nothing is lost.

A file's own header decides; a licence file, its own text; any other file inherits from the nearest directory above it
with a licence file (in one directory, the best cosine, then the smallest path). Directories, not files, are joined to
their ancestors, so a crowded directory is one row.

Defined cases: null and empty texts have no words, and may inherit; a null path has no directory; rows that repeat a path
and text get equal answers; ties go to the smallest template name; an empty table gives no rows.
"""

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.decontaminate import broadcast_if_small
from panelspark.llm.store import materialise

# Notices by which licences are usually named in files, with their SPDX identifiers.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
]
NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
)
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
NO_DAMAGES = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Texts of common licences, for licence files only. Texts of many pages are passed as ``texts`` from files.
LICENSE_TEXTS = [
    ("Apache-2.0",
     'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
     'to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
     "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the "
     "License."),
    ("BSD-2-Clause", REDISTRIBUTION + NO_DAMAGES),
    ("BSD-3-Clause", REDISTRIBUTION + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission. " + NO_DAMAGES),
    ("GPL-3.0",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
     "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
     "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
     "received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     'that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
     "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
     "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
     "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
     "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
     "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
     "in all copies or substantial portions of the Software. " + NO_WARRANTY + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
     "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]
NOT_WORD = "[^a-z0-9]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_WORD, -1), "")


def _plain_words(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def template_weights(texts: DataFrame, templates: list[tuple[str, str]]) -> tuple[list[dict[str, float]], dict[str, float], float]:
    """Each template's normalised TF-IDF vector, the idf of its words, and that of a word no file holds. Only the document
    frequencies of the templates' words reach the driver."""
    vocabulary = sorted({w for _, t in templates for w in _plain_words(t)})
    held = F.array_intersect(words(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)))
    counted = texts.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in counted}
    n = df.pop("", 0)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    vectors = []
    for _, t in templates:
        tf = {w: float(_plain_words(t).count(w)) for w in _plain_words(t)}
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in tf.items()))
        vectors.append({w: c * idf[w] / norm for w, c in tf.items()})
    return vectors, idf, math.log(1 + n) + 1


def anchors(vectors: list[dict[str, float]], least: float) -> list[str]:
    """Words of which every text with a cosine of ``least`` to some template holds one: per template, the heaviest words
    until the rest weighs less than ``least``."""
    out: set[str] = set()
    for v in vectors:
        rest = sum(x * x for x in v.values())
        for w, x in sorted(v.items(), key=lambda p: (p[0] not in out, -p[1], p[0])):
            if math.sqrt(max(rest, 0.0)) < least:
                break
            out.add(w)
            rest -= x * x
    return sorted(out)


def cosines(units: DataFrame, keys: list[str], least: float, names: list[str], model: tuple) -> DataFrame:
    """The best template of each unit (``keys`` and ``unit``, a text) with at least ``least``: ``license, cosine``. Only the
    first ``len(names)`` templates are compared."""
    vectors, idf, rare = model
    told = json.dumps([
        {"w": w, "idf": x, "ts": [{"license": n, "t": i, "x": vectors[i][w]} for i, n in enumerate(names) if w in vectors[i]]}
        for w, x in idf.items()
    ])
    kind = "array<struct<w:string,idf:double,ts:array<struct<license:string,t:int,x:double>>>>"
    known = F.broadcast(units.sparkSession.range(1).select(F.explode(F.from_json(F.lit(told), kind)).alias("r")).select("r.*"))
    terms = units.select(*keys, F.explode(words(F.col("unit"))).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("tf"))
    weighed = terms.join(known, "w", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    norms = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.collect_list(F.when(F.col("ts").isNotNull(), F.struct("ts", "v"))).alias("hits"))
    each = norms.select(*keys, "norm", F.explode("hits").alias("h")).select(*keys, "norm", "h.v", F.explode("h.ts").alias("t"))
    dots = each.groupBy(*keys, "t.t", "t.license").agg(F.sum(F.col("v") * F.col("t.x")).alias("dot"), F.first("norm").alias("norm"))
    scored = dots.select(*keys, "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= least)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("l"))).alias("b")
    return scored.groupBy(*keys).agg(best).select(*keys, F.col("b.l").alias("license"), (-F.col("b.c")).alias("cosine"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licenses(
    files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, texts: list[tuple[str, str]] = LICENSE_TEXTS,
    header: float = 0.7, whole: float = 0.6,
) -> DataFrame:
    """``file_id, path, license, cosine, origin, from_dir`` for each row of ``files`` (``file_id, path, text``).

    ``origin`` is header, file, inherited or none; cosine and directory are those of the deciding text."""
    files = files.select("file_id", "path", "text", F.xxhash64("text").alias("key"))
    model = template_weights(files, templates + texts)
    names, every = [n for n, _ in templates], [n for n, _ in templates + texts]
    in_line, in_text = anchors(model[0][: len(names)], header), anchors(model[0], whole)
    held = F.arrays_overlap(words(F.col("text")), F.array(*map(F.lit, sorted({*in_line, *in_text}))))
    some = files.where(held).dropDuplicates(["file_id", "key"])
    holds = "(?:^|[^a-z0-9])(?:" + "|".join(in_line) + ")(?:$|[^a-z0-9])"
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("no"), x.alias("unit"))),
                     lambda s: F.lower(s["unit"]).rlike(holds))
    headers = some.select("file_id", "key", F.explode(lines).alias("l")).select("file_id", "key", "l.no", "l.unit")
    by_header = cosines(headers, ["file_id", "key", "no"], header, names, model)
    first = F.min(F.struct((-F.col("cosine")).alias("c"), "no", F.col("license").alias("l"))).alias("b")
    by_header = by_header.groupBy("file_id", "key").agg(first).select(
        "file_id", "key", F.lit("header").alias("origin"), F.col("b.l").alias("license"), (-F.col("b.c")).alias("cosine")
    )
    whole_texts = some.select("file_id", "key", F.col("text").alias("unit"))
    by_text = cosines(whole_texts, ["file_id", "key"], whole, every, model).select(
        "file_id", "key", F.lit("file").alias("origin"), "license", "cosine"
    )
    own = by_text.unionByName(by_header)
    pick = F.min(F.struct((F.col("origin") != "file").alias("o"), "license", "cosine", "origin")).alias("own")
    own = materialise(own.groupBy("file_id", "key").agg(pick).select(F.col("file_id").alias("_id"), F.col("key").alias("_key"), "own"), "licensed")
    small = broadcast_if_small(own, 1_000_000)
    light = files.select("file_id", "path", "key", parent(F.col("path")).alias("dir"))
    same = light["file_id"].eqNullSafe(own["_id"]) & (light["key"] == own["_key"])
    marked = light.join(small, same, "left").select("file_id", "path", "dir", "own")
    best = F.min(F.struct((-F.col("own.cosine")).alias("c"), "path", F.col("own.license").alias("l"))).alias("b")
    governed = marked.where("own.origin = 'file'").groupBy("dir").agg(best).select(
        F.col("dir").alias("from_dir"), F.col("b.l").alias("dir_license"), (-F.col("b.c")).alias("dir_cosine")
    )
    governed = materialise(governed, "governed")
    parts = F.split("dir", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = F.array_distinct(F.concat(F.array(F.lit("")), above))  # the root of relative paths
    dirs = light.select("dir").where("dir IS NOT NULL").distinct()
    up = dirs.select("dir", F.posexplode(above).alias("depth", "up"))
    up = up.join(broadcast_if_small(governed, 1_000_000), up["up"] == governed["from_dir"])
    nearest = up.groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "dir_license", "dir_cosine")).alias("g"))
    nearest = nearest.select(F.col("dir").alias("_dir"), "g")
    out = marked.join(nearest, marked["dir"] == nearest["_dir"], "left")
    origin = F.coalesce("own.origin", F.when(F.col("g").isNotNull(), F.lit("inherited")), F.lit("none"))
    inherits = F.col("own").isNull()
    return out.select(
        "file_id", "path", F.coalesce("own.license", "g.dir_license").alias("license"),
        F.coalesce("own.cosine", "g.dir_cosine").alias("cosine"), origin.alias("origin"),
        F.when(inherits, F.col("g.from_dir")).alias("from_dir"),
    )


def license_digest(documents: DataFrame) -> DataFrame:
    """Documents as files of one tree: source, language, then directories by thousands and tens of ids."""
    tree = F.concat_ws(
        "/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")),
        F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 10).cast("string"), F.col("doc_id").cast("string"),
    )
    found = scan_licenses(documents.select(F.col("doc_id").alias("file_id"), tree.alias("path"), "text"))
    return found.withColumnRenamed("file_id", "doc_id")
