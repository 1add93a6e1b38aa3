"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, inherited along directories.

A file is compared by its passages: each block (lines without a blank one between them) that has a word that speaks of
licences, each stretch of a line around such a word, and the whole text.  A passage takes part if templates know half of its
words.  The words that speak of licences follow from the templates: a passage without any of them cannot reach the threshold
(``cues``; but for "mit", a common German word, which speaks of licences in capitals only).  Passages and templates are sparse vectors,
a row a word; a hash join on words gives their products.  A template is a licence's text, its usual header, or a
statement or SPDX line made by rule from its names.  The licence of the largest cosine is the file's own, from
``threshold`` on.

A licence file speaks for its directory: one with such a name, or one that is mostly (``SHARE`` of its words) the passage
that was recognised.  A file without a licence of its own takes that of the nearest ancestor directory that has one:
directories, not files, are joined with their ancestors by path.

Only DataFrame expressions.  Equal texts are compared once; what is shuffled are the words of passages and rows without
their texts.

Edge cases: a null or empty text has no licence of its own but can inherit; a null path takes part as a file
of the root directory; of equal scores the licence that sorts first wins; of several licence files of one
directory the first by name, then by licence, counts; repeated rows each get their result; columns of the
input besides the text are kept, whatever they are called, and those that clash with results are replaced.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.llm.common import save

# Names of licences as statements use them.
NAMES = {
    "0BSD": ["BSD Zero Clause License", "0BSD"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD-3-Clause"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "BSL-1.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC0-1.0": ["Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal", "CC0-1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "EPL-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0", "GPL-2.0-only"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0", "GPL-3.0-only"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}
#: Statements that any name makes.
STATEMENTS = [
    "{}", "Licensed under the {}", "Licensed under {}", "Released under the {}", "Distributed under the terms of the {}", "This work is licensed under the {}",
    "This project is licensed under the {} - see the LICENSE file for details", "SPDX-License-Identifier: {}", "License: {}",
]
_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."


def _gnu(kind: str, version: str, later: bool) -> str:
    also = "either version {v} of the License, or (at your option) any later version" if later else "version {v} of the License"
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by the Free Software Foundation, {also.format(v=version)}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details. You should have received a copy of the {kind} along with this program."


# Licence texts and the headers that licences ask for.
TEXTS = {
    "0BSD": [f"{_ISC}. {_ISC_AS_IS}"],
    "AGPL-3.0": [_gnu("GNU Affero General Public License", "3", later) for later in (False, True)],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-2-Clause": [f"BSD 2-Clause License Copyright All rights reserved. {_BSD_HEAD} {_BSD_AS_IS}", _BSD_HEAD],
    "BSD-3-Clause": [f"BSD 3-Clause License Copyright All rights reserved. {_BSD_HEAD} {_BSD_THIRD} {_BSD_AS_IS}", f"{_BSD_HEAD} {_BSD_THIRD}", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal"],
    "GPL-2.0": [_gnu("GNU General Public License", "2", later) for later in (False, True)],
    "GPL-3.0": [_gnu("GNU General Public License", "3", later) for later in (False, True)],
    "ISC": [f"ISC License Copyright {_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"],
    "LGPL-2.1": [_gnu("GNU Lesser General Public License", "2.1", later) for later in (False, True)],
    "LGPL-3.0": [_gnu("GNU Lesser General Public License", "3", later) for later in (False, True)],
    "MIT": [f"MIT License Copyright {_PERMIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_AS_IS}", _PERMIT],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "This software is confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
}
THRESHOLD = 0.78
SHARE = 0.5
#: A stretch of a line: so many words before and behind a word that speaks of licences.
BEFORE, BEHIND = 6, 14
#: Words that speak of licences, by their beginnings; ``cues`` adds what templates need besides.
SPEAKS = ["unlicen", "licen", "releas", "copyright", "redistribut", "permission", "rights", "dedicated", "spdx", "proprietary", "waived", "subject", "unencumbered"]
#: Words of templates that any prose has: they speak of licences only if a template cannot be told without them.
PLAIN = set("""1 2 3 a above all also an and any are as at be been being but by can code contact copies copy details do does either following for from had has have if in into is it its
    limited list made make may met more must name names new no not obtain of on one only option or other out part person see so such that the their them then there these they this
    those to under use used want was were which who will with without you your""".split())  # fmt: skip
#: Words of templates that are ordinary ones elsewhere (German: with): they speak of licences in capitals only.
CAPITALS = {"mit"}
#: Blank lines part blocks.
BLANK = r"\n[ \t\r]*\n"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|notice)(?:[-._][a-z0-9.-]+)?$"
RESULTS = ("own_licence", "own_score", "inherited_licence", "inherited_from", "licence")


def wordings() -> list[tuple[str, str]]:
    """(licence, wording) of all templates."""
    made = [(k, s.format(n)) for k, names in NAMES.items() for n in names for s in STATEMENTS]
    return sorted(dict.fromkeys(made + [(k, t) for k, texts in TEXTS.items() for t in texts]))


def vectors() -> tuple[dict[str, float], list[tuple[int, str, str, float]]]:
    """The idf of each word, and (wording, licence, word, weight) rows of unit vectors."""
    every = [(k, Counter(re.findall(WORD, t.lower()))) for k, t in wordings()]
    kinds = {k: {w for own, words in every if own == k for w in words} for k, _ in every}
    idf = {w: math.log((1 + len(kinds)) / (1 + sum(w in v for v in kinds.values()))) + 1 for w in sorted({w for v in kinds.values() for w in v})}
    out = []
    for i, (k, words) in enumerate(every):
        x = {w: (1 + math.log(n)) * idf[w] for w, n in words.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        out += [(i, k, w, v / size) for w, v in sorted(x.items())]
    return idf, out


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of fixed values as one literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def cues(threshold: float = THRESHOLD) -> str:
    """A pattern of the words that speak of licences: what reaches ``threshold`` with a template has one (RE2 and Java).

    Without a template's words of squared weights ``s`` together a cosine with it is at most ``sqrt(1 - s)``.  So words are
    added, those that lack most first, until no template can be reached without one.
    """
    wordings: dict[int, dict[str, float]] = {}
    for i, _, w, x in vectors()[1]:
        wordings.setdefault(i, {})[w] = x * x
    need = 1 - max(threshold - 1e-6, 0) ** 2 + 1e-9
    added: set[str] = set()
    for usable in (lambda w: w not in PLAIN and "k" not in w, lambda w: True):  # a k has a third form (the Kelvin sign)
        while True:
            gain: Counter[str] = Counter()
            for words in wordings.values():
                lacks = need - sum(x for w, x in words.items() if w in added or w.startswith(tuple(SPEAKS)))
                if lacks > 0:
                    gain.update({w: min(x, lacks) for w, x in words.items() if w not in added and not w.startswith(tuple(SPEAKS)) and usable(w)})
            if not gain:
                break
            added.add(min(gain, key=lambda w: (-gain[w], w)))
    ends: dict[str, list[str]] = {}  # by first letter, so that few are tried at a place
    for w in SPEAKS:
        ends.setdefault(w[0], []).append(w[1:])
    for w in sorted(added - CAPITALS):
        ends.setdefault(w[0], []).append(re.escape(w[1:]).replace("\\-", "-") + "(?:[^A-Za-z0-9]|$)")
    capitals = "|".join(w.upper() for w in sorted(CAPITALS & added))
    return "(?:^|[^A-Za-z0-9])(?:(?i:" + "|".join(f"{c}(?:{'|'.join(e)})" for c, e in sorted(ends.items())) + ")" + (f"|(?:{capitals})(?:[^A-Za-z0-9]|$)" if capitals else "") + ")"


def passages(text: Column, cue: str) -> Column:
    blocks = F.filter(F.split(text, BLANK), lambda b: b.rlike(cue))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(cue))
    words = F.transform(lines, lambda line: F.filter(F.split(line, "[ \t\r]+"), lambda w: w != ""))
    first = lambda i: F.greatest(i - BEFORE, F.lit(1))
    stretch = lambda w: F.transform(F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.element_at(w, i).rlike(cue)), lambda i: F.array_join(F.slice(w, first(i), i + BEHIND + 1 - first(i)), " "))
    return F.array_distinct(F.concat(F.flatten(F.transform(words, stretch)), blocks, F.array(text)))


def own_licences(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(h1, h2, score, found, mostly) of the best passage of each text of (h1, h2, text), if any; texts are different.

    Passages are those that can reach ``threshold``; what is below it is not left out."""
    spark = texts.sparkSession
    idf, templates = vectors()
    vocabulary = F.broadcast(literal_rows(spark, [{"word": w, "idf": i} for w, i in idf.items()], "word:string,idf:double"))
    weights = F.broadcast(literal_rows(spark, [{"wording": i, "licence": k, "word": w, "weight": x} for i, k, w, x in templates], "wording:int,licence:string,word:string,weight:double"))
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    rows = texts.select("h1", "h2", F.size(split(F.col("text"))).alias("all_words"), F.posexplode(passages(F.col("text"), cues(threshold))).alias("place", "passage"))
    words = rows.select("h1", "h2", "place", "all_words", split(F.col("passage")).alias("w")).select("h1", "h2", "place", "all_words", F.size("w").alias("n_words"), F.explode("w").alias("word"))
    own = ["h1", "h2", "place", "all_words", "n_words"]
    counted = words.join(vocabulary, "word").groupBy(*own, "word", "idf").agg(F.count("*").alias("n"))
    weighed = counted.select(*own, "word", ((F.log(F.col("n").cast("double")) + 1) * F.col("idf")).alias("x"))
    size = weighed.groupBy(*own).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    dots = weighed.join(weights, "word").groupBy(*own, "wording", "licence").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    score = F.round(F.col("dot") / F.col("size"), 6)
    # words that no template has weigh as much as the rarest of theirs: a passage is as good as its share of known words
    known = counted.groupBy(*own).agg(F.sum("n").alias("known"))
    scored = dots.join(size, own).join(known, own).where(2 * F.col("known") >= F.col("n_words")).select("h1", "h2", score.alias("score"), "licence", (F.col("n_words") >= SHARE * F.col("all_words")).alias("mostly"))
    best = scored.groupBy("h1", "h2").agg(F.min(F.struct((-F.col("score")).alias("negative"), "licence", (~F.col("mostly")).alias("partly"))).alias("b"))
    return best.select("h1", "h2", (-F.col("b.negative")).alias("score"), F.col("b.licence").alias("found"), (~F.col("b.partly")).alias("mostly"))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Licences of ``files``: own_licence, own_score, inherited_licence, inherited_from, licence."""
    kept = [c for c in files.columns if c not in (text, *RESULTS)]
    place = {c: f"c{i}" for i, c in enumerate(kept)}  # names that no column of ours has
    body, where = F.col(text).cast("string"), F.coalesce(F.col(path).cast("string"), F.lit(""))
    keys = [F.when(body.isNotNull(), h).alias(k) for k, h in (("h1", F.xxhash64(body)), ("h2", F.xxhash64(F.lit("second"), body)))]
    texts = files.where(body.rlike(cues(threshold))).select(*keys, body.alias("text")).dropDuplicates(["h1", "h2"])
    found = save(own_licences(texts, threshold).where(F.col("score") >= threshold))
    rows = files.select(*(F.col(c).alias(place[c]) for c in kept), where.alias("at"), directory(where).alias("dir"), *keys).join(found, ["h1", "h2"], "left")
    rows = save(rows.withColumnsRenamed({"found": "own_licence", "score": "own_score"}).drop("h1", "h2"))
    speaker = rows.where(F.col("own_licence").isNotNull() & (F.col("at").rlike(LICENCE_FILE) | F.col("mostly")))
    declared = speaker.groupBy("dir").agg(F.min(F.struct("at", "own_licence")).alias("first")).select(F.col("dir").alias("up"), F.col("first.own_licence").alias("declared"))
    out = inherit(rows, declared)
    return out.select(*(F.col(place[c]).alias(c) for c in kept), "own_licence", "own_score", F.when(F.col("own_licence").isNull(), F.col("declared")).alias("inherited_licence"), F.when(F.col("own_licence").isNull(), F.col("from")).alias("inherited_from"), F.coalesce("own_licence", "declared").alias("licence"))


def inherit(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """``rows`` with the licence that the nearest of a directory and its ancestors declares, and which that is (``from``)."""
    parts = F.split("dir", "/")
    ancestors = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    above = rows.select("dir").distinct().select("dir", F.explode(ancestors).alias("up"))
    nearest = above.join(declared, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "declared")).alias("near")).select("dir", F.col("near.declared").alias("declared"), F.col("near.up").alias("from"))
    return rows.join(nearest, "dir", "left")


def oracle(files: str, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of ``scan`` over a relation of (doc_id, path, text)."""
    idf, templates, cue = *vectors(), cues(threshold)
    words = ", ".join(f"('{w}', {i!r}::DOUBLE)" for w, i in idf.items())
    weights = ", ".join(f"({i}, '{k}', '{w}', {x!r}::DOUBLE)" for i, k, w, x in templates)
    own = "text, place, all_words, n_words"
    return f"""
WITH idf(word, idf) AS (VALUES {words}), template(wording, licence, word, weight) AS (VALUES {weights}),
f AS (SELECT doc_id, path, coalesce(path, '') AS place_of, text, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM ({files})),
t AS (SELECT DISTINCT text FROM f WHERE regexp_matches(text, '{cue}')),
l AS (SELECT text, list_filter(string_split_regex(line, '[ \t\r]+'), lambda x: x <> '') AS line FROM (SELECT text, unnest(string_split(text, chr(10))) AS line FROM t)),
p AS (SELECT DISTINCT text, place FROM (SELECT text, array_to_string(line[greatest(i - {BEFORE}, 1) : i + {BEHIND}], ' ') AS place FROM (SELECT text, line, unnest(range(1, len(line) + 1)) AS i FROM l) WHERE regexp_matches(line[i], '{cue}')
  UNION ALL SELECT text, unnest(list_filter(string_split_regex(text, '{BLANK}'), lambda b: regexp_matches(b, '{cue}'))) FROM t UNION ALL SELECT text, text FROM t)),
s AS (SELECT text, place, len(regexp_extract_all(lower(text), '{WORD}')) AS all_words, regexp_extract_all(lower(place), '{WORD}') AS w FROM p),
w AS (SELECT text, place, all_words, len(w) AS n_words, unnest(w) AS word FROM s),
c AS (SELECT {own}, word, any_value(idf) AS idf, count(*) AS n FROM w JOIN idf USING (word) GROUP BY {own}, word),
x AS (SELECT {own}, word, (ln(n) + 1) * idf AS x FROM c),
z AS (SELECT {own}, sqrt(sum(x * x)) AS size FROM x GROUP BY ALL), k AS (SELECT {own}, sum(n) AS known FROM c GROUP BY ALL),
d AS (SELECT {own}, wording, licence, sum(x * weight) AS dot FROM x JOIN template USING (word) GROUP BY ALL),
b AS (SELECT d.text, d.licence, round(dot / size, 6) AS score, d.n_words >= {SHARE} * d.all_words AS mostly FROM d JOIN z USING ({own}) JOIN k USING ({own}) WHERE 2 * known >= d.n_words),
own AS (SELECT text, licence, score, mostly FROM b QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, licence, mostly DESC) = 1),
g AS (SELECT f.*, own.licence AS own_licence, own.score AS own_score, own.mostly FROM f LEFT JOIN own ON f.text = own.text AND own.score >= {threshold}),
u AS (SELECT dir, min(struct_pack(path := place_of, licence := own_licence)).licence AS licence FROM g WHERE own_licence IS NOT NULL AND (mostly OR regexp_matches(place_of, '{LICENCE_FILE}')) GROUP BY dir),
up AS (SELECT a.dir, u.dir AS up, u.licence FROM (SELECT DISTINCT dir FROM g) a JOIN u ON u.dir = '' OR a.dir = u.dir OR starts_with(a.dir, u.dir || '/') QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY length(u.dir) DESC) = 1)
SELECT doc_id, path, own_licence, own_score, CASE WHEN own_licence IS NULL THEN licence END AS inherited_licence,
  CASE WHEN own_licence IS NULL THEN up END AS inherited_from, coalesce(own_licence, licence) AS licence FROM g LEFT JOIN up USING (dir)"""
