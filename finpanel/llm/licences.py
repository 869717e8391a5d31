"""Licence scan: Dice coefficients over word bigrams, with size bounds.

A text's units are its lines, its paragraphs (between empty lines), runs of any number of neighbouring paragraphs, and
the whole text. Units and templates are lower-cased and cut into words of letters and digits; both are bags of word
bigrams. Templates are notices and short licences, which a unit meets at a Dice coefficient of ``threshold``, and the
whole texts of long licences, in files beside this module, which it meets at ``text_threshold``. A unit of a bigrams can
reach a coefficient t with a template of b bigrams only if b t / (2 - t) <= a <= b (2 - t) / t, so other templates are
pruned before any bigram is compared. At least the share t / (2 - t) of a template's bigrams must occur in the unit,
so each template has a few words that such a unit can't do without all of; texts with none of them are passed over.

Runs are found by sums: a paragraph counts its bigrams that a template has, and a run of a bigrams, k of them in a template
of b, scores 2 k / (a + b) at most. Running sums over a text's paragraphs give k and a of any run. Of each text and
template the run of the largest bound is scored first, and then the runs whose bounds reach the best score so far, so
that the best run is found without scoring all of them.

All of it is DataFrame functions and joins. Defined results: null and empty texts and texts without a licence have a
null licence and score 0; of equal scores the smaller licence name wins; ``n_units`` counts lines, paragraphs and whole
texts that meet a template, not runs, so it is 0 where only a run does; paragraphs without words are none; repeated rows get
the same result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.llm.storage import written

#: Texts of public licences and of their usual notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words that hardly tell a licence from other prose.
COMMON = frozenset("a all and any as at by for from in is it no not of on or other than that the this to under use version with without work nc nd sa".split())
WORD = r"[\p{L}\p{N}]+"
PARAGRAPH = r"\n\s*\n"
#: Whole texts of long public licences.
TEXTS = tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt")))


def bigrams(text: str) -> Counter:
    """The bag of word bigrams of a template."""
    words = re.findall(r"[^\W_]+", text.lower())
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def needed_words(grams: Counter, threshold: float, have: set[str] = frozenset()) -> set[str]:
    """Words of which, with those of ``have``, a unit that reaches the threshold holds at least one: those of more bigrams than it may lack."""
    total, out = sum(grams.values()), set()
    left = Counter({g: n for g, n in grams.items() if not any(w in g for w in have)})
    may_lack = total - total * threshold / (2 - threshold)
    while total - sum(left.values()) <= may_lack + 1e-9 and left:
        words = Counter()
        for g, n in left.items():
            for w in set(g.split(" ")):
                words[w] += n
        best = max(words, key=lambda w: (min(words[w], may_lack + 1) * (0.001 if w in COMMON else max(len(w) - 3, 0.1) ** 2), w))
        out.add(best)
        left = Counter({g: n for g, n in left.items() if best not in g})
    return out


def _words(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _scores(units: DataFrame, tables: DataFrame, shortest: int, longest: int) -> DataFrame:
    """doc_id, h, u, licence and score of each unit (doc_id, h, u, w) and template that it meets; no template is met by fewer or more bigrams than the last two."""
    a = F.size("w") - 1
    units = units.filter((a >= shortest) & (a <= longest))
    grams = units.select("doc_id", "h", "u", a.alias("a"), F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))")).alias("gram"))
    counted = grams.groupBy("doc_id", "h", "u", "a", "gram").agg(F.count(F.lit(1)).alias("n"))
    # the templates are a fixed small table
    met = counted.join(F.broadcast(tables), "gram").filter((F.col("a") >= F.col("least")) & (F.col("a") <= F.col("most")))
    dice = met.groupBy("doc_id", "h", "u", "a", "template", "licence", "size", "threshold").agg(F.sum(F.least("n", "m")).alias("both"))
    dice = dice.withColumn("score", 2.0 * F.col("both") / (F.col("a") + F.col("size")))
    return dice.filter(F.col("score") >= F.col("threshold") - 1e-12).select("doc_id", "h", "u", "licence", "score")


def _runs(held: DataFrame, tables: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """The texts with their paragraphs' words, and the runs (doc_id, h, first, last, bound) that can meet a template.

    A paragraph's bigrams are those that begin in it, the last one reaching into the next paragraph, which a run that ends
    there does not hold. Only runs that begin and end with a paragraph of the template's bigrams are taken: without
    another one at its end a run scores more.
    """
    paras = held.select("doc_id", "h", F.filter(F.transform(F.split("lowered", PARAGRAPH), _words), lambda w: F.size(w) > 0).alias("paras")).filter(F.size("paras") > 2)
    rows = paras.select("doc_id", "h", F.expr("inline(transform(paras, (w, i) -> named_struct('p', i, 'w', w, 'next', get(paras, i + 1)[0], 'last', i = size(paras) - 1)))"))
    text = Window.partitionBy("doc_id", "h")  # the paragraphs of one text, a few numbers each
    sizes = rows.select("doc_id", "h", "p", "last", F.size("w").alias("n")).withColumn("upto", F.sum("n").over(text.orderBy("p")))
    grams = rows.select("doc_id", "h", "p", F.size("w").alias("n"), F.expr("posexplode(transform(w, (x, k) -> concat(x, ' ', coalesce(get(w, k + 1), next))))").alias("k", "gram"))
    known = grams.join(F.broadcast(tables), "gram")
    over = F.col("k") == F.col("n") - 1
    c = known.groupBy("doc_id", "h", "template", "size", "threshold", "least", "most", "p").agg(F.count(F.lit(1)).alias("c"), F.count_if(over).alias("x"))
    # a paragraph that a known bigram only reaches into is also one of the template's
    into = known.filter(over).select("doc_id", "h", "template", "size", "threshold", "least", "most", (F.col("p") + 1).alias("p"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("x"))
    c = c.unionByName(into).groupBy("doc_id", "h", "template", "size", "threshold", "least", "most", "p").agg(F.sum("c").alias("c"), F.sum("x").alias("x"))
    one = Window.partitionBy("doc_id", "h", "template")
    c = c.withColumn("all", F.sum("c").over(one)).filter(2 * F.col("all") >= F.col("threshold") * (F.col("least") + F.col("size")) - 1e-6)
    s = sizes.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("p").alias("q"), "n", "upto", "last")
    at = c.join(s, c["doc_id"].eqNullSafe(s["d"]) & (c["h"] == s["g"]) & (c["p"] == s["q"])).drop("d", "g", "q").withColumn("known", F.sum("c").over(one.orderBy("p")))
    # a run from s to e holds known_e - x_e - (known_s - c_s) of upto_e - (upto_s - n_s) - 1 bigrams, and its bound is at least t if
    # 2 (known_e - x_e) - t upto_e >= 2 (known_s - c_s) - t (upto_s - n_s + 1 - size)
    t = F.col("threshold")
    end, start = 2 * (F.col("known") - F.col("x")) - t * F.col("upto"), 2 * (F.col("known") - F.col("c")) - t * (F.col("upto") - F.col("n") + 1 - F.col("size"))
    at = at.withColumn("end", end).withColumn("start", start)
    ahead, behind = one.orderBy("upto").rangeBetween(0, longest + 1), one.orderBy("upto").rangeBetween(-longest - 1, 0)
    at = at.withColumn("reach", F.max("end").over(ahead)).withColumn("need", F.min("start").over(behind))
    key = lambda c: F.floor(c / (longest + 2))
    begins = at.filter(F.col("reach") >= F.col("start") - 1e-6).select("doc_id", "h", "template", "size", "threshold", "least", "most", F.col("p").alias("first"), (F.col("known") - F.col("c")).alias("k0"), (F.col("upto") - F.col("n")).alias("u0"))
    begins = begins.withColumn("part", F.explode(F.array(key(F.col("u0")), key(F.col("u0")) + 1)))
    ends = at.filter(F.col("end") >= F.col("need") - 1e-6).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("template").alias("v"), F.col("p").alias("final"), (F.col("known") - F.col("x")).alias("k1"), F.col("upto").alias("u1"), key(F.col("upto")).alias("to"), "last")
    both = begins.join(ends, begins["doc_id"].eqNullSafe(ends["d"]) & (begins["h"] == ends["g"]) & (begins["template"] == ends["v"]) & (begins["part"] == ends["to"]) & (begins["first"] < ends["final"]))
    a = F.col("u1") - F.col("u0") - 1
    bound = 2.0 * (F.col("k1") - F.col("k0")) / (a + F.col("size"))
    # the run of all paragraphs is the whole text
    both = both.filter((a >= F.col("least")) & (a <= F.col("most")) & (bound >= t - 1e-9) & ~((F.col("first") == 0) & F.col("last")))
    return paras, both.select("doc_id", "h", "template", "first", "final", bound.alias("bound"))


def _texts_of(runs: DataFrame, paras: DataFrame) -> DataFrame:
    """The runs' words, as units."""
    places = runs.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_set(F.struct("first", "final")).alias("places"))
    x = paras.join(places, paras["doc_id"].eqNullSafe(places["d"]) & (paras["h"] == places["g"]))
    x = x.select("doc_id", "h", "paras", F.explode("places").alias("r"))
    return x.select("doc_id", "h", F.xxhash64("r.first", "r.final").alias("u"), F.flatten(F.expr("slice(paras, r.first + 1, r.final - r.first + 1)")).alias("w"))


def _best_runs(held: DataFrame, tables: DataFrame, shortest: int, longest: int) -> DataFrame:
    """The best scores of runs of paragraphs: doc_id, h, licence, score."""
    paras, runs = _runs(held, tables, longest)
    runs = written(runs, "licence-runs")
    top = runs.groupBy("doc_id", "h", "template").agg(F.max_by(F.struct("first", "final"), F.struct("bound", -F.col("first"), -F.col("final"))).alias("r")).select("doc_id", "h", "r.*")
    seen = _scores(_texts_of(top, paras), tables, shortest, longest).select("doc_id", "h", "licence", "score")
    floor = seen.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.max("score").alias("floor"))
    more = runs.join(floor, runs["doc_id"].eqNullSafe(floor["d"]) & (runs["h"] == floor["g"]), "left").filter(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - 1e-9)
    return seen.unionByName(_scores(_texts_of(more, paras), tables, shortest, longest).select("doc_id", "h", "licence", "score"))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = 0.8, texts=TEXTS, text_threshold: float = 0.9) -> DataFrame:
    """doc_id, licence (the best one, or null), score and n_units (units but runs that meet a template) of each row."""
    spark = docs.sparkSession
    known = [(name, bigrams(x), t) for part, t in ((templates, threshold), (texts, text_threshold)) for name, x in part]
    bounds = [(math.ceil(b * t / (2 - t) - 1e-9), math.floor(b * (2 - t) / t + 1e-9)) for b, t in ((sum(g.values()), t) for _, g, t in known)]
    limits = min(x for x, _ in bounds), max(y for _, y in bounds)
    tables = spark.createDataFrame(
        [(i, name, sum(g.values()), t, *bounds[i], gram, n) for i, (name, g, t) in enumerate(known) for gram, n in g.items()],
        "template int, licence string, size int, threshold double, least int, most int, gram string, m int",
    )
    needed: set[str] = set()
    for _, g, t in known:
        needed |= needed_words(g, t, needed)
    # a word within another one is found with it
    shortest = [w for w in sorted(needed) if not any(v != w and v in w for v in needed)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    lowered = F.lower("text")

    def has_some(column: Column) -> Column:
        return reduce(or_, (F.contains(column, F.lit(w)) for w in shortest), F.lit(False))

    # units and runs both read them, and most texts end here
    held = written(rows.withColumn("lowered", lowered).filter(has_some(lowered)).select("doc_id", "h", "lowered").dropDuplicates(["doc_id", "h"]), "licence-texts")
    units = held.select("doc_id", "h", F.explode(F.array_distinct(F.concat(F.split("lowered", "\n"), F.split("lowered", PARAGRAPH), F.array("lowered")))).alias("unit")).filter(has_some(F.col("unit")))
    met = _scores(units.select("doc_id", "h", F.xxhash64("unit").alias("u"), _words("unit").alias("w")), tables, *limits)
    met = met.unionByName(_best_runs(held, tables, *limits).withColumn("u", F.lit(None).cast("long")))
    best = met.groupBy("doc_id", "h").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best"), F.countDistinct("u").alias("n_units"))
    keys = rows.select("doc_id", "h")
    best = best.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("score"), "n_units")
    return keys.join(best, keys["doc_id"].eqNullSafe(best["d"]) & (keys["h"] == best["g"]), "left").select("doc_id", "licence", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"))
