"""License scans: a trained paragraph classifier, confirmed by templates.

A paragraph is what stands between blank lines, however its lines are
wrapped or marked as comments.  Inside it, words that license notices are
told by (anchors) and that follow each other within a few words make a
stretch, so that a notice in running prose is looked at by itself.  The
features of a stretch are its anchors and the word pairs and triples around
them.  A multinomial logistic regression over these sparse n-grams names the
licence family or ``unknown``; its probabilities are calibrated by a
temperature fitted on notices kept out of training.  A named family is
confirmed if the stretch holds enough of the n-grams of one of that family's
templates.  Paragraphs without any of the stems that every notice has are
unknown and not looked at further.

The whole path is DataFrame functions; the weights are a small table, bounded
by the vocabulary of the templates.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import literal_table, text_key

#: Notices by family, as they are commonly written.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "This project is released under the Apache 2.0 license",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License, Version 2.0",
        "Apache License 2.0",
        "Licensed under Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "This software is distributed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "The MIT License (MIT)",
        "see the MIT license",
        "MIT licensed",
        "Distributed under the MIT License",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "Licensed under the GNU GPL v3 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License",
        "GNU GPL v3",
        "GPL v3",
        "GPL v2",
        "Distributed under GNU GPL v3",
        "Licensed under GPLv2",
        "Licensed under GPLv3",
        "Licensed under the GPL",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "GNU Lesser General Public License",
        "Licensed under the LGPL v2.1",
        "Licensed under LGPLv3",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "GNU Affero General Public License",
        "Licensed under the AGPL v3",
        "Licensed under AGPLv3",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 2-Clause License",
        "BSD 3-Clause License",
        "Released under the BSD 2-Clause License",
        "Licensed under the BSD license",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License 2.0",
        "Licensed under MPL 2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
        "CC BY 4.0",
        "Creative Commons Attribution 4.0 International",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
        "CC BY-SA 4.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
        "CC BY-NC 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights; CC0 1.0 Universal public domain dedication",
        "This is free and unencumbered software released into the public domain",
        "CC0 1.0 Universal",
        "Released under CC0",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "isc": [
        "ISC License",
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "SPDX-License-Identifier: ISC",
    ],
    "epl": [
        "Eclipse Public License 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "mit-or-apache": [
        "Dual licensed under MIT or Apache-2.0",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option",
        "SPDX-License-Identifier: MIT OR Apache-2.0",
    ],
    "proprietary": [
        "Copyright 2024 Example Corporation. All rights reserved",
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential",
        "All rights reserved",
        "Copyright 2024 Example. All rights reserved",
        "Proprietary and confidential",
    ],
}
#: Whole notices by family, as they stand at the head of files; they train and are templates as well.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "cc0": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
#: Marks of which every template holds one at least (a test sees to it), so that a paragraph without any is like none of them.
STEMS = ["licen", "permission", "redistribut", "copyright", "warrant", "rights", "unencumbered", "gpl", "confidential", "cc by", "cc0", "creative commons"]
#: Lines that use the same words and are no notice.
OTHERS = [
    "The driver showed a license to the officer and went on", "A fishing license costs more this year", "The museum is open to the public on weekends",
    "Students of MIT built a small boat", "The apache helicopter landed near the river", "She published a general history of the city in three parts",
    "He worked for a foundation that plants trees", "Please see the table above for the version of each part", "The source of the river lies in the hills",
    "They released the birds into the garden", "The permission slip was signed by both parents", "Free copies of the map are at the desk",
    "The software crashed twice before lunch", "A person of general interest was invited", "The common room is on the first floor",
    "International trains leave from the north station", "The conditions on the road were poor", "He was granted a leave of two weeks",
    "The file was lost when the disk failed", "All the rights and wrongs of the case were heard", "A creative idea won the prize",
    "The terms of the loan were fair", "The library closes at eight", "Attribution of the painting is disputed",
    "The law was changed last spring", "Her work on the bridge was done by June", "Mozilla makes a browser", "The work is hard and the pay is low",
    "The clause at the end of the sentence is wrong", "Domain names are cheap", "The forms must be handed in by noon",
    "His copyright lecture ran for an hour", "The company lost its license to sell beer", "Version two of the plan was better",
    "Use the stairs in case of fire", "You may use the side door", "The binary star rises late", "A copy of the letter was found",
    "The author signed the book", "Commercial traffic uses the tunnel", "The public was not admitted", "Universal remote controls are sold here",
]
#: Words too common to tell a notice by.
COMMON = set("a an and any are as at be by can for found found from has have in into is it its may not of on or our out part see so that the this to under use was we which with without you your be met all provided following first v one two".split())
TOKENS = r"[^\p{L}\p{N}]+"
UNKNOWN = "unknown"
#: Least calibrated probability of a named family; least share of a template's n-grams that confirms it.
LEAST_P, LEAST_SHARE = 0.5, 0.6
#: Anchors that are further apart belong to different stretches.
GAP = 10
BLANK_LINES = r"\n[^\S\n]*\n\s*"


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


ANCHORS = sorted({w for texts in TEMPLATES.values() for t in texts for w in plain_words(t) if w not in COMMON and not w.isdigit() and w not in ("example", "corporation", "2024")})


def plain_grams(words: list[str]) -> set[str]:
    """Anchors, and pairs and triples of words with an anchor in them."""
    known = set(ANCHORS)
    return {" ".join(g) for k in (1, 2, 3) for i in range(len(words) - k + 1) if known & set(g := words[i : i + k])}


def grams(words: Column, anchor: Column) -> Column:
    """The same on a column of word arrays, and one that tells for each word whether it is an anchor."""

    def of(k: int) -> Column:
        at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
        at = F.filter(at, lambda i: F.exists(F.slice(anchor, i, k), lambda x: x))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, k), " "))

    return F.array_distinct(F.flatten(F.array(of(1), of(2), of(3))))


def known_texts() -> list[tuple[str, str]]:
    """(family, text) of all templates."""
    return [(f, t) for texts in (TEMPLATES, NOTICES) for f, held in texts.items() for t in held]


def training_rows() -> list[dict]:
    """Notices and other lines, whole, with words left out, in parts, and with words around them; every fourth variant calibrates."""
    rows = []
    lines = known_texts() + [(UNKNOWN, t) for t in OTHERS]
    around = ["", "note that ", "as said above ", "for this part see the end "]
    for n, (family, text) in enumerate(lines):
        words = plain_words(text)
        variants = [words, *([w for i, w in enumerate(words) if i % k != k - 1] for k in (5, 7, 9)), *(plain_words(a) + words + plain_words(b) for a, b in zip(around[1:], around[:0:-1]))]
        if len(words) > 40:  # stretches of a whole notice
            variants += [words[i : i + 30] for i in range(0, len(words) - 15, 15)]
        for i, v in enumerate(variants):
            rows.append({"family": family, "grams": sorted(plain_grams(v)), "fit": (n + i) % 4 != 0 or i == 0})
    # Lone anchors and pairs cut from notices are no notices.
    for texts in TEMPLATES.values():
        for t in texts:
            words = plain_words(t)
            rows += [{"family": UNKNOWN, "grams": sorted(plain_grams([w])), "fit": True} for w in words if w in ANCHORS]
    rows += [{"family": UNKNOWN, "grams": [], "fit": True}] * 40
    return rows


@dataclass
class Model:
    families: list[str]  # unknown comes first
    bias: list[float]
    weights: list[dict]  # gram, w (by family)
    temperature: float


def train(spark: SparkSession) -> Model:
    """Fit the classifier on the notices above; the same in every run."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    families = [UNKNOWN, *TEMPLATES]
    rows = [r | {"label": float(families.index(r["family"]))} for r in training_rows()]
    data = literal_table(spark, rows, "family string, grams array<string>, fit boolean, label double").coalesce(1).cache()
    fit = data.where("fit")
    vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(fit)
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=0.003, standardization=False).fit(vectors.transform(fit))
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = [{"gram": g, "w": [round(float(x), 6) for x in matrix[:, i]]} for i, g in enumerate(vectors.vocabulary)]
    # The temperature with the least surprise on the variants that were kept out.
    kept = [(int(r["label"]), [float(x) for x in r["rawPrediction"]]) for r in model.transform(vectors.transform(data.where("not fit"))).select("label", "rawPrediction").collect()]
    data.unpersist()

    def surprise(t: float) -> float:
        return sum(math.log(sum(math.exp((x - raw[y]) / t) for x in raw)) for y, raw in kept)

    temperature = min((0.5 + 0.05 * i for i in range(60)), key=surprise)
    return Model(families, [round(float(b), 6) for b in bias], weights, temperature)


def _noted(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for stem in STEMS:
        out = out | F.contains(low, F.lit(stem))
    return out


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, fp, paragraph (from 0), words of the paragraphs that have one of the stems."""
    noted = docs.where(_noted(F.col("text")))
    parts = noted.select("doc_id", "fp", F.posexplode(F.split("text", BLANK_LINES)).alias("paragraph", "part")).where(_noted(F.col("part")))
    return parts.select("doc_id", "fp", "paragraph", _once(F.array_remove(F.split(F.lower("part"), TOKENS), "")).alias("words"))


def _once(column: Column) -> Column:
    """The same value, computed once a row: the optimizer can't copy it into the expressions that use it (such as one for every word)."""
    return F.explode(F.array(column))


def stretches(docs: DataFrame) -> DataFrame:
    """doc_id, fp, paragraph, stretch (from 0), words of the stretches of each paragraph, with the two words before and after."""
    words = paragraphs(docs).where(F.size("words") > 0)
    at = words.withColumn("at", _once(F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.element_at("words", i).isin(ANCHORS)))).where(F.size("at") > 0)
    far = lambda j: (j == 1) | (F.element_at("at", j) - F.element_at("at", F.greatest(j - 1, F.lit(1))) > GAP)
    begins = at.withColumn("first", _once(F.filter(F.sequence(F.lit(1), F.size("at")), far)))
    last = lambda r: F.when(r < F.size("first"), F.element_at("first", F.least(r + 1, F.size("first"))) - 1).otherwise(F.size("at"))

    def cut(r: Column) -> Column:
        lo = F.greatest(F.element_at("at", F.element_at("first", r)) - 2, F.lit(1))
        return F.slice("words", lo, F.element_at("at", last(r)) + 2 - lo + 1)

    runs = F.transform(F.sequence(F.lit(1), F.size("first")), cut)
    return begins.select("doc_id", "fp", "paragraph", F.posexplode(runs).alias("stretch", "words"))


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Stretches that a family is named for: doc_id, fp (text_key), paragraph, stretch, family, probability, template_share, confirmed.

    Rows are told apart by doc_id and text; rows that repeat both are one.
    Null and empty texts have no paragraphs.
    """
    spark = docs.sparkSession
    model = model or train(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("fp"))
    marked = stretches(base).withColumn("anchor", _once(F.transform("words", lambda w: w.isin(ANCHORS))))
    found = marked.withColumn("grams", _once(grams(F.col("words"), F.col("anchor")))).drop("words", "anchor").dropDuplicates(["doc_id", "fp", "paragraph", "stretch"])
    place = ["doc_id", "fp", "paragraph", "stretch"]
    weights = F.broadcast(literal_table(spark, model.weights, "gram string, w array<double>"))  # bounded by the templates
    sums = [F.sum(F.coalesce(F.col("w")[i], F.lit(0.0))).alias(f"z{i}") for i in range(len(model.families))]
    raw = found.select(*place, F.explode("grams").alias("gram")).join(weights, "gram", "left").groupBy(*place).agg(*sums, F.collect_list("gram").alias("grams"))
    z = F.array(*[(F.col(f"z{i}") + b) / model.temperature for i, b in enumerate(model.bias)])
    scored = raw.select(*place, "grams", z.alias("z"))
    p = F.transform("z", lambda x: F.exp(x - F.array_max("z")))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    best = F.array_position("z", F.array_max("z"))
    named = scored.select(*place, "grams", F.element_at(F.array(*map(F.lit, model.families)), best.cast("int")).alias("family"), (1 / total).alias("probability"))
    named = named.where((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST_P))
    templates = [{"family": f, "size": len(g), "held": sorted(g)} for f, t in known_texts() if (g := plain_grams(plain_words(t)))]
    shares = named.join(F.broadcast(literal_table(spark, templates, "family string, size int, held array<string>")), "family")
    share = F.size(F.array_intersect("grams", "held")) / F.col("size")
    per = shares.groupBy(*place, "family", "probability").agg(F.max(share).alias("template_share"))
    return per.withColumn("confirmed", F.col("template_share") >= LEAST_SHARE)


def scan_licenses(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, n_paragraphs (that aren't blank), n_named, n_confirmed (stretches), families, license, probability.

    families are the confirmed ones, sorted and comma-joined; license is that
    of the confirmed stretch with the largest probability (the first of
    equals), or unknown.  Null and empty texts have no paragraphs.  Every row
    reports what its own text holds, whatever other rows share its doc_id, and
    also without one.
    """
    named = classify(docs, model)
    order = Window.partitionBy("doc_id", "fp").orderBy(F.desc("confirmed"), F.desc(F.round("probability", 9)), "paragraph", "stretch")
    top = named.withColumn("r", F.row_number().over(order))
    chosen = F.when((F.col("r") == 1) & F.col("confirmed"), F.struct("family", "probability"))
    families = F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",")
    per = top.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n_named"), F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"), families.alias("families"), F.max(chosen).alias("top"))
    per = per.withColumnsRenamed({"doc_id": "_id", "fp": "_fp"})
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), BLANK_LINES), lambda x: F.rlike(x, F.lit(r"\S")))).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("fp"), F.col("text").cast("string").alias("text")).select("doc_id", "fp", count.alias("n_paragraphs"))
    out = base.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_named", zero).alias("n_named"), F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("top.family", F.lit(UNKNOWN)).alias("license"), F.coalesce("top.probability", F.lit(0.0)).alias("probability"))
