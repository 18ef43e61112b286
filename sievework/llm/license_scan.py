"""License scan, in DataFrame functions only.

Base: the places where the words of a license phrase stand consecutively.
Method: an exact set-similarity join of text blocks with license templates. Blocks are overlapping windows of words, whatever the
line ends are: a template of n words belongs to the least class c = 8, 16, 32, ... that has n, and the blocks of a class are 2c
words long and start at every multiple of c, so each run of c words stands in one of them whole. Template tokens have a global
order, rarest in the corpus first, by document counts over all documents. A block that holds a share `threshold` of a template's
distinct tokens holds one of its prefix, the first size - need + 1 tokens; the length filter drops blocks with fewer template
tokens than needed, the positional filter drops matches after which too few tokens are left on either side, and the rest is
verified. The blocks of templates of up to `SHORT` words are far longer than these, so a few common words could meet in them by
chance: such a template must also hold its share within a run of words / threshold words of the block, of which the score is taken.

Templates and phrases are small inputs of bounded size. Results: null or empty texts have no words, no places and score 0;
repeated rows get equal results; an empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The phrases of the base and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Notices, headers and whole texts of well-known licenses, and the label of each.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
        in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
    ),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN
        NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
LEAST_CLASS = 8
#: Templates of up to so many words are looked for in runs of their own length.
SHORT = 16


def _class(words: int) -> int:
    size = LEAST_CLASS
    while size < words:
        size *= 2
    return size


def _run(words: int, threshold: float) -> int:
    """Words of a run that may hold a template of `words` words."""
    return ceil(words / threshold - 1e-9)


def _template_rows(spark: SparkSession, templates: list[tuple[str, str]]) -> list[tuple[int, str, list[str], int]]:
    """Number, label, distinct words and count of words of each template, by the words' own definition. As many rows as templates."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, label string, text string")
    words = rows.select("template", "label", common.word_array(F.col("text")).alias("words"))
    return [(r.template, r.label, r.tokens, r.n) for r in words.select("template", "label", F.array_distinct("words").alias("tokens"), F.size("words").alias("n")).collect()]


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _places(words: Column, present: Column, phrase: list[str]) -> Column:
    """Where the phrase starts; looked for only if all its words are there."""
    everywhere = F.sequence(F.lit(0), F.size(words) - len(phrase))
    stands = lambda i: F.expr("true") if not phrase else _all([F.get(words, i + j) == F.lit(w) for j, w in enumerate(phrase)])
    return F.when(_all([F.array_contains(present, w) for w in phrase]) & (F.size(words) >= len(phrase)), F.filter(everywhere, stands)).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, phrases: list | None = None, templates: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Two frames. Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a
    template that a block, or a run if it is short, holds; 1 for a phrase). Per match: _id, _h, size and start (words) of the block, label, template, score."""
    spark = docs.sparkSession
    phrases = [(p.split(" "), label) for p, label in (phrases or PHRASES)]
    rows = _template_rows(spark, templates or TEMPLATES)
    need = {t: max(1, ceil(threshold * len(tokens) - 1e-9)) for t, _, tokens, _ in rows}
    classes = sorted({_class(n) for *_, n in rows})
    vocabulary = sorted({w for _, _, tokens, _ in rows for w in tokens} | {w for p, _ in phrases for w in p})
    keyed = common.keyed(docs, id_col, text_col)
    words = keyed.withColumn("words", common.word_array(F.col("_text"))).withColumn("present", F.array_intersect("words", _strings(vocabulary)))
    words = words.select("_id", "_h", "_text", "present", F.size("words").cast("long").alias("n_words"), *(_places(F.col("words"), F.col("present"), p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)))
    # a block can't hold more of a template than its document does
    may = F.lit(False)
    for t, _, tokens, _ in rows:
        may = may | (F.size(F.array_intersect("present", _strings(tokens))) >= need[t])
    all_places = F.concat(*(F.col(f"p{i}") for i in range(len(phrases))))
    labels = F.array_distinct(F.concat(*(F.when(F.size(f"p{i}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for i, (_, label) in enumerate(phrases))))
    seen = words.select("_id", "_h", "n_words", "present", F.size(all_places).cast("long").alias("n_base"), F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"), labels.alias("base"), F.when(may, F.col("_text")).alias("_text"))
    seen = common.settled(seen, "seen")

    # the global order of the template tokens; a row per token of the templates
    counts = seen.select(F.explode("present").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    df = {r.token: r.df for r in counts.collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (df.get(w, 0), w)))}
    ordered = spark.createDataFrame([(t, label, sorted(tokens, key=rank.get), need[t], _class(n), _run(n, threshold)) for t, label, tokens, n in rows], "template int, label string, tokens array<string>, need int, size int, run int")
    prefix = ordered.select("template", "label", "tokens", "need", "size", "run", F.posexplode(F.expr("slice(tokens, 1, size(tokens) - need + 1)")).alias("i", "token"))
    by_rank = _strings(sorted(vocabulary, key=rank.get))

    texts = seen.where("_text is not null")
    # array_intersect keeps the order of its first argument, so the block's tokens come in the global order
    held = lambda words: F.array_intersect(by_rank, words)
    # texts stay where they are; what repeated rows find twice is one match below
    of_words = texts.select("_id", "_h", common.word_array(F.col("_text")).alias("words"))

    def blocks_of(size: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - size - 1), F.lit(size))
        whole = lambda i: F.slice("words", i + 1, 2 * size) if size <= SHORT else F.lit(None).cast("array<string>")
        return F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), i.alias("start"), held(F.slice("words", i + 1, 2 * size)).alias("block"), whole(i).alias("whole")))

    least = {c: min(need[t] for t, *_, n in rows if _class(n) == c) for c in classes}
    enough = lambda x: F.coalesce(*(F.when(x["size"] == c, F.size(x["block"]) >= n) for c, n in least.items()))
    every = F.filter(F.concat(*(blocks_of(c) for c in classes)), enough)
    blocks = of_words.select("_id", "_h", F.explode(every).alias("b")).select("_id", "_h", "b.*")
    probes = blocks.select("_id", "_h", "size", "start", "block", "whole", F.posexplode("block").alias("j", "token"))
    candidates = probes.join(F.broadcast(prefix), ["token", "size"]).where((F.size("block") >= F.col("need")) & (F.lit(1) + F.least(F.size("tokens") - F.col("i") - 1, F.size("block") - F.col("j") - 1) >= F.col("need")))
    # the most tokens of the template that a run, or the block if the template is long, holds
    runs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("whole") - F.col("run")))
    in_run = F.array_max(F.transform(runs, lambda i: F.size(F.array_intersect("tokens", F.slice("whole", i + 1, F.col("run"))))))
    in_block = F.size(F.array_intersect("block", "tokens"))
    held_most = F.when(in_block < F.col("need"), 0).when(F.col("whole").isNull(), in_block).otherwise(in_run)
    verified = candidates.select("_id", "_h", "size", "start", "label", "template", "need", held_most.alias("common"), F.size("tokens").alias("all")).where("common >= need")
    matches = common.settled(verified.select("_id", "_h", "size", "start", "label", "template", (F.col("common") / F.col("all")).alias("score")).distinct(), "matches")

    best = matches.groupBy("_id", "_h").agg(F.collect_set("label").alias("more"), F.max("score").alias("share")).withColumnRenamed("_id", "m_id").withColumnRenamed("_h", "m_h")
    out = seen.join(best, (F.col("_h") == F.col("m_h")) & F.col("_id").eqNullSafe(F.col("m_id")), "left")
    joined = F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    text = lambda c: F.array_join(F.sort_array(c), ",")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"), text(joined).alias("labels"), score.alias("score")), matches
