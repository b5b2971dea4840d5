"""License scans: phrases, and an exact set-similarity join of runs of words with templates; built-in expressions only.

A block is a run of consecutive words of the whole text, across line breaks: for a template
of n words, every run of up to 100 / THRESHOLD as many (``span``), so that a long text does not
meet it by scattered words. A template is met by a text with a run that holds at least
THRESHOLD percent of the template's distinct words. Template words are ordered by how many
documents hold them, rarest first, over the whole corpus. A run that meets a template of t
words, of which it must hold a, holds one of the t - a + 1 rarest (prefix), and so does its
text; a text has at least a of the words (length); and if the first template word it shares
stands at place i, it can share t - i at most (position). Texts are joined with the prefixes
on their words; in those that the filters leave and that hold enough words at all, runs are
counted exactly, from each template word on. Templates are a fixed list, so they are broadcast.

Defined results: null counts as empty; without a word first_word and last_word are null;
rows are judged each for itself, repeated ones alike; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.nativetext import lower_ascii, words

THRESHOLD = 80
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The paragraphs of well-known notices, by label.
TEMPLATES = {
    "mit-release": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "mit-rights": "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-terms": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program. If not, see",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-warranty": "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
}


def needed(size: int, percent: int) -> int:
    return max(1, -(-size * percent // 100))


def span(size: int, percent: int) -> int:
    """Words of a run that may meet a template of ``size`` words, repeated ones included."""
    return -(-size * 100 // percent)


def template_words(templates: DataFrame) -> DataFrame:
    """(label, words, n): the distinct words of each template (label, text), and how many it has with repeated ones."""
    own = words(F.col("text"))
    return templates.select("label", F.array_distinct(own).alias("words"), F.size(own).alias("n")).where(F.size("words") > 0)


def matches(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, label, containment): every template that a text meets, by its best run."""
    spark = docs.sparkSession
    given = spark.createDataFrame(list((TEMPLATES if templates is None else templates).items()), "label string, text string")
    sets = {r["label"]: (r["words"], r["n"]) for r in template_words(given).collect()}
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).where("text is not null")
    universe = sorted({w for own, _ in sets.values() for w in own})
    # Explode of one element: filters are not pushed below it, so what it holds is found once a row.
    once = lambda c: F.explode(F.array(c))
    text = text.select("*", once(F.array_intersect(words(F.col("text")), F.lit(universe))).alias("have"))
    held = text.select(F.explode("have").alias("w"))
    # One row for each word of the templates at most.
    df = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    prefixes = []
    for label, (own, n) in sets.items():
        ranked = sorted(own, key=lambda w: (df.get(w, 0), w))
        a = needed(len(ranked), percent)
        prefix = ranked[: len(ranked) - a + 1]
        prefixes += [(w, label, i, len(ranked), a, span(n, percent), prefix, ranked) for i, w in enumerate(prefix)]
    rare = sorted({p[0] for p in prefixes})
    table = spark.createDataFrame(prefixes, "w string, label string, place int, size int, need int, span int, prefix array<string>, own array<string>")

    posted = text.select("doc_id", "text_hash", "text", "have", F.explode(F.array_intersect("have", F.lit(rare))).alias("w"))
    met = posted.join(F.broadcast(table), "w").where((F.size("have") >= F.col("need")) & (F.col("size") - F.col("place") >= F.col("need")))
    # Once for each template: at the first of its words that the text holds.
    met = met.where((F.get(F.array_intersect("prefix", "have"), F.lit(0)) == F.col("w")) & (F.size(F.array_intersect("have", "own")) >= F.col("need")))
    places = F.filter(F.transform(words(F.col("text")), lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains("own", x["w"]))
    met = met.select("doc_id", "text_hash", "label", "need", "size", "span", once(places).alias("places"))
    # A run from a place on has at most ``span`` of the next places.
    near = lambda x, k: F.filter(F.slice("places", k + 1, F.col("span")), lambda y: y["i"] < x["i"] + F.col("span"))
    best = F.array_max(F.transform("places", lambda x, k: F.size(F.array_distinct(F.transform(near(x, k), lambda y: y["w"])))))
    met = met.select("doc_id", "text_hash", "label", "need", "size", once(best).alias("both")).where("both >= need")
    return met.select("doc_id", "text_hash", "label", (F.col("both") / F.col("size")).alias("containment")).distinct()


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, text_hash of every row of ``docs`` (doc_id, text, ...)."""
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    own = text.select("doc_id", "text_hash", words(F.col("text")).alias("words"))
    # Each word between spaces of its own, so that neighbours don't share one.
    own = own.select("doc_id", "text_hash", F.size("words").cast("bigint").alias("n_words"), F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")).alias("s"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        p = " " + phrase.replace(" ", "  ") + " "
        some = F.contains("s", F.lit(p))
        before = F.substring_index("s", p, 1)
        after = F.substring_index("s", p, -1)
        spaces = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))
        counts.append(F.when(some, (F.char_length("s") - F.char_length(F.replace("s", F.lit(p), F.lit("")))) / len(p)).otherwise(0))
        firsts.append(F.when(some, spaces(before) / 2))
        lasts.append(F.when(some, F.col("n_words") - spaces(after) / 2 - len(phrase.split())))
        labels.append(F.when(some, F.lit(label)))
    base = own.select("doc_id", "text_hash", "n_words", sum(counts[1:], counts[0]).cast("bigint").alias("n_base"), F.least(*firsts).cast("bigint").alias("first_word"), F.greatest(*lasts).cast("bigint").alias("last_word"), F.array_sort(F.array_compact(F.array(*labels))).alias("base"))
    found = matches(docs, templates, percent).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    out = base.join(found, base["doc_id"].eqNullSafe(found["doc_id"]) & (base["text_hash"] == found["text_hash"]), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return out.select(base["doc_id"], "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
