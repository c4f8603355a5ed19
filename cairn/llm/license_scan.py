"""License scans: phrases, and an exact set-similarity join of text blocks with a table of license templates.

A block is a run of consecutive words, across line ends, of the length of a template over THRESHOLD at most; it contains
the template when it has at least THRESHOLD of the template's distinct words. All documents with such a block are found
by prefix filtering: the templates' words are ordered by their number of documents in the whole corpus, the rarest first;
a block that reaches an overlap of o with a template of n words must have one of the template's first n - o + 1 words.
The prefix words are an index that joins the words of the documents. What it finds passes a length filter (a document of
fewer words than the overlap has no block) and a position filter (around the found word only as many words lie as a block
can hold, and the template's rarer words are not in it, or it would have been found by them), and is verified.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WORD, ascii_lower, settle, table

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public license notices, by label.
NOTICES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License"),
    ("apache", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "All rights reserved."),
)
THRESHOLD = 0.8
#: Templates are a stated table of the plan; this bounds the index that is broadcast (a few hundred bytes a template).
MOST_TEMPLATES = 10_000


def word_list(text: str) -> list[str]:
    import re

    return [w for w in re.split(NOT_WORD, text.translate({k: chr(k + 32) for k in range(65, 91)})) if w]


def spaced(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, each once between single spaces.

    Letters beyond ASCII may be lower-cased, too: no word that is looked for has one. Only the Kelvin sign and the I with
    a dot would turn into ASCII letters; texts with these are translated letter by letter.
    """
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORD, " "))
    return F.when(words.contains("\u212a") | words.contains("\u0130"), ascii_lower(words)).otherwise(F.lower(words))


def places(words: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often the phrase's words stand consecutively, and the first and last start (null without any)."""
    regex = f"(?<![^ ]){phrase}(?![^ ])"
    stands = words.contains(f" {phrase} ") | words.startswith(f"{phrase} ") | words.endswith(f" {phrase}") | (words == phrase)
    parts = F.when(stands, F.split(words, regex, -1))
    count = lambda part: F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))  # noqa: E731  spaces before or after it
    n = F.coalesce(F.size(parts) - 1, F.lit(0)).cast("long")
    last = n_words - count(F.element_at(parts, -1)) - len(phrase.split())
    return F.greatest(n, F.lit(0)).cast("long"), count(F.element_at(parts, 1)).cast("long"), last.cast("long")


def any_of(words: Sequence[str]) -> str:
    """A pattern of the words in which those that begin alike share their beginning, so that few are tried at a place."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by.setdefault(w[:1], []).append(w[1:])
    ends = "" in by
    parts = [c + any_of(rest) if rest != [""] else c for c, rest in by.items() if c]
    return ("(?:" + "|".join(parts) + ")" if len(parts) > 1 or ends and parts else "".join(parts)) + ("?" if ends and parts else "")


def prefix_index(spark: SparkSession, templates: Sequence[tuple[str, str]], order: Mapping[str, int], threshold: float) -> DataFrame:
    """word, label, need, size, length, rarer, t: a row for every template and word of its prefix.

    size: distinct words; need: of which a block has so many; length: words of the longest block; rarer: the prefix words
    before this one; t: the distinct words.
    """
    rows = []
    for label, text in templates:
        all_words = word_list(text)
        t = sorted(set(all_words), key=lambda w: (order.get(w, 0), w))
        need = math.ceil(threshold * len(t) - 1e-9)
        length = math.floor(len(all_words) / threshold + 1e-9)
        for i, w in enumerate(t[: len(t) - need + 1]):
            words = lambda x: F.array(*[F.lit(y) for y in x]).cast("array<string>")
            rows.append(F.struct(F.lit(w).alias("word"), F.lit(label).alias("label"), F.lit(need).alias("need"), F.lit(len(t)).alias("size"), F.lit(length).alias("length"), words(t[:i]).alias("rarer"), words(t).alias("t")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def matches(rare: DataFrame, index: DataFrame, key: str = "_row") -> DataFrame:
    """key, label, score: every template that some block of a document has. rare: key, words (array), hit (its prefix words)."""
    each = rare.select(key, "words", F.explode("hit").alias("word")).join(F.broadcast(index), "word").where(F.size("words") >= F.col("need"))
    # of several prefix words of a template the rarest in the document leads; blocks without it are found by the next one
    where = F.filter(F.transform("words", lambda w, i: F.when(w == F.col("word"), i)), lambda i: i.isNotNull())
    low = lambda p: F.greatest(p - F.col("length") + 1, F.lit(0))
    spans = F.transform(where, lambda p: F.struct(F.slice("words", low(p) + 1, p - low(p) + F.col("length")).alias("span"), (p - low(p)).alias("p")))
    rest = ["label", "need", "size", "length", "rarer", "t"]
    near = each.select(key, *rest, spans.alias("spans")).select(key, *rest, F.explode("spans").alias("s")).select(key, *rest, "s.span", "s.p")
    near = near.where(F.size(F.array_intersect("span", "t")) >= F.col("need"))
    block = lambda start: F.slice("span", start + 1, F.col("length"))
    free = lambda b: ~F.arrays_overlap(b, "rarer")
    overlap = lambda start: F.when(free(block(start)), F.size(F.array_intersect(block(start), "t"))).otherwise(0)
    # only blocks that begin with a word of the template: any other one's words are in a later one, too
    starts = F.filter(F.sequence(F.lit(0), F.col("p")), lambda i: F.array_contains("t", F.get("span", i)))
    best = F.array_max(F.transform(starts, overlap))
    found = near.select(key, "label", best.alias("o"), "need", "size").where("o >= need")
    return found.groupBy(key, "label").agg(F.max(F.col("o") / F.col("size")).alias("score"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD, phrases: Mapping[str, str] = PHRASES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    labels are those of the phrases and of the templates. score is 1 with a phrase, else the largest share of a
    template's words found in one block, 0 without any. Null and empty texts have no words, no labels (empty strings)
    and score 0; very long texts are read whole. Repeated rows are scanned alike; only the id and the text are read; an empty input gives an empty result.
    """
    if len(templates) > MOST_TEMPLATES or any(not word_list(t) for _, t in templates):
        raise ValueError(f"templates have words, and there are {MOST_TEMPLATES} at most")
    vocabulary = sorted({w for _, text in templates for w in word_list(text)})
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = text.withColumn("words", spaced(F.col("text")))
    n_words = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace(F.col("words"), F.lit(" "), F.lit(""))) + 1)
    at = [(label, *places(F.col("words"), F.col("n_words"), p)) for p, label in phrases.items()]
    stands = F.array(*[F.struct(F.lit(label).alias("label"), n.alias("n"), lo.alias("lo"), hi.alias("hi")) for label, n, lo, hi in at])
    vocab = F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")
    own = F.array_intersect(F.split("words", " "), vocab)
    # the texts are read twice: here for all that needs no order, below only those that have a prefix word
    seen = words.select("doc_id", F.xxhash64("text").alias("h"), n_words.cast("long").alias("n_words"), "words").select("doc_id", "h", "n_words", stands.alias("base"), own.alias("own"))
    seen = settle(seen)
    order = {r.word: r.n for r in seen.select(F.explode("own").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per template word
    found = seen.select("doc_id", "h", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score")).limit(0)
    if templates:
        index = prefix_index(docs.sparkSession, templates, order, threshold)
        rare = sorted({r.word for r in index.select("word").collect()})  # literals of the plan come back
        hit = lambda w: F.array_intersect(w, F.array(*[F.lit(x) for x in rare]))
        inside = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
        any_rare = f"(?i)(?<!{inside}){any_of(rare)}(?!{inside})"
        some = text.where(F.regexp_like("text", F.lit(any_rare))).select("doc_id", F.xxhash64("text").alias("h"), F.split(spaced(F.col("text")), " ").alias("words"))
        one = some.withColumn("hit", hit(F.col("words"))).withColumn("_row", F.struct("doc_id", "h"))
        found = matches(one.select("_row", "words", "hit"), index).select("_row.doc_id", "_row.h", "label", "score")
    by = found.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    seen = seen.join(by, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    base = F.filter("base", lambda b: b.n > 0)
    labels = F.transform(base, lambda b: b.label)
    n_base = F.aggregate(base, F.lit(0).cast("long"), lambda a, b: a + b.n)
    score = F.when(n_base > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return seen.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min(F.transform(base, lambda b: b.lo)).alias("first_word"), F.array_max(F.transform(base, lambda b: b.hi)).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), score.alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    sep = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES.items())
    notices = ", ".join(f"('{label}', {sorted(set(word_list(n)))}, {len(word_list(n))})" for label, n in NOTICES)
    return rf"""
WITH phrase(p, label) AS (VALUES {phrases}), notice(label, t, m) AS (VALUES {notices}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex({low("text")}, '{sep}'), lambda x: x <> '') AS w FROM d),
pos AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w),
hit AS (SELECT doc_id, label, i FROM pos JOIN phrase ON w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hit GROUP BY doc_id),
first_(word, label, t, m) AS (SELECT unnest(t), label, t, m FROM notice),
block AS (SELECT doc_id, label, t, w[i + 1 : i + CAST(floor(m / {THRESHOLD} + 1e-9) AS BIGINT)] AS b FROM pos JOIN first_ ON w[i + 1] = word),
near AS (SELECT doc_id, label, max(len(list_intersect(t, b)) / len(t)) AS score FROM block WHERE len(list_intersect(t, b)) >= ceil({THRESHOLD} * len(t) - 1e-9) GROUP BY ALL),
lab AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hit UNION ALL SELECT doc_id, label FROM near) GROUP BY doc_id),
best AS (SELECT doc_id, max(score) AS score FROM near GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN lab USING (doc_id) LEFT JOIN best USING (doc_id)
"""


SQL = _sql()
