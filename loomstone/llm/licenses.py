"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are windows of words, twice as long as the templates that they are compared with (by classes of length: 16
words, 32, 64, ...) and half overlapping, so a template of the class that stands in a text lies in one of them whole. A
block contains a template when at least the threshold of the template's distinct words stand in it in the template's
order (that of their first places). Templates of under ten distinct words, where a single word tells licenses apart,
must stand as they are: all their words, one after another.

The join orders words by their frequency over the whole corpus, rarest first. A template's prefix is as many of
its rarest words as cannot all be missing; blocks and templates meet only on prefix words. Then the length
filter (a block needs as many template words as the threshold asks) and the positional filter (what may
still overlap after the first common word) drop candidates; the rest are counted exactly, and last their order is
verified by the longest common subsequence.

Everything is DataFrame expressions. The texts are read once: of a text that holds enough words of any template
the words are kept, of others only the distinct words that templates have, for the frequencies.

Edge cases: a null or empty text has no words, no places and no labels; a text without line breaks is cut like any
other, and of a very long one the blocks that hold no prefix word are never made; repeated rows are scanned each on
its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import written

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices whose words a block is compared with, and their labels.
TEMPLATES = [
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit-notice", "Released under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
]
#: Templates of fewer distinct words must stand whole; words of the shortest class of templates; bytes between words, for lower-cased text.
SHORT, CLASS = 10, 16
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() does more, but only two other characters become ASCII by it."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[\\u212A\\u0130]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def in_order(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def template_words(text: str) -> list[str]:
    """Distinct words in the order of their first places."""
    return list(dict.fromkeys(in_order(text)))


def needed(words: list[str], threshold: float) -> int:
    """How many of a template's distinct words must stand in a block."""
    return math.ceil(threshold * len(words) - 1e-9)


def length_class(text: str) -> int:
    n = CLASS
    while n < len(in_order(text)):
        n *= 2
    return n


def scanned(docs: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """A row per document: its words counted, phrase places, short templates, the templates' words that it has, and its words where they may hold a longer template."""
    text = F.coalesce(F.col("text"), F.lit(""))
    long, short = [t for t in templates if not is_short(t[1])], [t for t in templates if is_short(t[1])]
    vocabulary = sorted({w for _, t in long for w in template_words(t)})
    words = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("long"), F.array_remove(F.split(lowered(text), GAP), "").alias("words"))
    words = words.withColumn("known", F.array_intersect("words", F.array(*map(F.lit, vocabulary))) if long else F.array().cast("array<string>"))
    places = [_places(phrase.split(), label) for phrase, label in PHRASES.items()]
    none = F.array().cast("array<string>")
    whole = [F.when(F.size(_places(in_order(t), label)) > 0, F.array(F.lit(label))).otherwise(none) for label, t in short]
    enough = [F.size(F.array_intersect("known", F.array(*map(F.lit, template_words(t))))) >= needed(template_words(t), threshold) for _, t in long]
    return words.select(
        "row_key", "doc_id", F.size("words").cast("long").alias("n_words"), F.concat(*places).alias("places"), F.concat(none, *whole).alias("short"), "known",
        F.when(reduce(or_, enough, F.lit(False)), F.col("words")).alias("words"),
    )


def is_short(text: str) -> bool:
    return len(template_words(text)) < SHORT


def _places(phrase: list[str], label: str) -> Column:
    """Where the words of a phrase stand one after another; only texts that hold its words are walked."""
    last = F.size("words") - len(phrase)
    here = lambda i: reduce(and_, (F.element_at("words", i + k) == w for k, w in enumerate(phrase, 1)))
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: here(i))
    found = F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))
    able = reduce(and_, (F.array_contains("words", w) for w in phrase)) & (last >= 0)
    return F.when(able, found).otherwise(F.array().cast("array<struct<at: bigint, label: string>>"))


def common_subsequence(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence of two arrays of words, without repeats in b."""
    # Entry j of a row: the longest within b's first j words. A word of a lifts the entries from its place on to one more than what stands before it.
    start = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def step(row: Column, word: Column) -> Column:
        at = F.array_position(b, word).cast("int")
        lifted = F.element_at(row, F.greatest(at, F.lit(1))) + 1
        return F.when(at > 0, F.transform(row, lambda v, j: F.when((j >= at) & (v < lifted), lifted).otherwise(v))).otherwise(row)

    return F.aggregate(a, start, step, lambda row: F.element_at(row, -1))


def _blocks(size: int, starts: list[str]) -> Column:
    """The windows of a class of templates that hold a word of `starts`."""
    probe = F.array(*map(F.lit, starts))
    window = lambda k: F.slice("words", k * size + 1, F.lit(2 * size))
    last = F.greatest(F.lit(0), F.ceil(F.size("words") / size).cast("int") - 1)
    near = F.filter(F.sequence(F.lit(0), last), lambda k: F.arrays_overlap(window(k), probe))
    some = F.transform(near, lambda k: F.struct(F.lit(size).alias("class"), k.alias("block"), window(k).alias("window")))
    return F.when(F.arrays_overlap("words", probe), some).otherwise(F.array().cast("array<struct<class: int, block: int, window: array<string>>>"))


def contained(scan: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(row_key, label, containment) of the templates of ten words and more that stand in a block."""
    spark = scan.sparkSession
    templates = [t for t in templates if not is_short(t[1])]
    if not templates:
        return spark.createDataFrame([], "row_key long, label string, containment double")
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    counted = scan.select(F.explode("known").alias("token")).groupBy("token").count()
    frequency = dict.fromkeys(vocabulary, 0) | {r["token"]: r["count"] for r in counted.collect()}  # a row per template word at most
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency[w], w)))}
    prefixes, whole = [], []
    for label, text in templates:
        words = sorted(template_words(text), key=rank.get)
        need, size = needed(words, threshold), length_class(text)
        whole.append((label, template_words(text)))
        prefixes += [(w, label, size, k, len(words), need) for k, w in enumerate(words[: len(words) - need + 1])]
    prefix = spark.createDataFrame(prefixes, "token string, label string, class int, at int, size int, need int")
    full = spark.createDataFrame(whole, "label string, sequence array<string>")
    order = F.create_map(*[F.lit(x) for w, k in rank.items() for x in (w, k)])
    made = [_blocks(size, sorted({p[0] for p in prefixes if p[2] == size})) for size in sorted({p[2] for p in prefixes})]
    blocks = scan.where("words is not null").select("row_key", F.explode(F.concat(*made)).alias("b")).select("row_key", "b.*")
    blocks = blocks.withColumn("tokens", F.array_intersect("window", F.array(*map(F.lit, vocabulary))))
    met = blocks.withColumn("token", F.explode("tokens")).join(F.broadcast(prefix), ["token", "class"])
    met = met.where(F.size("tokens") >= F.col("need"))  # length filter
    # Position of the common word among the block's template words, by corpus frequency.
    behind = F.size(F.filter("tokens", lambda t: order[t] > order[F.col("token")]))
    met = met.where(F.col("at") + 1 + F.least(F.col("size") - F.col("at") - 1, behind) >= F.col("need"))  # positional filter
    # A pair that shares several prefix words is met by its first one alone.
    first = F.row_number().over(Window.partitionBy("row_key", "class", "block", "label").orderBy("at"))
    pairs = met.select("row_key", "class", "block", "label", "window", "size", "need", "at").withColumn("r", first).where("r = 1")
    pairs = pairs.join(F.broadcast(full), "label").where(F.size(F.array_intersect("window", "sequence")) >= F.col("need"))
    ordered = pairs.withColumn("ordered", common_subsequence(F.col("window"), F.col("sequence"))).where("ordered >= need")
    return ordered.groupBy("row_key", "label").agg(F.max(F.col("ordered") / F.col("size")).alias("containment"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest containment of a template found, and 1 where a phrase stands.
    """
    scan = written(scanned(docs, templates, threshold), "scan")
    found = contained(scan, templates, threshold).groupBy("row_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    starts = F.transform("places", lambda p: p["at"])
    labels = F.array_union(base, F.array_union("short", F.coalesce("more", F.array().cast("array<string>"))))
    return scan.select("row_key", "doc_id", "n_words", "places", "short").join(found, "row_key", "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when((F.size("places") > 0) | (F.size("short") > 0), 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
