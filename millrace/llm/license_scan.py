"""License scan by an exact set-similarity join of text blocks against license templates.

A template matches where a run of a document's words, a quarter longer than the template, holds at least `threshold` of
the template's distinct words; line breaks and what else stands between words count for nothing, so a notice may be
wrapped. Runs lie in blocks: pieces of as many words as the longest run, each with the next one. Candidates come from a
prefix-filtered join of blocks with templates: words are ordered by the number of their places, the rarest first; a pair
that shares c words has one in common among the first |T| - c + 1 of the template and the first |B| - c + 1 of the block.
Length and positional bounds drop pairs before the exact check, which looks at the runs. Stock phrases (words that stand
consecutively) are counted besides.

DataFrame functions only. The templates are a parameter of at most MAX_WORDS words, so they are small by contract.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, text_or_empty

#: Anything but digits, letters a-z and characters beyond ASCII parts words (after A-Z are lower-cased).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_WORDS = 5000

# Phrases of the base labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Opening sentences and notices of public licenses.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    """The words, separated and surrounded by one space; one space if there are none."""
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.rtrim(F.regexp_replace(ascii_lower(text), GAP, " ")), F.lit(" "))))


def places(spaced: Column, words: Column, phrase: str) -> Column:
    """Word numbers, from 0, at which the phrase's words stand consecutively; words has to be a column, not an expression."""

    def here(i: Column) -> Column:
        return reduce(Column.__and__, [F.get(words, i + k) == w for k, w in enumerate(phrase.split())])

    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    return F.when(F.contains(spaced, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


def template_table(templates: list[tuple[str, str]]) -> list[tuple[int, str, list[str], int]]:
    """Number, label, distinct words and length of run of each template."""
    cut = [(i, label, [w for w in re.split(GAP, text.lower()) if w]) for i, (label, text) in enumerate(templates)]
    table = [(i, label, sorted(set(words)), math.ceil(1.25 * len(words))) for i, label, words in cut if words]
    if sum(len(words) for _, _, words, _ in table) > MAX_WORDS:
        raise ValueError(f"templates hold more than {MAX_WORDS} words")
    return table


def word_ranks(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """The templates' words by the number of their places in all documents, the rarest first."""
    words = docs.select(F.explode(F.split(F.trim(words_of(text_or_empty(text_col))), " ")).alias("w"))
    counted = {r["w"]: r["n"] for r in words.where(F.col("w").isin(vocabulary)).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per row of docs: the id column, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place of every phrase; first_word and last_word are the smallest and largest start, null
    without a place. Labels are distinct, sorted and comma-joined ('' without any); `labels` holds the base labels and
    those of matching templates. score: 1 with a base label, else the best containment that reaches the threshold,
    else 0. Null and empty text have no words and no labels. Null and repeated ids give rows of their own. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    table = template_table(templates)
    vocabulary = sorted({w for _, _, words, _ in table for w in words})
    rank = word_ranks(docs, vocabulary, text_col)
    prefixes = []
    for i, label, words, run in table:
        words.sort(key=rank.get)
        least = math.ceil(threshold * len(words) - 1e-9)
        prefixes += [(w, i, label, words, at, len(words), least, run) for at, w in enumerate(words[: len(words) - least + 1])]
    template_words = spark.createDataFrame(prefixes, "word string, template int, label string, words array<string>, at int, size int, least int, run int")
    rare = sorted({p[0] for p in prefixes})
    longest = max((run for *_, run in table), default=1)

    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # Cut into words once; what follows refers to the column, so that no expression cuts them again.
    spaced = docs.withColumn("spaced", words_of(F.col("text"))).withColumn("words", F.split(F.trim("spaced"), " "))
    spaced = spaced.withColumns({f"at_{i}": places(F.col("spaced"), F.col("words"), p) for i, p in enumerate(phrases)})
    found = F.concat(*[F.col(f"at_{i}") for i in range(len(phrases))])
    base = F.filter(F.array(*[F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]), lambda x: x.isNotNull())
    # Only documents that hold a word of some template's prefix are cut into blocks; of them only blocks that do go on.
    has_rare = F.arrays_overlap("words", F.lit(rare))
    # One pass cuts the words into pieces; `pieces` is a column, so that a block finds its two without cutting again.
    pieces = F.regexp_extract_all(F.ltrim("spaced"), F.lit(f"(?:[^ ]++ ){{1,{longest}}}+"), F.lit(0))
    spaced = spaced.withColumn("pieces", F.when(has_rare, pieces))
    block = lambda i: F.split(F.rtrim(F.concat(F.get("pieces", i), F.coalesce(F.get("pieces", i + 1), F.lit("")))), " ")
    blocks = F.filter(F.transform(F.sequence(F.lit(0), F.size("pieces") - 1), block), lambda x: F.arrays_overlap(x, F.lit(rare)))
    per_doc = spaced.select(
        "row",
        "id",
        F.when(F.col("spaced") == " ", 0).otherwise(F.size("words")).cast("long").alias("n_words"),
        F.size(found).cast("long").alias("n_base"),
        F.array_min(found).cast("long").alias("first_word"),
        F.array_max(found).cast("long").alias("last_word"),
        base.alias("base"),
        F.explode_outer(F.when(F.size("pieces") > 0, blocks)).alias("block"),
    )
    # The block's template words by rank; others can't add to what is shared.
    ranked = F.map_from_arrays(F.lit([w for w in rank]), F.lit([rank[w] for w in rank]))
    held = F.array_intersect("block", F.lit(vocabulary))
    held = F.transform(F.array_sort(F.transform(held, lambda w: F.struct(F.element_at(ranked, w).alias("r"), w.alias("w")))), lambda s: s["w"])
    per_doc = per_doc.withColumn("held", F.when(F.col("block").isNotNull(), held))
    fewest = min((p[6] for p in prefixes), default=1)
    prefix = F.slice("held", F.lit(1), F.greatest(F.size("held") - fewest + 1, F.lit(0)))
    probes = per_doc.select("*", F.posexplode_outer(F.when(F.size("held") >= fewest, prefix)).alias("b_at", "word"))
    pairs = probes.join(F.broadcast(template_words), "word", "left")
    possible = (
        (F.size("held") >= F.col("least"))
        & (F.col("b_at") <= F.size("held") - F.col("least"))
        & (1 + F.least(F.col("size") - F.col("at") - 1, F.size("held") - F.col("b_at") - 1) >= F.col("least"))
    )
    # The exact check: runs that start with a word of the template, as the others hold no more.
    starts = F.filter(F.sequence(F.lit(1), F.size("block")), lambda i: F.array_contains("words", F.element_at("block", i)))
    runs = F.transform(starts, lambda i: F.size(F.array_intersect("words", F.slice("block", i, F.col("run")))))
    shared = F.when(possible & (F.size(F.array_intersect("words", "held")) >= F.col("least")), F.array_max(runs))
    share = F.when(shared >= F.col("least"), shared / F.col("size"))
    pairs = pairs.withColumn("share", share)
    keys = ["row", "id", "n_words", "n_base", "first_word", "last_word"]
    merged = pairs.groupBy(*keys).agg(
        F.first("base").alias("base"), F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("more"), F.max("share").alias("share")
    )
    return merged.select(
        F.col("id").alias(id_col),
        *keys[2:],
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
