"""License scans: phrases at their word places, and an exact containment join against license templates.

The join is exact.  A block holds at least the share `threshold` of a template's words only if it holds one
of the template's rarest words: with words in order of global frequency, rarest first, at least one of the
first ``size - need + 1``.  Those few words propose pairs; the place of the first shared one and the size of
the block bound what the rest can add; the whole word sets decide."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of ASCII letters and digits and of all non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"

#: Phrases and the labels that they stand for.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short license notices, as published; a label may have several.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
THRESHOLD = 0.8
#: The least words of the overlapping blocks that texts are cut into; twice the longest template's words if that is more.
BLOCK_WORDS = 128


def lower_words(text: str) -> list[str]:
    """The words of a template, A-Z lower-cased, in the order of their first place, each once."""
    return list(dict.fromkeys(w.lower() for w in re.findall(r"[0-9A-Za-z]+", text)))


def templates_frame(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template number, label and distinct words."""
    return spark.createDataFrame([(i, label, lower_words(text)) for i, (label, text) in enumerate(templates)], "template int, label string, words array<string>")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; other characters that `lower` would change are left as they are.

    Texts where `lower` changes no other character, nearly all, take the fast way."""
    a, z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, a, z)).otherwise(F.lower(text))


def _phrase(words: str) -> str:
    inside = GAP.join(words.split())
    return f"(?i)(?<![^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]){inside}(?![^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])"


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def phrase_places(text: Column, phrase: str) -> Column:
    """Word numbers, from 0, at which the phrase's words stand consecutively."""
    pattern, size = _phrase(phrase), len(phrase.split())
    gaps = F.split(text, pattern, -1)
    before = F.slice(gaps, F.lit(1), F.size(gaps) - 1)
    counted = F.transform(before, lambda g: count_words(g).cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("places"))

    def step(state: Column, n: Column) -> Column:
        place = state["at"] + n
        return F.struct((place + size).alias("at"), F.concat(state["places"], F.array(place)).alias("places"))

    rare = max(phrase.split(), key=len)
    return F.when(text.rlike(f"(?i){rare}") & text.rlike(pattern), F.aggregate(counted, zero, step)["places"]).otherwise(F.array().cast("array<bigint>"))


def block_words(templates: list[tuple[str, str]]) -> int:
    """Words of a block, an even number: BLOCK_WORDS or twice the words of the longest template, repeated ones included."""
    return max([BLOCK_WORDS, *(2 * len(re.findall(r"[0-9A-Za-z]+", t)) for _, t in templates)])


def _blocks(words: Column, size: int) -> Column:
    """Distinct words of overlapping blocks of `size` words: every run of half as many words lies in one of them.

    `words` is to be a column that is worked out already, since it is read once for each block."""
    half = size // 2
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - half, F.lit(1)), F.lit(half))
    return F.transform(starts, lambda s: F.array_distinct(F.slice(words, s, size)))


def word_frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> DataFrame:
    """word, n: in how many texts each word of the vocabulary stands, over all texts (0 where in none)."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    hit = docs.select(F.explode(F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary]))).alias("word"))
    every = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    return every.join(hit.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def containment_join(blocks: DataFrame, templates: DataFrame, ranks: dict[str, int], threshold: float, keys: list[str]) -> DataFrame:
    """keys, template, label, share of every block (keys, words) and template whose share of contained words reaches the threshold."""
    order = F.create_map(*[F.lit(x) for pair in sorted(ranks.items()) for x in pair])

    def ordered(words: Column) -> Column:
        return F.transform(F.array_sort(F.transform(words, lambda w: F.struct(order[w].alias("r"), w.alias("w")))), lambda s: s["w"])

    sorted_templates = templates.select("template", "label", ordered(F.col("words")).alias("t_words")).withColumn("need", F.ceil(F.size("t_words") * F.lit(threshold) - 1e-9).cast("int"))
    prefix = sorted_templates.select("*", F.posexplode(F.slice("t_words", F.lit(1), F.size("t_words") - F.col("need") + 1)).alias("t_at", "word"))
    known = F.array(*[F.lit(w) for w in sorted(ranks)])
    own = blocks.withColumn("b_words", ordered(F.array_intersect("words", known))).filter(F.size("b_words") > 0)
    proposed = own.select(*keys, "b_words", F.posexplode("b_words").alias("b_at", "word")).join(F.broadcast(prefix), "word")  # a few words for each template
    # Length: no block of fewer words; position: what is left on either side from here on.
    possible = proposed.filter(
        (F.size("b_words") >= F.col("need")) & (F.least(F.size("b_words") - F.col("b_at"), F.size("t_words") - F.col("t_at")) >= F.col("need") - F.least("b_at", "t_at"))
    )
    shared = F.size(F.array_intersect("b_words", "t_words"))
    return possible.withColumn("shared", shared).filter(F.col("shared") >= F.col("need")).select(*keys, "template", "label", (F.col("shared") / F.size("t_words")).alias("share")).distinct()


def scan_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, by_line: bool = True) -> DataFrame:
    """`key`, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Phrases give base labels with the number, least and greatest of their places; blocks that contain a
    template to the threshold add its label; score is the greatest share of a template or 1 for a phrase.
    With `by_line` False blocks are cut over the words of the whole text, so a notice may be wrapped over any
    number of lines; with `by_line` a notice counts only where it stands on one line.
    A null text counts as empty: no words, null places, empty lists, score 0.  Repeated rows and null keys
    give a row each; other columns are not read; no rows give no rows."""
    spark = docs.sparkSession
    known = TEMPLATES if templates is None else templates
    body = F.coalesce(F.col(text), F.lit(""))
    vocabulary = sorted({w for _, t in known for w in lower_words(t)})
    counts = {r["word"]: r["n"] for r in word_frequencies(docs, text, vocabulary).collect()}  # one row per template word
    ranks = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    frame = templates_frame(spark, known)

    # A text can only hold a block for a template if it holds one of the template's rarest words.
    sets = [sorted(lower_words(t), key=ranks.__getitem__) for _, t in known]
    rare = sorted({w for s in sets for w in s[: len(s) - math.ceil(len(s) * threshold - 1e-9) + 1]})
    hopeful = body.rlike("(?i)(?<![0-9a-z])(?:" + "|".join(rare) + ")(?![0-9a-z])") if rare else F.lit(False)
    identity = [F.col(key).alias("_key"), F.xxhash64(body).alias("_h")]
    texts = docs.filter(hopeful).select(*identity, body.alias("_text")).distinct()
    if by_line:
        texts = texts.select("_key", "_h", F.explode(F.split("_text", "\n")).alias("_text"))
    worded = texts.select("_key", "_h", F.regexp_extract_all(ascii_lower(F.col("_text")), F.lit(WORD), F.lit(0)).alias("_words"))
    cut = worded.select("_key", "_h", F.explode(_blocks(F.col("_words"), block_words(known))).alias("words"))
    found = containment_join(cut, frame, ranks, threshold, ["_key", "_h"])
    extra = found.groupBy("_key", "_h").agg(F.collect_set("label").alias("_labels"), F.max("share").alias("_share"))  # at most one entry per label

    places = {label: phrase_places(body, phrase) for phrase, label in PHRASES.items()}
    base = docs.select(F.col(key), *identity, count_words(body).cast("long").alias("n_words"), *[c.alias(f"_p_{i}") for i, c in enumerate(places.values())])
    every = F.concat(*[F.col(f"_p_{i}") for i in range(len(places))])
    own = F.filter(F.array(*[F.when(F.size(f"_p_{i}") > 0, F.lit(label)) for i, label in enumerate(places)]), lambda x: x.isNotNull())
    joined = base.join(extra.withColumnRenamed("_key", "_k").withColumnRenamed("_h", "_g"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_g")), "left")
    return joined.select(
        key, "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("_labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(own) > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
