"""License notices: phrases, and an exact set-similarity join with templates, in SQL functions alone.

Blocks are the lines of a text, sets of lower-cased words. A template is found in
a block that holds at least `CONTAINED` percent of the template's words. All
words of templates are put in one order by how often they occur in the whole
corpus, the rarest first. Then
- prefix: a block that holds `need` of a template's n words has one of the
  template's first n - need + 1, so only these words are joined on;
- length: a block with fewer than `need` words of any template is out;
- position: after the first shared word, template and block must both have words
  enough left;
and what remains is verified on the whole sets. No block that meets the
threshold is missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINED = 90  # percent

# Phrases of the base search and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Sentences of public licenses and of usual notices.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words, after lower-casing
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing
_KEY = ["doc_id", "text_hash", "length"]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _APART), lambda w: w != "")


def _need(size: int) -> int:
    return -(-size * CONTAINED // 100)


def _phrase_count(lower: Column, phrase: str) -> Column:
    """Places of a phrase; the plain search for its last word comes first, as most texts lack it."""
    own = phrase.split()
    pattern = rf"(?<![0-9a-z\x{{80}}-\x{{10FFFF}}]){_APART.join(own)}(?![0-9a-z\x{{80}}-\x{{10FFFF}}])"
    return F.when(lower.contains(own[-1]) & lower.contains(own[0]), F.regexp_count(lower, F.lit(pattern))).otherwise(0).cast("long")


def _starts(words: Column, phrase: str) -> Column:
    own = phrase.split()

    def here(word: Column, at: Column) -> Column:
        later = [F.get(words, at + k) == w for k, w in enumerate(own) if k]
        return F.when(reduce(Column.__and__, later, word == own[0]), at)

    return F.filter(F.transform(words, here), lambda at: at.isNotNull())


def word_frequencies(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of a fixed vocabulary occurs in a column `text`."""
    each = texts.select(F.explode(F.split(F.lower("text"), _APART)).alias("word"))
    counts = each.where(F.col("word").isin(vocabulary)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}  # at most one row per word of the templates


def blocks_with_templates(texts: DataFrame, key: list[str]) -> DataFrame:
    """key, line, label, template and contained (0 to 1) of every block that meets the threshold."""
    vocabulary = sorted({w for _, t in TEMPLATES for w in t.split()})
    often = word_frequencies(texts, vocabulary)
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    entries = []
    for number, (label, text) in enumerate(TEMPLATES):
        own = sorted(set(text.split()), key=place.get)
        for i, word in enumerate(own[: len(own) - _need(len(own)) + 1]):
            entries.append((word, number, label, i, len(own), _need(len(own)), own))
    names = ("word", "template", "label", "i", "size", "need")
    index = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, e, strict=False)], F.array(*[F.lit(w) for w in e[6]]).alias("own")) for e in entries]
    spark = texts.sparkSession
    prefixes = F.broadcast(spark.range(1).select(F.inline(F.array(*index))))  # fixed by TEMPLATES

    lines = texts.select(*key, F.posexplode(F.split(F.lower("text"), "\n")).alias("line", "block"))
    # A block without any prefix word cannot join; words are only taken from the others.
    some = reduce(Column.__or__, [F.col("block").contains(w) for w in dict.fromkeys(e[0] for e in entries)])
    known = F.array_intersect(F.array(*[F.lit(w) for w in order]), F.split("block", _APART))
    blocks = lines.where(some).select(*key, "line", known.alias("known"))
    tokens = blocks.select(*key, "line", "known", F.posexplode("known").alias("j", "word"))
    left = 1 + F.least(F.col("size") - F.col("i") - 1, F.size("known") - F.col("j") - 1)
    fits = tokens.join(prefixes, "word").where((F.size("known") >= F.col("need")) & (left >= F.col("need")))
    common = F.size(F.array_intersect("known", "own"))
    met = fits.withColumn("contained", common / F.col("size")).where(common >= F.col("need"))
    # A notice is not also the shorter one whose words it happens to hold.
    sets = [set(text.split()) for _, text in TEMPLATES]
    wider = F.array(*[F.array(*[F.lit(k) for k, other in enumerate(sets) if own < other]).cast("array<int>") for own in sets])
    here = met.groupBy(*key, "line").agg(F.collect_set(F.struct("template", "label", "contained")).alias("found"))
    numbers = F.transform("found", lambda t: t["template"])
    alone = F.filter("found", lambda t: ~F.arrays_overlap(F.get(wider, t["template"]), numbers))
    return here.select(*key, "line", F.inline(alone))


def license_scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the best containment found, 1 where a phrase stands. A null or
    empty text has no words and no labels. Null ids and repeated rows are rows
    like any other: what the join finds is kept by id and text, not by row.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = documents.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    keyed = texts.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.octet_length("text").alias("length"))
    found = blocks_with_templates(keyed, _KEY).groupBy(*_KEY).agg(F.collect_set("label").alias("found"), F.max("contained").alias("best"))

    lower = F.lower("text")
    counts = [_phrase_count(lower, phrase) for phrase, _ in PHRASES]
    base = keyed.select(*_KEY, F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"), F.array(*counts).alias("counts"), lower.alias("lower"))
    n_base = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    words = _words(F.col("lower"))
    starts = F.when(n_base > 0, F.flatten(F.array(*[_starts(words, phrase) for phrase, _ in PHRASES])))
    base_set = F.array_compact(F.array(*[F.when(F.col("counts")[k] > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    base = base.select(*_KEY, "n_words", n_base.alias("n_base"), starts.alias("starts"), base_set.alias("base_set"))
    r, f = base.alias("r"), found.alias("f")
    rows = r.join(f, reduce(Column.__and__, [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in _KEY]), "left")
    both = F.array_union("base_set", F.coalesce("found", F.array().cast("array<string>")))
    return rows.select(
        "r.doc_id",
        "n_words",
        "n_base",
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.sort_array("base_set"), ",").alias("base_labels"),
        F.array_join(F.sort_array(both), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
