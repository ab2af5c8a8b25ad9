"""License scans: base phrases and an exact set-similarity join (DataFrame operations only).

A template's blocks are all runs of a text's consecutive words that are a
quarter longer than the template (two words at least), wherever lines break. A
block matches if it holds at least ``threshold`` of the template's distinct
words, so words scattered over a long line match nothing.

Words are ordered by how many texts of the corpus hold them, rarest first. A
block that shares ``c`` words with a template ``T`` has one of them among the
template's first ``|T| - c + 1`` (prefix filter). Texts are therefore looked
through for those words only; around each find at most ``2 |B| - 1`` words can
belong to its blocks. They must hold ``c`` words of the template (length filter),
as many of them no rarer than the find (positional filter). What is left is
decided block by block. The templates are a fixed short list, so their index is
broadcast; texts are never shuffled, only their finds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key
from .words import BETWEEN, lowered, normalised

#: Phrases of words and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Template label and wording.
TEMPLATES = [
    ("agpl-notice", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License"),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("bsd-disclaimer", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2.0", "made available under the terms of the Eclipse Public License v. 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit-disclaimer", "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib-notice", "In no event will the authors be held liable for any damages arising from the use of this software"),
]
THRESHOLD = 0.9


def words_of(wording: str) -> list[str]:
    import re

    return [w for w in re.split(BETWEEN, wording.lower()) if w]


def template_words(wording: str) -> list[str]:
    return sorted(set(words_of(wording)))


def block_size(wording: str) -> int:
    """Words of the blocks that a template is compared with."""
    n = len(words_of(wording))
    return n + max(2, n // 4)


def need(wording: str, threshold: float) -> int:
    """Distinct words of the template that a block must hold."""
    return math.ceil(threshold * len(template_words(wording)) - 1e-9)


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def base_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Row ids with the counts and places of the base phrases."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("_text"), normalised(lowered(F.col(text_col))).alias("s"))
    where = {p: F.locate(f" {p} ", F.col("s")) for p in PHRASES}
    back = {p: F.length("s") - F.locate(f" {p} "[::-1], F.reverse("s")) - len(p) for p in PHRASES}
    n = {p: F.when(where[p] > 0, F.regexp_count("s", F.lit(f" {p}(?= )"))).otherwise(0) for p in PHRASES}
    first = F.least(*[F.when(where[p] > 0, where[p]) for p in PHRASES])
    last = F.greatest(*[F.when(where[p] > 0, back[p]) for p in PHRASES])
    d = d.select(
        "doc_id", "_text", "s", (_spaces(F.col("s")) - 1).cast("long").alias("n_words"), sum(n.values(), F.lit(0)).cast("long").alias("n_base"), first.alias("_first"), last.alias("_last"),
        F.array_compact(F.array(*[F.when(where[p] > 0, F.lit(label)) for p, label in PHRASES.items()])).alias("_base"),
    )
    before = lambda at: _spaces(F.substring("s", F.lit(1), F.col(at) - 1)).cast("long")
    return d.select("doc_id", "_text", "n_words", "n_base", before("_first").alias("first_word"), before("_last").alias("last_word"), "_base")


def template_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, _text, label, containment`` of the best block for each find and template that meet the threshold (repeats included)."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    split = F.split(normalised(lowered(F.col(text_col))), " ")
    held = docs.select(F.explode(F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), split)).alias("t"))
    # one number for each word of the templates, whatever the corpus
    frequency = {r["t"]: r["count"] for r in held.groupBy("t").count().collect()}
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    index = []
    for label, wording in templates:
        ordered = [w for w in order if w in template_words(wording)]
        c = need(wording, threshold)
        index += [(w, i, label, ordered, len(ordered), c, block_size(wording)) for i, w in enumerate(ordered[: len(ordered) - c + 1])]
    firsts = sorted({r[0] for r in index})
    index_df = spark.createDataFrame(index, "token string, i int, label string, t array<string>, nt int, need int, size int")
    least = min(need(t, threshold) for _, t in templates)
    d = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("_text"), split.alias("w"))
    d = d.where((F.size("w") >= least) & F.arrays_overlap("w", F.array(*[F.lit(w) for w in firsts])))
    finds = d.select("doc_id", "_text", "w", F.posexplode("w").alias("at", "token")).where(F.col("token").isin(firsts)).join(F.broadcast(index_df), "token")
    around = finds.select("doc_id", "_text", "label", "i", "token", "t", "nt", "need", "size", F.expr("slice(w, greatest(0, at - size + 1) + 1, size + least(at + 1, size) - 1)").alias("near"))
    both = around.withColumn("both", F.array_intersect("t", "near"))
    kept = both.where((F.size("both") >= F.col("need")) & (1 + F.least(F.col("nt") - 1 - F.col("i"), F.size("both") - F.expr("array_position(both, token)").cast("int")) >= F.col("need")))
    best = F.expr("array_max(transform(sequence(1, greatest(1, size(near) - size + 1)), k -> size(array_intersect(slice(near, k, size), t))))")
    return kept.withColumn("o", best).where(F.col("o") >= F.col("need")).select("doc_id", "_text", "label", (F.col("o") / F.col("nt")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """License digest of every row: words, base places, base labels, all labels and a score.

    The score is 1 if a base phrase occurs, else the largest containment of a
    matched template, else 0. Null texts are empty: no words, no labels. Rows are
    matched by id and text digest, so null and repeated ids keep their own
    result; repeated rows are returned as often as they come. Ties need no order:
    labels are distinct and sorted. Very long texts are searched whole. No rows
    give no rows; extra columns are not read.
    """
    hits = template_matches(docs, id_col, text_col, templates, threshold)
    found = hits.groupBy("doc_id", "_text").agg(F.collect_set("label").alias("_found"), F.max("containment").alias("_score"))
    found = found.select(F.col("doc_id").alias("_id2"), F.col("_text").alias("_text2"), "_found", "_score")
    base = base_columns(docs, id_col, text_col)
    j = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id2")) & (F.col("_text") == F.col("_text2")), "left")
    none = F.array().cast("array<string>")
    join = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(a)))
    return j.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("_base")).alias("base_labels"),
        join(F.concat("_base", F.coalesce("_found", none))).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
