"""License notices in texts by diagonal voting, in DataFrame functions only.

Words are lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII. Every rolling word
k-gram of a document (k of SIZES) is joined by its hash with the places it has in the templates, and its words
are compared. A hit at word ``pos`` of the document and ``tpos`` of the template votes for the diagonal
``pos - tpos``; votes are counted per document, template and diagonal. Neighbouring diagonals of a template
merge (``shift`` words apart at most: inserted or lost words move the rest), and a merged span is verified by
the share of the template's k-grams it holds: all of them for phrases (``cover`` 1, ``shift`` 0), COVER for notices.

The join happens inside the scan: templates are a short table of measured size (a larger one than Spark's
bound here raises ValueError), so no k-gram without a hit is ever shuffled. Documents meet again by
(doc_id, two hashes of the text) after that, one marker row each and their few hits.

Cases: a null text is an empty one; documents without words or hits have 0 places, empty labels and score 0.
Repeated rows are each returned; rows of one id with different texts are different documents; null ids are
ordinary ones. A template of fewer than two words finds nothing. Ties between spans do not matter: labels are
sets, and score is the best share. Long texts are split whole; the words of one text must fit into a task. Only
doc_id and text are read, so other columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripletide.llm.tables import listed
from tripletide.scratch import BROADCAST_BYTES, store

# What stands between words; splitting there takes half the time of matching the words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZES = (2, 4)
COVER = 0.5
SHIFT = 4

# Phrases that name a license, and their labels.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Further phrases and the public standard notices, and their labels.
PHRASES = [
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by", "creative commons attribution"),
    ("cc0", "creative commons zero"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "mozilla public license"),
    ("bsd", "bsd license"),
    ("isc", "isc license"),
]
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, text, cover, shift): the built-in phrases and notices."""
    rows = [(label, True, text, 1.0, 0) for label, text in BASE] + [(label, False, text, 1.0, 0) for label, text in PHRASES]
    rows += [(label, False, text, COVER, SHIFT) for label, text in NOTICES]
    return listed(
        spark, [(i, *r) for i, r in enumerate(rows)],
        "template int, label string, base boolean, text string, cover double, shift int",
    )


def _words(text: Column) -> Column:
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BETWEEN), "")


def _rolled(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., pos, k, w, hash): a row per word of the column ``words`` and size, ``w`` that word and those after
    it, and one of size 0 per row of ``df``. Everything after the lists is one piece of generated code."""
    words, n = F.col("words"), F.size("words")
    zipped = df.select(*keep, F.arrays_zip(*[F.slice(words, i + 1, n).alias(f"w{i}") for i in range(max(SIZES))]).alias("zipped"))
    # The outer form keeps rows without words, and Spark from filtering by the list's size, which would split texts twice.
    rows = zipped.select(*keep, F.posexplode_outer("zipped").alias("pos", "z"))
    w = [F.col(f"z.w{i}") for i in range(max(SIZES))]
    sizes = F.array(
        F.struct(F.lit(0).alias("k"), F.lit(None).cast("bigint").alias("hash")),
        *[F.struct(F.lit(k).alias("k"), F.xxhash64(*w[:k]).alias("hash")) for k in SIZES],
    )
    each = rows.select(*keep, "pos", F.array(*w).alias("w"), F.inline(sizes))
    return each.filter(F.when(F.col("k") == 0, F.coalesce("pos", F.lit(0)) == 0).otherwise(F.col("pos").isNotNull()))


def _places(listed_templates: DataFrame) -> DataFrame:
    """(hash, template, tpos, gram) of every k-gram of every template, k the largest of SIZES that fits."""
    about = ["template", "label", "base", "cover", "shift", "n"]
    split = listed_templates.select(*about[:-1], _words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    wanted = F.lit(None).cast("int")
    for size in SIZES:
        wanted = F.when(F.col("n") >= size, size).otherwise(wanted)
    placed = _rolled(split, about).filter(F.col("k") == wanted).filter("pos + k <= n")
    return placed.select(
        "hash", *about[:-1], "k", (F.col("n") - F.col("k") + 1).alias("n_grams"), F.col("pos").alias("tpos"),
        F.slice("w", F.lit(1), F.col("k")).alias("gram"),
    )


ROW = ("doc_id", "mark", "n_words")


def _hits(docs: DataFrame, places: DataFrame) -> DataFrame:
    """A marker row (template null) per document row, and a row per k-gram that stands in a template."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id", F.struct(F.xxhash64(text).alias("h"), F.hash(text).alias("g")).alias("mark"), _words(text).alias("words")
    ).withColumn("n_words", F.size("words"))
    met = _rolled(split, list(ROW)).join(F.broadcast(places.withColumnRenamed("k", "gram_k")), "hash", "left")
    same = (F.col("k") == F.col("gram_k")) & (F.slice("w", F.lit(1), F.col("k")) == F.col("gram"))
    return met.filter((F.col("k") == 0) | F.coalesce(same, F.lit(False))).select(
        *ROW, "template", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos"
    )


def _spans(docs: DataFrame, listed_templates: DataFrame) -> DataFrame:
    """(doc_id, mark, n_words, copies, spans): per document its rows and its spans, verified or not."""
    stored = store(_places(listed_templates), "license-places")
    if stored.bytes > BROADCAST_BYTES:
        raise ValueError(f"templates take {stored.bytes} bytes; at most {BROADCAST_BYTES} can be joined inside the scan")
    voted = _hits(docs, stored.df).groupBy(*ROW, "template", "diagonal").agg(
        F.count(F.lit(1)).alias("copies"), F.array_sort(F.collect_set("tpos")).alias("seen")
    )
    # One row per template.
    kinds = stored.df.select("template", "label", "base", "cover", "shift", "k", "n_grams").distinct()
    known = voted.join(F.broadcast(kinds), "template", "left")
    along = Window.partitionBy(*ROW, "template").orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("shift"), F.lit(True))
    merged = known.withColumn("opens", opens).withColumn(
        "island", F.sum(F.col("opens").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    spans = merged.groupBy(*ROW, "template", "island").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("cover").alias("cover"),
        F.when(F.first("template").isNull(), F.max("copies")).alias("copies"),
        F.min(F.col("diagonal") + F.get("seen", F.lit(0))).alias("first_word"),
        F.max(F.col("diagonal") + F.array_max("seen") + F.col("k") - 1).alias("last_word"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("seen")))) / F.first("n_grams")).alias("share"),
    )
    return spans.withColumn("verified", F.col("share") >= F.col("cover"))


def license_spans(docs: DataFrame, listed_templates: DataFrame | None = None) -> DataFrame:
    """(doc_id, label, first_word, last_word, share): every verified span, once per row of ``docs``."""
    spans = _spans(docs, templates(docs.sparkSession) if listed_templates is None else listed_templates)
    copies = F.max("copies").over(Window.partitionBy(*ROW)).alias("copies")
    found = spans.select("*", copies.alias("rows")).filter("verified")
    return found.select(
        "doc_id", "label", "first_word", "last_word", "share", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows")).alias("_row")
    ).drop("_row")


def license_labels(docs: DataFrame, listed_templates: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, places of base phrases, their outermost starts, labels and score."""
    spans = _spans(docs, templates(docs.sparkSession) if listed_templates is None else listed_templates)
    base = F.col("verified") & F.col("base")

    def names(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    found = spans.groupBy(*ROW).agg(
        F.max("copies").alias("copies"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("bigint").alias("last_word"),
        names(base).alias("base_labels"), names(F.col("verified")).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return found.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels",
        "score", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_row"),
    ).drop("_row")
