"""License texts by diagonal voting, in DataFrame operations only.

Every text is cut into words and every pair of neighbouring words becomes a row. The rows
join the gram table of the templates by hash (the words themselves are compared as well,
so a hash collision is no hit). A hit at word ``pos`` on template position ``tpos`` votes
for the diagonal ``pos - tpos``. Votes are bit masks of template positions, joined by OR:
map tasks combine them, and repeated rows do not count twice. A diagonal that covers
enough of its template is verified by itself. Neighbouring diagonals of one template
otherwise merge, which bridges dropped and inserted words, and a merged span is verified
by the part of the template that it covers and by its length.

Phrases of two words up are templates too. A phrase stands at a place exactly when its
mask is full on a single diagonal, so the base counts come from the same votes.
The template table is broadcast: it comes from the caller's word lists, not from the data,
and ``grams`` refuses more than ``MOST_GRAMS`` rows, which is a few megabytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinefield.llm.common import whole_text

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 2
SLACK = 3
COVER = 0.7
STRETCH = 1.5
MOST_GRAMS = 50_000
UNIT = 1 << 20

#: The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Opening sentences of public licenses, at most 60 words each.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved", "all-rights-reserved"),
)


def grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """``(template, label, is_base, n_grams, tpos, bit, t0, t1)``: one row per word pair of a template."""
    rows = []
    for number, (text, label) in enumerate([*phrases, *templates]):
        words = text.split()
        if not GRAM <= len(words) <= 63:
            raise ValueError(f"a template has 2 to 63 words: {text!r}")
        rows += [(number, label, number < len(phrases), len(words) - 1, k, 1 << k, words[k], words[k + 1]) for k in range(len(words) - 1)]
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"more than {MOST_GRAMS} template positions")
    return spark.createDataFrame(rows, "template int, label string, is_base boolean, n_grams int, tpos int, bit long, t0 string, t1 string")


def _words(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and its words. A-Z is lowered; the two other letters whose lower case is ASCII cannot match."""
    folded = F.lower(F.replace(F.replace(whole_text(), F.lit("K"), F.lit("µ")), F.lit("İ"), F.lit("µ")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("_text"),
                       F.filter(F.split(folded, GAP), lambda w: w != "").alias("_w"))


def votes(docs: DataFrame, table: DataFrame) -> DataFrame:
    """One row per document, template and diagonal, with the mask of template positions that voted."""
    pairs = (_words(docs).select("doc_id", "_text", F.posexplode(F.arrays_zip(F.col("_w").alias("w0"), F.slice("_w", 2, F.size("_w")).alias("w1"))))
             .select("doc_id", "_text", "pos", F.col("col")["w0"].alias("w0"), F.col("col")["w1"].alias("w1"))
             .withColumn("_h", F.xxhash64("w0", "w1")))
    hashed = table.withColumn("_th", F.xxhash64("t0", "t1"))
    hits = pairs.join(F.broadcast(hashed), (F.col("_h") == F.col("_th")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")))
    return (hits.withColumn("diagonal", F.col("pos") - F.col("tpos"))
            .groupBy("doc_id", "_text", "template", "label", "is_base", "n_grams", "diagonal")
            .agg(F.bit_or("bit").alias("mask"), F.min("pos").alias("first"), F.max("pos").alias("last")))


def spans(voted: DataFrame) -> DataFrame:
    """Merged neighbouring diagonals: doc_id, label, is_base, first, last (words, inclusive), cover, verified.

    A phrase's span is one full diagonal. Any other template's span is verified if it covers
    ``COVER`` of the template within ``STRETCH`` times its length. A diagonal that does so by
    itself is a span of its own; the others merge with those of them at most ``SLACK`` apart,
    and at most as many words as the template's length leaves to be stretched. A chain of
    them may be long: it is also verified where diagonals within that stretch cover enough.
    """
    key = ["doc_id", "_text", "template"]
    alone = (F.bit_count("mask") / F.col("n_grams") >= COVER) & (F.col("last") - F.col("first") + 2 <= STRETCH * (F.col("n_grams") + 1))
    voted = voted.withColumn("_alone", F.col("is_base") | alone)
    order = Window.partitionBy(*key, "_alone").orderBy("diagonal")
    room = F.floor((STRETCH - 1) * (F.col("n_grams") + 1))
    slack = F.least(F.lit(SLACK), room)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True))
    marked = voted.withColumn("_new", (F.col("_alone") | apart).cast("int")).withColumn("_span", F.sum("_new").over(order))
    # Diagonals are above -64; a template's room becomes UNIT, so that one frame serves all templates.
    place = F.floor((F.col("diagonal").cast("long") + 64) * UNIT / room)
    near = Window.partitionBy(*key, "_alone", "_span").orderBy(place).rangeBetween(0, UNIT)
    marked = marked.withColumn("_near", F.bit_count(F.bit_or("mask").over(near)) / F.col("n_grams"))
    merged = (marked.groupBy(*key, "label", "is_base", "n_grams", "_alone", "_span")
              .agg(F.bit_or("mask").alias("mask"), F.min("first").alias("first"), (F.max("last") + 1).alias("last"), F.max("_near").alias("_near")))
    cover = F.bit_count("mask") / F.col("n_grams")
    full = F.bit_count("mask") == F.col("n_grams")
    fits = (F.col("_near") >= COVER) | ((cover >= COVER) & (F.col("last") - F.col("first") + 1 <= STRETCH * (F.col("n_grams") + 1)))
    return merged.withColumn("cover", cover).withColumn("verified", F.when(F.col("is_base"), full).otherwise(fits))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null counts as empty: no words, no labels, null places, score 0. The score is the
    largest part of a template that a span covers. Rows that repeat id and text get the
    same result each; other columns are not looked at; an empty table gives no rows.
    """
    found = spans(votes(docs, grams(docs.sparkSession, phrases, templates)))
    base = F.col("verified") & F.col("is_base")
    summed = found.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_key")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("verified"), F.col("label")))), ",").alias("labels"), F.max("cover").alias("score"))
    listed = _words(docs).select("doc_id", "_text", F.size("_w").cast("long").alias("n_words"))
    joined = listed.join(summed, listed["doc_id"].eqNullSafe(F.col("_id")) & (listed["_text"] == F.col("_key")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                         F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                         F.coalesce(F.round("score", 6), F.lit(0.0)).alias("score"))
