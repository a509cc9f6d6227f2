"""License notices in documents, by an exact set-similarity join. DataFrame operations only.

Templates and blocks of words are sets of tokens, ordered by how many documents have a token, the
rarest first. A block that holds the share THRESHOLD of a template's tokens has at least one of the
template's first few (the prefix): those tokens' postings give the candidates. Candidates that are too
short (length), or whose order shows that too few tokens can still be shared (position), go; of the
others the shared tokens are counted.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrove.llm.store import NO_ID, keyed, named, stored

#: Fixed value: what a word is made of, before A-Z are lowered.
WORD = r"[a-z0-9A-Z\x80-\x{10FFFF}]+"
#: Phrases that give a label wherever their words stand one after the other.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
THRESHOLD = 0.9
#: Common notices and statements (label, text), as publicly known.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc0", "the person has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
)


def templates(spark: SparkSession, listed: tuple = TEMPLATES) -> DataFrame:
    """(template, label, text) of pairs (label, text)."""
    return spark.createDataFrame([(k, *t) for k, t in enumerate(listed)], "template int, label string, text string")


def words(text: Column | str) -> Column:
    """The words of a text, A-Z lowered."""
    own = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_extract_all(F.translate(own, string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def needed(listed: DataFrame, threshold: float) -> DataFrame:
    """(template, label, token, size, span, need) of templates: their distinct tokens, words, and how many tokens a block must hold."""
    cut = listed.select("template", "label", words("text").alias("w")).where(F.size("w") > 0)
    size = F.size(F.array_distinct("w"))
    return cut.select("template", "label", size.alias("size"), F.size("w").alias("span"), F.ceil(size * F.lit(threshold) - 1e-9).cast("int").alias("need"), F.explode(F.array_distinct("w")).alias("token"))


def ordered(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with `rank`: a token's place among all templates' tokens, those of the fewest documents first; and `nth`, that in its template."""
    tokens = wanted.select("token").distinct()
    known = F.array(*(F.lit(r.token) for r in tokens.orderBy("token").collect()))  # as many as templates have
    often = docs.select(F.explode(F.array_intersect(words("text"), known)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("docs"))
    placed = tokens.join(often, "token", "left").withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce("docs", F.lit(0)), "token")))
    return wanted.join(placed.select("token", "rank"), "token").withColumn("nth", F.row_number().over(Window.partitionBy("template").orderBy("rank")))


def postings(docs: DataFrame, ranked: list, phrases: dict[str, str]) -> DataFrame:
    """(doc_id, h1, h2, n_words, pos, token) of documents that may hold a template or a phrase: their words that those have.

    Every document has a row in any case: its first word's, or the one without words (`head`).
    """
    prefix = sorted({r.token for r in ranked if r.nth <= r.size - r.need + 1})
    known = sorted({r.token for r in ranked} | {x for p in phrases for x in p.split()})
    listed = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    cut = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), words("text").alias("w"))
    may = F.arrays_overlap("w", listed(prefix))
    for p in phrases:
        may = may | F.forall(F.array(*map(F.lit, p.split())), lambda x: F.array_contains("w", x))
    # Where nothing can be found, one word is enough to keep the row.
    own = F.when(may, F.col("w")).otherwise(F.slice("w", 1, 1))
    rows = cut.select("doc_id", "h1", "h2", F.size("w").alias("n_words"), F.posexplode_outer(own).alias("pos", "token"))
    token = F.when(F.col("token").isin(known), F.col("token"))
    head = F.coalesce(F.col("pos") == 0, F.lit(True))
    return rows.select("doc_id", "h1", "h2", "n_words", "pos", token.alias("token"), head.alias("head")).where(F.col("head") | F.col("token").isNotNull())


KEY = ["doc_id", "h1", "h2"]


def blocks_found(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, template, block, share) of all blocks that hold the needed share of a template's tokens.

    For a template of s words, block k is the words k * s to k * s + 2 * s - 1: whatever stretch of up
    to s + 1 words a notice fills, a block holds it. Documents of equal id and text count once.
    """
    lists = placed.where("token is not null").select(*KEY, "n_words", "pos", "token").join(wanted.select("token", "rank").distinct(), "token")
    span, keys = F.col("span"), [*KEY, "template", "block"]
    at = F.floor(F.col("pos") / span).cast("int")
    within = lambda met: met.select("*", F.explode(F.filter(F.array(at, at - 1), lambda k: k >= 0)).alias("block"))
    prefix = wanted.where(F.col("nth") <= F.col("size") - F.col("need") + 1).select("template", "rank", "span", "need")
    long_enough = F.least(2 * span, F.col("n_words") - F.col("block") * span) >= F.col("need")
    candidates = stored(within(lists.join(prefix, "rank")).where(long_enough).groupBy(keys).agg(F.min("rank").alias("first")), "candidates")
    own = wanted.groupBy("template").agg(F.first("size").alias("size"), F.first("span").alias("span"), F.first("need").alias("need"), F.collect_set("rank").alias("ranks"))
    asked = candidates.select(*KEY, "template").distinct().join(own.select("template", "span"), "template")
    records = within(lists.select(*KEY, "pos", "rank").join(asked, KEY)).join(candidates, keys).groupBy(keys).agg(F.collect_set("rank").alias("record"), F.first("first").alias("first"))
    met = records.join(own, "template")
    # A block's tokens that come before the first shared one in the order are none of the template's.
    left = F.size(F.filter("record", lambda x: x >= F.col("first")))
    shared = F.size(F.array_intersect("record", "ranks"))
    return met.where((left >= F.col("need")) & (shared >= F.col("need"))).select(*keys, (shared / F.col("size")).alias("share"))


def phrase_places(placed: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """(doc, label, start): where a phrase's words stand one after the other, each place once."""
    spark = placed.sparkSession
    rows = [(k, label, off, x, len(p.split())) for k, (p, label) in enumerate(phrases.items()) for off, x in enumerate(p.split())]
    wanted = spark.createDataFrame(rows, "phrase int, label string, off int, token string, size int")
    met = placed.where("token is not null").select(*KEY, "pos", "token").join(F.broadcast(wanted), "token")  # as many rows as phrases have words
    starts = met.groupBy(*KEY, "phrase", "label", (F.col("pos") - F.col("off")).alias("start"), "size").agg(F.collect_set("off").alias("offs"))
    return starts.where("size(offs) = size").select(*KEY, "label", "start")


def scan(docs: DataFrame, listed: DataFrame | None = None, threshold: float = THRESHOLD, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base, first_word, last_word and base_labels are about the phrases; labels also has those of the
    templates (listed(template, label, text)) that a block of the text holds to the threshold. The score
    is the greatest share that a block has of a template, 1 where a phrase stands. Null and empty texts
    have no words, no labels and score 0; repeated rows get a row each; an empty table gives no rows,
    and without templates only phrases count; other columns are not looked at.
    """
    phrases = PHRASES if phrases is None else phrases
    wanted = stored(ordered(docs, needed(templates(docs.sparkSession) if listed is None else listed, threshold)), "ordered")
    placed = stored(postings(keyed(docs), wanted.collect(), phrases), "postings")  # templates are few: a row for each of their tokens
    base = phrase_places(placed, phrases).groupBy(KEY).agg(F.count(F.lit(1)).alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"), F.collect_set("label").alias("base"))
    of_template = wanted.select("template", "label").distinct()
    found = blocks_found(placed, wanted).join(of_template, "template").groupBy(KEY).agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    both = stored(base.join(found, KEY, "full_outer"), "labelled")
    met = placed.where("head").select(*KEY, "n_words").join(both, KEY, "left")
    none = F.array().cast("array<string>")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    own, base_labels = F.coalesce("own", none), F.coalesce("base", none)
    return named(met).select(
        "doc_id", F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.array_union(base_labels, own)).alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
