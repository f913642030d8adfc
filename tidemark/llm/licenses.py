"""License texts by diagonal voting: DataFrame functions only.

Every run of two words of every document is hashed and joined to the positions of the same run in the templates (a fixed
list of texts; it is broadcast). A hit votes for the diagonal document position - template position. Votes of a diagonal
are a bit per template position, so repeated rows change nothing. Diagonals of a template that lie within ``DRIFT`` words
of each other are merged, for words may be put in or left out; a merged span is verified when it covers ``COVERAGE`` of
the template's runs within at most twice its length. A phrase stands where all its runs fall on one diagonal.

Null text counts as empty: no words, no labels, score 0. Repeated rows are each answered. Empty tables give empty
results. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import LOWER, NOT_WORD, UPPER, bound, table

DRIFT = 3
COVERAGE = 0.7

# Phrases with their labels, then the openings of public licence notices (at most 64 words each).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
              "with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
           "public license as published by the free software foundation either version",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
           "the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
LAST = 2 ** 63 - 7  # stands for the end of a document, so that each document has a row


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, NOT_WORD, -1), "")


def runs(of: Column) -> Column:
    """Hashes of all runs of two words, by the place of the first."""
    n = F.size(of)
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(
        F.zip_with(F.slice(of, F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(of, F.lit(2), F.greatest(n - 1, F.lit(1))),
                   lambda a, b: F.xxhash64(a, b)))


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """hash, place, template, label, phrase, n_runs."""
    rows = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate(
        [*phrases.items(), *((t, l) for l, t in notices.items())])]
    texts = spark.range(1).select(F.inline(F.array(*(F.struct(
        F.lit(i).alias("template"), F.lit(text).alias("body"), F.lit(label).alias("label"), F.lit(phrase).alias("phrase"))
        for i, text, label, phrase in rows))))
    own = texts.select("template", "label", "phrase", runs(words(F.col("body"))).alias("h"))
    table_ = own.select("template", "label", "phrase", F.size("h").alias("n_runs"), F.posexplode("h").alias("place", "hash"))
    end = spark.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("phrase"),
                                F.lit(0).alias("n_runs"), F.lit(0).alias("place"), F.lit(LAST).cast("long").alias("hash"))
    return table_.unionByName(end)


def diagonals(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """The diagonals of each document (doc_id, text hash) with votes, and one row of template -1 that counts equal rows."""
    def rows_of(w: Column) -> Column:
        facts = F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.size(w).cast("long").alias("n_words"))
        return bound(facts, lambda f: F.transform(F.concat(runs(w), F.array(F.lit(LAST).cast("long"))), lambda x, i: F.struct(
            f["text_hash"].alias("text_hash"), f["n_words"].alias("n_words"), i.alias("pos"), x.alias("hash"))))

    # Facts of a document travel in its array: beside an explode they would be computed again for each of its rows.
    every = docs.select("doc_id", F.inline(bound(words(F.col("text")), rows_of)))
    hits = every.join(F.broadcast(templates(docs.sparkSession, phrases, notices)), "hash")
    at = F.when(F.col("template") < 0, F.lit(0)).otherwise(F.col("pos") - F.col("place"))
    return (hits.groupBy("doc_id", "text_hash", "n_words", "template", "label", "phrase", "n_runs", at.alias("diagonal"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))).alias("votes"),
                 F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("rows")))


def merged(votes: DataFrame) -> DataFrame:
    """Diagonals of one template and document, numbered (``island``) so that neighbours within ``DRIFT`` share a number.

    Only diagonals of several votes are neighbours of each other (``strong``).
    """
    along = Window.partitionBy("doc_id", "text_hash", "template", "strong").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT
    return (votes.withColumn("strong", F.bit_count("votes") > 1).withColumn("_apart", F.coalesce(apart, F.lit(False)).cast("int"))
            .withColumn("island", F.sum("_apart").over(along)).drop("_apart"))


def licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES,
             coverage: float = COVERAGE) -> DataFrame:
    """Per row of ``docs``: n_words, n_base, first_word, last_word, base_labels, labels, score, spans (verified notices)."""
    # All rows of a document in one place: the steps below need no further shuffle, and sort instead of growing arrays.
    votes = diagonals(docs, phrases, notices).repartition("doc_id", "text_hash")
    document = ["doc_id", "text_hash", "n_words"]
    is_end, whole = F.col("template") < 0, F.col("phrase") & (F.bit_count("votes") == F.col("n_runs"))
    start = F.when(whole, F.col("diagonal").cast("long"))
    notice = ~is_end & ~F.col("phrase") & F.col("strong")
    islands = merged(votes).groupBy(*document, "template", "label", "n_runs", F.when(notice, F.col("island")).alias("island")).agg(
        F.sum(F.when(is_end, F.col("rows"))).alias("copies"), F.count(start).alias("places"), F.min(start).alias("first_word"),
        F.max(start).alias("last_word"), F.bit_or(F.when(notice, F.col("votes"))).alias("votes"),
        F.min(F.when(notice, F.col("low"))).alias("low"), F.max(F.when(notice, F.col("high"))).alias("high"))
    share = F.bit_count("votes") / F.col("n_runs")
    verified = (share >= coverage) & (F.col("high") - F.col("low") <= 2 * F.col("n_runs"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    based = F.col("places") > 0
    found = islands.groupBy(*document).agg(
        F.sum("copies").alias("copies"), F.sum("places").alias("n_base"), F.min("first_word").alias("first_word"),
        F.max("last_word").alias("last_word"), joined(based).alias("base_labels"), joined(based | verified).alias("labels"),
        F.when(F.sum("places") > 0, F.lit(1.0)).otherwise(F.least(F.coalesce(F.max(share), F.lit(0.0)), F.lit(1.0))).alias("score"),
        F.array_sort(F.collect_list(F.when(verified, F.struct("template", "low", "label", "high")))).alias("spans"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.transform("spans", lambda d: F.struct(d["label"], d["low"].alias("first"), (d["high"] + 2).alias("end"))).alias("spans"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).drop("_copy")


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses(table(spark, folder, "documents").select("doc_id", "text")).drop("spans")
