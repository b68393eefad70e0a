"""License scans by diagonal voting, in DataFrame functions only.

Every text's rolling three-word shingles are joined to the positions of the same
shingles in license templates (hash first, then the words themselves; texts'
shingles with no template's hash are left before they are written out).  A match
votes for the diagonal of its template: text position less template position.
Neighbouring diagonals, parted by a few inserted or missing words, are merged.
Within a merged span the stretch, not much longer than the template, that most
distinct template positions vote for is verified: it counts when enough do.
Whatever else runs on beside a true span, it isn't lost.  Base phrases must match
in full on one diagonal.

The templates are a fixed list of this module or the caller's; up to ``MOST_SENT``
words they are broadcast, beyond it the join shuffles; the texts are read once and only matches and one
row a document are shuffled, by row, whatever its id.

Defined cases: null and empty texts have no words; a null doc_id stays null;
repeated rows each give a row; an empty table gives no rows; texts of any length
are scanned whole; of overlapping spans each counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import pick

K = 3
#: Diagonals this close belong to one span; share of a template that must vote;
#: how much longer than its template a span may be.
SLACK = 4
COVERAGE = 0.75
LONGER = 1.3

# Phrases that count wherever their words stand consecutively.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Opening words of public license texts and usual notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl-3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Template shingles up to which they are sent to all tasks and looked up by hash
#: before the join; beyond it all rolling shingles are joined by a shuffle.
MOST_SENT = 5000

#: A shingle that no text can hold; each row's last, so that every row has a match.
_END = "\x01"


def words(text: Column) -> Column:
    """The text's words: ASCII letters lower-cased, parted by all other ASCII.

    The Kelvin sign, whose lower case is an ASCII letter, is kept apart.
    """
    lowered = F.lower(F.replace(text, F.lit("K"), F.lit("é")))
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _run(of: Column, i: Column, k: int) -> list[Column]:
    """The k words from place i, counted from 1."""
    return [F.element_at(of, (i + j).cast("int")) for j in range(k)]


def shingles(of: Column, k: int = K, hashes: list[int] | None = None) -> Column:
    """(pos, gram) of all rolling runs of k words; of those with a listed hash only, if hashes are listed."""
    last = F.size(of) - (k - 1)
    places = F.sequence(F.lit(1), last)
    if hashes is not None:
        places = F.filter(places, lambda i: F.xxhash64(*_run(of, i, k)).isin(hashes))
    grams = F.transform(places, lambda i: F.struct((i - 1).cast("int").alias("pos"), F.concat_ws(" ", *_run(of, i, k)).alias("gram")))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<struct<pos:int,gram:string>>"))


def template_positions(spark: SparkSession, templates=TEMPLATES, base=BASE, k: int = K) -> DataFrame:
    """(h, gram, template, label, base, tpos, n_grams, slack, need): a row for each shingle of each template."""
    listed = [(i, label, text, True) for i, (label, text) in enumerate(base)]
    listed += [(len(base) + i, label, text, False) for i, (label, text) in enumerate(templates)]
    rows = spark.createDataFrame(listed, "template int, label string, text string, base boolean")
    grams = rows.select("template", "label", "base", F.inline(shingles(words(F.col("text")), k)).alias("tpos", "gram"))
    n = Window.partitionBy("template")
    grams = grams.withColumn("n_grams", F.count("*").over(n))
    end = spark.createDataFrame([(-1, "", False, 0, _END, 1)], "template int, label string, base boolean, tpos int, gram string, n_grams long")
    grams = grams.unionByName(end.select(grams.columns))
    return grams.select(
        F.xxhash64("gram").alias("h"), "gram", "template", "label", "base", "tpos", "n_grams",
        F.when(F.col("base"), 0).otherwise(SLACK).alias("slack"),
        F.when(F.col("base"), F.col("n_grams")).otherwise(F.ceil(COVERAGE * F.col("n_grams"))).alias("need"),
    )


def license_spans(docs: DataFrame, templates=TEMPLATES, base=BASE, k: int = K) -> DataFrame:
    """(row, doc_id, n_words, template, label, base, start, end, coverage): verified spans.

    Starts and ends count words from 0, the end exclusive.  Each row also has
    one span of template -1, which stands for the row itself.
    """
    rows = pick(docs, doc_id="long", text="string").select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    known = template_positions(docs.sparkSession, templates, base, k).withColumnRenamed("gram", "tgram")
    sent = sum(len(text.split()) for _, text in [*base, *templates]) <= MOST_SENT
    hashes = [r[0] for r in known.where(F.col("tgram") != _END).select(F.xxhash64(*_run(F.split("tgram", " "), F.lit(1), k))).distinct().collect()] if sent else None
    end = F.array(F.struct(F.lit(0).alias("pos"), F.lit(_END).alias("gram")))
    grams = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.inline(F.concat(shingles(F.col("w"), k, hashes), end)).alias("pos", "gram"))
    known = F.broadcast(known) if sent else known
    hits = grams.withColumn("h", F.xxhash64("gram")).join(known, "h").where("gram = tgram")
    key = ["row", "doc_id", "n_words", "template", "label", "base", "n_grams", "slack", "need"]
    hits = hits.select(*key, "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal")).repartition("row")
    along = Window.partitionBy("row", "template").orderBy("diagonal", "pos", "tpos")
    parted = (F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack")).cast("int")
    hits = hits.withColumn("parted", F.coalesce(parted, F.lit(0))).withColumn("span", F.sum("parted").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # from each place of a span as far as a stretch may reach, counted in millionths of that reach (rounding down keeps the order)
    reach = F.greatest(F.lit(1), F.floor(LONGER * (F.col("n_grams") + k - 1)) - k)
    stretch = Window.partitionBy("row", "template", "span").orderBy("at").rangeBetween(0, 1 << 20)
    hits = hits.withColumn("at", F.floor(F.col("pos").cast("long") * (1 << 20) / reach))
    hits = hits.withColumn("votes", F.size(F.collect_set("tpos").over(stretch)).cast("long")).withColumn("end", F.max("pos").over(stretch) + k)
    best = F.max_by(F.struct(F.col("pos").alias("start"), "end", "votes"), F.struct("votes", -F.col("pos")))
    spans = hits.groupBy(*key, "span").agg(best.alias("best")).select(*key, "best.*").where("votes >= need")
    return spans.select("row", "doc_id", "n_words", "template", "label", "base", "start", "end", (F.col("votes") / F.col("n_grams")).alias("coverage"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row per document: its words, base places, labels and score."""
    real = F.col("template") >= 0
    at_base = real & F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        license_spans(docs, templates, base)
        .groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(at_base).alias("n_base"),
            F.min(F.when(at_base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(at_base, F.col("start"))).cast("long").alias("last_word"),
            joined(F.when(at_base, F.col("label"))).alias("base_labels"),
            joined(F.when(real, F.col("label"))).alias("labels"),
            F.coalesce(F.max(F.when(real, F.col("coverage"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
