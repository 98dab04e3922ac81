"""License scans with DataFrame operations only.

Texts become lower-case words; windows of `WINDOW` words start at every `STRIDE`-th word, and each is reduced to
`BANDS` MinHash values of its word pairs, one a band.  Any band value shared with a window of a template retrieves
that template.  Short, changed or scattered notices may share no such value, so each template also has guards: as
many of its word pairs as a document may lack, and one more.  A document that holds enough of a template holds one
of its guards, so guards miss nothing.  They are compared in a band of their own, number `BANDS`.  Retrieved
templates are verified exactly: the share of a template's distinct word pairs that the document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.shared import written

WINDOW, STRIDE, BANDS = 8, 4, 8

#: Public license notices and grants that the scan knows.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT-notice": "Released under the MIT License",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}


def templates(spark: SparkSession) -> DataFrame:
    """The known templates: license, text."""
    return spark.createDataFrame(sorted(TEMPLATES.items()), "license string, text string")


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _pairs(words: str) -> Column:
    """The distinct word pairs of a column of words; of one word, itself."""
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.when(F.size(words) > 1, F.array_compact(F.array_distinct(pairs))).otherwise(F.col(words))


def _banded(df: DataFrame, stride: int, guarded: bool = False) -> DataFrame:
    """`first` (word number of a window) and its BANDS MinHash values, as rows (band, value), of rows with `words`.

    guarded: the first `stride` word pairs of each window follow in band BANDS; windows start up to the last pair,
    so that is every pair of the text once.  Words are hashed once; the minima are taken over fixed columns, which stay in generated code.
    """
    rest = [c for c in df.columns if c != "words"]
    hashed = df.select(*rest, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("h") - (2 if guarded else WINDOW - stride + 1)), F.lit(stride))
    windows = hashed.select(*rest, F.posexplode(F.transform(starts, lambda i: F.slice("h", i + 1, WINDOW))).alias("number", "w"))
    windows = windows.select(*rest, (F.col("number") * stride).alias("first"), *(F.get("w", F.lit(k)).alias(f"w{k}") for k in range(WINDOW)))
    windows = windows.where("w1 IS NOT NULL OR first = 0")
    pairs = windows.select(*rest, "first", *(F.when(F.col(f"w{k + 1}").isNotNull(), F.xxhash64(f"w{k}", f"w{k + 1}")).alias(f"p{k}") for k in range(WINDOW - 1)))

    def least(seed: int) -> Column:
        return F.least(*(F.when(F.col(f"p{k}").isNotNull(), F.xxhash64(F.lit(seed), f"p{k}")) for k in range(WINDOW - 1)), F.lit(9223372036854775807))

    own = [f"p{k}" for k in range(stride)] if guarded else []
    values = pairs.select(*rest, "first", *own, *(least(seed).alias(f"v{seed}") for seed in range(BANDS)))
    values = values.select(*rest, "first", F.posexplode(F.array(*(f"v{s}" for s in range(BANDS)), *own)).alias("band", "value"))
    return values.withColumn("band", F.least("band", F.lit(BANDS))) if guarded else values


def _guards(wanted: DataFrame, least: float) -> DataFrame:
    """license, band and value of so many pairs of each template that a share `least` of its pairs holds one of them.

    The longest are taken, as they are rarer in texts.  Templates of one word have none: their bands are equal.
    """
    pairs = wanted.where("size(words) > 1").select("license", F.array_sort(F.transform(_pairs("words"), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("pair")))).alias("pairs"))
    enough = F.greatest(F.lit(1), F.ceil(F.size("pairs") * F.lit(least) - 1e-9)).cast("int")
    each = pairs.select("license", F.explode(F.slice("pairs", F.lit(1), F.greatest(F.lit(1), F.size("pairs") - enough + 1))).alias("p")).select("license", F.split("p.pair", " ").alias("w"))
    return each.select("license", F.lit(BANDS).alias("band"), F.xxhash64(F.xxhash64(F.col("w")[0]), F.xxhash64(F.col("w")[1])).alias("value"))


def scan(df: DataFrame, known: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each template found in a document: doc_id, license, containment, n_pairs, first_word.

    containment: the share of the template's distinct word pairs (its only word, if it has one) that the document
    holds; first_word: number of the first word of the first window that retrieved it (by a band or a guard).  known: license, text; its
    size is checked, and a large collection is joined by a shuffle instead of a broadcast.  Null and empty texts
    hold nothing; rows that share an id are one document with the union of their pairs; templates without
    words are never found; an empty table gives no rows.
    """
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    wanted = written(known.select("license", words_of(F.col("text")).alias("words")).where("license IS NOT NULL AND words[0] != ''"), "license-templates")
    bands = written(_banded(wanted, 1).select("license", "band", "value").unionByName(_guards(wanted, least)).distinct(), "license-bands")
    small = bands.count() <= 1 << 20 and (wanted.agg(F.sum(F.octet_length(F.array_join("words", " ")))).first()[0] or 0) <= 16 << 20  # rows of bands, bytes of templates
    bands = F.broadcast(bands) if small else bands

    found = _banded(docs.select("doc_id", words_of(F.col("text")).alias("words")), STRIDE, guarded=True).join(bands, ["band", "value"]).groupBy("doc_id", "license").agg(F.min("first").cast("long").alias("first_word"))
    found = written(found, "license-candidates")

    pairs = wanted.select("license", F.explode(_pairs("words")).alias("pair"))
    sizes = pairs.groupBy("license").agg(F.count("*").alias("n_pairs"), F.collect_set("pair").alias("pairs"))
    candidates = found.where("doc_id IS NOT NULL").join(F.broadcast(sizes) if small else sizes, "license")
    by_doc = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("license", "first_word", "n_pairs", "pairs")).alias("templates"))
    held = docs.join(by_doc, "doc_id").select("doc_id", "templates", words_of(F.col("text")).alias("words")).select("doc_id", "templates", _pairs("words").alias("own"))
    each = held.select("doc_id", "own", F.explode("templates").alias("t")).select("doc_id", F.col("t.license").alias("license"), F.col("t.first_word").alias("first_word"), F.col("t.n_pairs").alias("n_pairs"), F.array_intersect("own", "t.pairs").alias("common"))
    each = each.groupBy("doc_id", "license", "first_word", "n_pairs").agg(F.size(F.array_distinct(F.flatten(F.collect_list("common")))).alias("n"))
    return each.withColumn("containment", F.col("n") / F.col("n_pairs")).where(F.col("containment") >= least).select("doc_id", "license", "containment", "n_pairs", "first_word")
