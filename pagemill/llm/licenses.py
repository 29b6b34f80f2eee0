"""Licence scans by diagonal voting, with DataFrame functions only.

All rolling word pairs of the texts are joined to the positions of the
templates' word pairs. A hit at word i of a text and position p of a template
votes for the diagonal i - p; neighbouring diagonals (an inserted or lost word
moves the rest of a text by one) are merged into one span, and a span is
verified by the share of the template's pairs that it holds, in a stretch not
much longer than the template. A phrase is a template of which all pairs must
stand on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Words that name a licence, as they stand in a row, and the label each gives.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
#: Opening passages and notices of public licences, as words, and the label each gives.
TEMPLATES = [
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit-text"),
    ("licensed under the apache license version 2 0", "apache-2.0-notice"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "apache-2.0-text"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0-notice"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0-notice"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0-notice"),
]
#: Words of a text: runs of code points outside these.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals this far apart are merged; the share of pairs that verifies a span; how much longer than its template it may be.
APART, SHARE, STRETCH = 2, 0.6, 1.5


def template_pairs(spark: SparkSession) -> DataFrame:
    """(label, exact, pairs, p, a, b): every word pair of every phrase and template. A few hundred rows, whatever the input."""
    rows = []
    for texts, exact in ((PHRASES, True), (TEMPLATES, False)):
        for text, label in texts:
            words = text.split()
            rows += [(label, exact, len(words) - 1, p, a, b) for p, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.createDataFrame(rows, "label string, exact boolean, pairs int, p int, a string, b string")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scans whole texts for phrases and templates.

    Returns (texts, spans). texts: id, version (xxhash64 of the text) and n_words,
    one for each input row. spans: id, version, label, exact, first and last
    (words from 0) and share (of the template's pairs, 0 to 1), one for each
    verified span of a version; a phrase's last is the last of its words.

    Words are runs of digits, letters a to z (A to Z lower-cased) and non-ASCII
    code points. Full lower-casing gives the same: it turns no other code point
    into a letter that a phrase or template has, but for the Kelvin sign, which
    stands for k. Null and empty texts have no words and no spans. Rows that
    repeat an id are told apart by version; equal rows have their spans once.
    Null ids are an id of their own. Other columns are not read.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version"), words.alias("w"))
    texts = rows.select("id", "version", F.size("w").cast("long").alias("n_words"))
    pair = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), a.alias("a"), b.alias("b")))
    rolling = rows.where(F.size("w") > 1).select("id", "version", F.posexplode(pair).alias("i", "pair"))
    told = F.broadcast(template_pairs(docs.sparkSession).withColumn("h", F.xxhash64("a", "b")))
    same = (F.col("pair.h") == F.col("h")) & (F.col("pair.a") == F.col("a")) & (F.col("pair.b") == F.col("b"))
    hits = rolling.join(told, same).select("id", "version", "label", "exact", "pairs", "p", "i", (F.col("i") - F.col("p")).alias("d"))
    # Few rows; written, so that the texts are scanned once for both kinds of template.
    hits = written(hits, "hits").distinct()
    votes = hits.groupBy("id", "version", "label", "exact", "pairs", "d").agg(F.collect_set("p").alias("ps"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    # Phrases: a full diagonal. Templates: neighbouring diagonals together.
    phrases = votes.where(F.col("exact") & (F.size("ps") == F.col("pairs"))).select("id", "version", "label", "exact", F.col("d").alias("first"), (F.col("d") + F.col("pairs")).alias("last"), F.lit(1.0).alias("share"))
    order = W.partitionBy("id", "version", "label").orderBy("d")
    fresh = F.when(F.col("d") - F.lag("d").over(order) <= APART, 0).otherwise(1)
    islands = votes.where(~F.col("exact")).withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    spans = islands.groupBy("id", "version", "label", "exact", "pairs", "island").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("held"), F.min("lo").alias("first"), (F.max("hi") + 1).alias("last"))
    share = F.col("held") / F.col("pairs")
    verified = spans.where((share >= SHARE) & (F.col("last") - F.col("first") + 1 <= STRETCH * (F.col("pairs") + 1)))
    return texts, phrases.unionByName(verified.select("id", "version", "label", "exact", "first", "last", share.alias("share")))
