"""Operator 6: license scans by diagonal voting over word 2-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases whose every place counts, word for word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening words of licenses in use, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "no part of this publication may be reproduced or transmitted in any form without written permission": "reserved",
}
#: Diagonals this near are one passage with words put in or left out; a passage needs this share of its template.
NEAR, COVER, STRETCH = 3, 0.7, 1.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of text with A-Z in lower case; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def grams(word: Column) -> Column:
    """Hashes of all 2-grams of an array of words, in order."""
    hashed = F.transform(word, lambda w: F.xxhash64(w))
    n = F.greatest(F.size(hashed) - 1, F.lit(0))
    return F.zip_with(F.slice(hashed, 1, n), F.slice(hashed, 2, n), lambda a, b: F.xxhash64(a, b))


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """gram, template, at (its place there), base, size (2-grams of the template), label: a few hundred rows."""
    rows = [(i, p, label, i < len(phrases)) for i, (p, label) in enumerate([*phrases.items(), *templates.items()])]
    table = spark.createDataFrame(rows, "template int, phrase string, label string, base boolean")
    gram = grams(words(F.col("phrase")))
    return table.select("template", "label", "base", F.size(gram).alias("size"), F.posexplode(gram).alias("at", "gram"))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Licenses of each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Every 2-gram of a document is joined with its places in the templates; a place votes for the diagonal
    "place in the document less place in the template". A phrase stands where its diagonal has all votes.
    Diagonals of one template within NEAR of each other are merged; the merged passage is verified if it
    covers COVER of the template's 2-grams within STRETCH times its length, and then gives its label and
    span (first word, end). A place of the template counts once, however often its 2-gram comes in the
    passage. score is the best coverage, 0 without a label.

    The templates are broadcast: their number is that of this module's table. A document also keeps one
    row of its own, so that texts without a match, null and empty ones (n_words 0, no labels) stay.
    Rows are told apart by doc_id and a hash of the text, which a lost partition computes alike; repeated rows are scanned together and each give
    their row. Labels of equal score are all kept, sorted. Other columns are not looked at.
    """
    table = template_grams(docs.sparkSession, phrases or PHRASES, templates or TEMPLATES)
    own = docs.select(F.xxhash64("text").alias("row"), "doc_id", words(F.col("text")).alias("w"))
    each = own.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(grams(F.col("w"))).alias("pos", "gram"))
    hit = each.join(F.broadcast(table), "gram", "left").filter("template is not null or pos = 0 or pos is null")
    votes = hit.groupBy("row", "doc_id", "n_words", "template", "label", "base", "size", (F.col("pos") - F.col("at")).alias("diagonal"))
    votes = votes.agg(F.array_sort(F.collect_set("at")).alias("places"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.count(F.when(F.coalesce("pos", F.lit(0)) == 0, 1)).alias("copies"))
    order = Window.partitionBy("row", "doc_id", "n_words", "template").orderBy("diagonal")
    new = F.col("base") | F.lag("diagonal").over(order).isNull() | (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR)
    runs = votes.withColumn("run", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(order))
    runs = runs.groupBy("row", "doc_id", "n_words", "template", "label", "base", "size", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("copies").alias("copies"))
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("size"))
    stands = F.when(F.col("base"), F.col("votes") == F.col("size")).otherwise((cover >= COVER) & (F.col("high") - F.col("low") + 2 <= STRETCH * (F.col("size") + 1)))
    stands = F.coalesce(stands, F.lit(False))
    base = stands & F.col("base")
    span = F.when(stands, F.struct(F.col("low").cast("long").alias("start"), (F.col("high") + 2).cast("long").alias("end"), "label"))
    out = runs.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("low"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(stands, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(stands, cover)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(span)).alias("spans"),
        F.max("copies").alias("copies"),
    )
    # the first place of a text stands on one diagonal of a template for each row that repeats it
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("row", "copies", "copy")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.drop("spans")
