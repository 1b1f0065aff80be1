"""Licence scans in DataFrame functions only (operator 7).

A header is a line with one of the KEYS in it.  Headers and licence templates are
sparse TF-IDF vectors; idf counts templates, and a word that no template has weighs
as the rarest do.  A header's licence is the template of the largest cosine, if that
is SIMILARITY or more; a row's own licence is that of its best header.

A licence file is a row whose name says so, or at least half of whose characters are
such headers; it speaks for its folder.  A row without a licence of its own
takes that of the nearest folder above it: the folders of its path are joined to the
folders of licence files by equality, and the deepest one wins.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIMILARITY = 0.6
KEYS = ("licen", "permission", "redistribut", "public domain", "spdx", "gnu", "mozilla", "creative commons")
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-][a-z0-9.-]*)?$"
WORD = "[^a-z0-9.]+"

# Usual statements of public licences.
TEMPLATES = (
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_weights() -> tuple[list[tuple[str, int, str, float]], list[tuple[str, float]]]:
    """(licence, template, word, weight over the template's length) and (word, idf)."""
    import re

    bags = [(name, Counter(w for w in re.split(WORD, text.lower()) if w)) for name, text in TEMPLATES]
    frequency = Counter(w for _, bag in bags for w in bag)
    idf = {w: 1 + math.log((1 + len(bags)) / (1 + n)) for w, n in frequency.items()}
    rows = []
    for n, (name, bag) in enumerate(bags):
        length = math.sqrt(sum((tf * idf[w]) ** 2 for w, tf in bag.items()))
        rows += [(name, n, w, tf * idf[w] / length) for w, tf in sorted(bag.items())]
    return rows, sorted(idf.items())


RAREST = 1 + math.log(1 + len(TEMPLATES))


def _has_key(text: Column) -> Column:
    found = F.lit(False)
    for key in KEYS:
        found = found | text.contains(key)
    return found


def headers(rows: DataFrame) -> DataFrame:
    """(row, license, similarity, size) of the headers of (row, text) that match."""
    spark = rows.sparkSession
    weights, idf = template_weights()
    # both tables are fixed lists of this module
    weight_table = F.broadcast(spark.createDataFrame(weights, "license string, template int, word string, weight double"))
    idf_table = F.broadcast(spark.createDataFrame(idf, "word string, idf double"))
    lines = rows.where(_has_key(F.lower("text"))).select("row", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    lines = lines.withColumn("low", F.lower("text")).where(_has_key(F.col("low")))
    words = lines.select("row", "line", F.length("text").alias("size"), F.explode(F.split("low", WORD)).alias("word")).where("word != ''")
    counted = words.groupBy("row", "line", "size", "word").agg(F.count("*").alias("tf"))
    valued = counted.join(idf_table, "word", "left").withColumn("value", F.col("tf") * F.coalesce("idf", F.lit(RAREST)))
    lengths = valued.groupBy("row", "line", "size").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    dots = valued.join(weight_table, "word").groupBy("row", "line", "license", "template").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    cosine = dots.join(lengths, ["row", "line"]).withColumn("similarity", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("similarity") >= SIMILARITY)
    # most similar first, ties to the first name
    best = F.min(F.struct((-F.col("similarity")).alias("order"), "license")).alias("best")
    return cosine.groupBy("row", "line", "size").agg(best).select("row", F.col("best.license").alias("license"), (-F.col("best.order")).alias("similarity"), "size")


def folders(path: Column) -> Column:
    """All folders above a path, the root ("") first; a path is a list of names parted by
    slashes, and slashes at its ends do not count."""
    names = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/+")
    return F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.array_join(F.slice(names, 1, n), "/"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id_col, path, license, similarity, how, folder) for every row of docs; how is own,
    inherited or none, and folder is where an inherited licence comes from.

    Null text is empty.  A null path has no folders, so nothing is inherited.  Rows that
    repeat id, path and text count once and get a row each.  Of several licence files in
    a folder the most similar counts, then the first name.  Other columns are not read;
    an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.struct("id", "path", F.xxhash64("text").alias("h")))
    order = F.min(F.struct((-F.col("similarity")).alias("order"), "license"))
    found = headers(rows.select("row", "text"))
    own = found.groupBy("row").agg(order.alias("best"), F.sum("size").alias("header_size")).select(
        "row", F.col("best.license").alias("license"), (-F.col("best.order")).alias("similarity"), "header_size")
    plain = rows.select("row", "id", "path", F.length("text").alias("size"))
    plain = plain.join(own, "row", "left")
    folder_of = F.element_at(folders(F.col("path")), -1)
    name = F.element_at(F.split(F.regexp_replace("path", r"/+$", ""), "/+"), -1)
    files = plain.where("license IS NOT NULL AND path IS NOT NULL").where(name.rlike(FILE_NAMES) | (F.col("header_size") * 2 >= F.col("size")))
    spoken = files.groupBy(folder_of.alias("folder")).agg(order.alias("best")).select(
        "folder", F.col("best.license").alias("f_license"), (-F.col("best.order")).alias("f_similarity"))
    above = plain.where("license IS NULL AND path IS NOT NULL").select("row", F.posexplode(folders(F.col("path"))).alias("depth", "folder")).distinct()
    taken = above.join(spoken, "folder").groupBy("row").agg(F.max(F.struct("depth", "folder", "f_license", "f_similarity")).alias("f")).select("row", "f.*").drop("depth")
    out = plain.join(taken, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "path", F.coalesce("license", "f_license").alias("license"), F.coalesce("similarity", "f_similarity").alias("similarity"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("f_license").isNotNull(), "inherited").otherwise("none").alias("how"), "folder")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return license_scan(docs)


def _sql() -> str:
    weights, idf = template_weights()
    low = " OR ".join(f"contains(lower(text), '{k}')" for k in KEYS)
    w = ", ".join(f"('{a}', {b}, '{c}', {d!r}::DOUBLE)" for a, b, c, d in weights)
    i = ", ".join(f"('{a}', {b!r}::DOUBLE)" for a, b in idf)
    return f"""
WITH weights(license, template, word, weight) AS (VALUES {w}), idf(word, idf) AS (VALUES {i}),
d AS (SELECT doc_id, source || '/' || lang AS folder, source, source || '/' || lang || '/' || doc_id AS path, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, line, ls[line] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d WHERE {low}))),
words AS (SELECT doc_id, line, length(text) AS size, unnest(regexp_split_to_array(lower(text), '{WORD}')) AS word FROM l WHERE {low}),
v AS (SELECT doc_id, line, size, word, count(*) * coalesce(any_value(idf), {RAREST!r}) AS value FROM words LEFT JOIN idf USING (word) WHERE word != '' GROUP BY ALL),
n AS (SELECT doc_id, line, size, sqrt(sum(value * value)) AS length FROM v GROUP BY ALL),
dots AS (SELECT doc_id, line, license, template, sum(value * weight) AS dot FROM v JOIN weights USING (word) GROUP BY ALL),
c AS (SELECT doc_id, line, size, license, round(dot / length, 6) AS similarity FROM dots JOIN n USING (doc_id, line) WHERE round(dot / length, 6) >= {SIMILARITY}),
h AS (SELECT doc_id, line, size, first(license ORDER BY similarity DESC, license) AS license, max(similarity) AS similarity FROM c GROUP BY ALL),
own AS (SELECT doc_id, first(license ORDER BY similarity DESC, license) AS license, max(similarity) AS similarity, sum(size) AS header_size FROM h GROUP BY ALL),
spoken AS (SELECT folder, first(license ORDER BY similarity DESC, license) AS license, max(similarity) AS similarity
           FROM d JOIN own USING (doc_id) WHERE header_size * 2 >= length(text) GROUP BY ALL)
SELECT d.doc_id, d.path, coalesce(own.license, s.license) AS license, coalesce(own.similarity, s.similarity) AS similarity,
  CASE WHEN own.license IS NOT NULL THEN 'own' WHEN s.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN own.license IS NULL THEN s.folder END AS folder
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN spoken s ON s.folder = d.folder AND own.license IS NULL
"""


OP7_SQL = _sql()
