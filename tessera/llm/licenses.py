"""License texts found by diagonal voting. DataFrame operations only.

All rolling word k-gram hashes of all documents are joined with the places
where the templates have them (the words themselves are compared in the join);
k is 3, less for short templates. A match votes for its diagonal: place in the
document less place in the template. Votes are gathered by document, template
and diagonal; from each diagonal on, those that left-out or added words can make
are merged with it, as far as they keep to a span of `stretch` times the
template's length; such a span is verified by how many of the template's words
it has. No text is shuffled while the templates are few (checked).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, native_words, save
from .decontaminate import END, positions, shingle_key

#: Fixed values of the contract: phrases and their labels. Every place where a phrase stands counts.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices of public licenses, found also where some words differ.
NOTICES = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "mit",
    ),
    (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "gpl",
    ),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        "lgpl",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "agpl",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "bsd",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "mpl",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        "unlicense",
    ),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under CC BY 4.0", "cc-by"),
)


def templates(spark: SparkSession, short: int, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(template, label, exact, size, k, place, gram, sought): the k-grams of every template that has words."""
    rows = [(i, label, exact, text) for i, (text, label, exact) in enumerate([*((t, b, True) for t, b in phrases), *((t, b, False) for t, b in notices)])]
    words = spark.createDataFrame(rows, "template int, label string, exact boolean, text string").withColumn("w", native_words(F.col("text"))).filter(F.size("w") > 0)
    k = F.least(F.when(F.col("exact") | (F.size("w") < short), F.lit(2)).otherwise(F.lit(3)), F.size("w"))
    spread = words.withColumn("k", k).select("template", "label", "exact", F.size("w").alias("size"), "k", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("place"))
    gram = F.slice("w", F.col("place") + 1, F.col("k"))
    sought = F.when(F.col("k") == 1, shingle_key("gram", F.lit(0), 1)).when(F.col("k") == 2, shingle_key("gram", F.lit(0), 2)).otherwise(shingle_key("gram", F.lit(0), 3))
    return spread.withColumn("gram", gram).drop("w").withColumn("sought", sought)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.75, stretch: float = 1.34, short: int = 12, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    A phrase, of one word or more, must stand whole on one diagonal. A notice is
    found if `share` of its words stand within `stretch` times its length; one
    of fewer than `short` words must be whole. Phrases and notices without words
    are never found. score is 1 for a whole phrase, else the best notice's share
    of words, 0 if nothing votes; of notices with one label any will do. Texts
    are whole, of any length. Null and empty texts have no words; repeated
    rows each give their row; extra columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    grams = save(templates(spark, short, phrases, notices), "templates")
    widths = sorted(r.k for r in grams.select("k").distinct().collect()) or [2]  # three at most
    # the marker row joins each document's end, so every document leaves one row
    marker = spark.createDataFrame([(END,)], "sought long")
    end = F.col("pos") == F.col("n_words")
    same = F.slice("words", F.col("pos") + 1, F.col("k")) == F.col("gram")
    cond = (F.col("key") == F.col("sought")) & F.when(F.col("template").isNull(), end).otherwise(~end & same)
    joined = positions(docs, widths).join(maybe_broadcast(grams.unionByName(marker, allowMissingColumns=True)), cond)
    votes = save(joined.select("doc_id", "fp", "n_words", "template", "label", "exact", "size", "k", "place", (F.col("pos") - F.col("place")).alias("diagonal")), "votes")

    ends = votes.filter("template is null").select("doc_id", "fp", "n_words")
    by = ["doc_id", "fp", "template", "label", "exact", "size", "k"]
    lines = votes.filter("template is not null").groupBy(*by, "diagonal").agg(F.collect_set("place").alias("places"))  # at most the template's length
    whole = F.size("places") == F.col("size") - F.col("k") + 1
    base = lines.filter(F.col("exact") & whole).select("doc_id", "fp", "label", F.col("diagonal").alias("first"), F.lit(True).alias("base"), F.lit(1.0).alias("score"))

    # votes on diagonals from d to d + added lie within the template's length and `added` words
    added = F.floor(F.lit(stretch - 1) * F.col("size")) + 0.5
    onward = Window.partitionBy("doc_id", "fp", "template").orderBy(F.col("diagonal") / added).rangeBetween(0, 1)
    loose = lines.filter(~F.col("exact"))
    merged = loose.withColumn("places", F.when(F.col("size") < short, F.col("places")).otherwise(F.array_distinct(F.flatten(F.collect_list("places").over(onward)))))
    words = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    found = merged.withColumn("score", words / F.col("size"))
    sure = F.when(F.col("size") < short, whole).otherwise(F.col("score") >= share)
    notice = found.select("doc_id", "fp", F.when(sure, F.col("label")).alias("label"), F.lit(None).cast("long").alias("first"), F.lit(False).alias("base"), "score")

    per = base.unionByName(notice).groupBy("doc_id", "fp").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min("first").alias("first_word"),
        F.max("first").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    per = per.withColumnsRenamed({"doc_id": "p_doc", "fp": "p_fp"})
    out = ends.join(per, ends.doc_id.eqNullSafe(F.col("p_doc")) & ends.fp.eqNullSafe(F.col("p_fp")), "left")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
