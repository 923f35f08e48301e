"""License scans: normalised text against license templates by the Dice coefficient over word bigrams.

Pieces are lines, paragraphs of several lines, and whole texts of several paragraphs; a notice may also stand inside a paragraph, where
windows of a template's size are compared. Bigrams count as often as they occur, so the number of words alone bounds the
coefficient, and a template is only compared with pieces whose size allows the threshold. A window that reaches it
holds one of the template's first few bigrams, the most telling ones first, so only windows around those are formed. Templates of all
versions and kinds compete, and the best one names the license. All of it is DataFrame work inside the JVM.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.session import materialise

THRESHOLD = 0.8

# Names of public licenses, phrases that name a license, and customary notices.
NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
)
FORMS = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.")
COMMONS_FORMS = ("Licensed under {}.", "This work is licensed under {}.")
GNU_NOTICE = ("This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software "
              "Foundation, either version {} of the License, or (at your option) any later version.")
NOTICES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words that tell notices from other text, the most telling ones first.
TELLING = ("license", "licensed", "commons", "cc", "copyright", "rights", "permission", "redistribution", "unencumbered", "redistribute", "software",
           "permitted", "granted")


def _templates() -> tuple[tuple[str, str], ...]:
    """Every name in every form, short names of the Creative Commons, the notices of the GNU licenses, and those above."""
    named = [(i, form.format(name)) for i, name in NAMES for form in FORMS]
    commons = [(i, form.format("CC " + i[3:].replace("-4.0", " 4.0"))) for i, _ in NAMES if i.startswith("CC-") for form in COMMONS_FORMS]
    gnu = [(i, GNU_NOTICE.format(*name.split(", version "))) for i, name in NAMES if name.startswith("GNU ")]
    return (*named, *commons, *gnu, *NOTICES)


TEMPLATES = _templates()


def normal(text: Column) -> Column:
    """A text in lower case, with everything but letters and digits taken for space, and single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(found: Column) -> Column:
    """Neighbouring words as pairs; of a single word, the word."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(found) - 1), lambda i: F.concat_ws(" ", F.element_at(found, i), F.element_at(found, i + 1)))
    return F.when(F.size(found) > 1, pairs).otherwise(found)


def n_bigrams(plain: Column) -> Column:
    """Number of bigrams of a normal text: its spaces, or 1 for a single word."""
    return F.greatest(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))), F.lit(1))


def pieces(docs: DataFrame, low: float, high: float) -> DataFrame:
    """``row, doc_id, unit, number, plain, n``: lines, paragraphs of several lines, texts of several paragraphs, in normal form; numbers
    from 1. Only those of ``low`` to ``high`` bigrams.

    Every line is brought to normal form once; that of a single paragraph and of the whole text is that of its lines.
    """
    text = F.coalesce("text", F.lit(""))
    parted = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.transform(F.split(text, "\n", -1), normal).alias("lines"),
                         F.split(text, r"\n[ \t]*\n", -1).alias("paragraphs"))

    def numbered(unit: str, parts: Column) -> Column:
        sized = F.transform(parts, lambda x, i: F.struct(F.lit(unit).alias("unit"), (i + 1).alias("number"), x.alias("plain"),
                                                         n_bigrams(x).alias("n")))
        return F.filter(sized, lambda s: (s["plain"] != "") & (s["n"] >= low) & (s["n"] <= high))

    none = F.array().cast("array<string>")
    joined = F.array(F.array_join(F.filter("lines", lambda x: x != ""), " "))
    several = F.transform("paragraphs", lambda p: F.when(F.contains(p, F.lit("\n")), normal(p)).otherwise(F.lit("")))
    one = F.size("paragraphs") == 1
    found = F.concat(numbered("line", F.col("lines")),
                     numbered("paragraph", F.when(one & (F.size("lines") > 1), joined).when(one, none).otherwise(several)),
                     numbered("text", F.when(one, none).otherwise(joined)))
    return parted.select("row", "doc_id", F.explode(found).alias("part")).select("row", "doc_id", "part.*")


def templates(spark: SparkSession, texts: tuple[tuple[str, str], ...]) -> DataFrame:
    """``template, license, size, bigram, times``: the bigrams of a fixed list of notices."""
    table = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(texts)], "template int, license string, text string")
    found = table.select("template", "license", normal(F.col("text")).alias("plain")).select(
        "template", "license", n_bigrams(F.col("plain")).alias("size"), F.explode(bigrams(F.split("plain", " "))).alias("bigram"))
    return found.groupBy("template", "license", "size", "bigram").agg(F.count("*").alias("times"))


def prefixes(texts: tuple[tuple[str, str], ...], threshold: float) -> list[tuple[int, str, int, str]]:
    """``template, license, size, bigram``: so many bigrams of each template that a window of its size must hold one to reach the threshold."""
    def order(gram: str) -> tuple[int, str]:
        return min((TELLING.index(w) for w in gram.split() if w in TELLING), default=len(TELLING)), gram

    rows = []
    for i, (name, text) in enumerate(texts):
        words = _words(text)
        grams = Counter(f"{a} {b}" for a, b in zip(words, words[1:])) or Counter(words)
        size = sum(grams.values())
        open_ = size - math.ceil(threshold * size - 1e-9) + 1
        for gram in sorted(grams, key=order):
            if open_ <= 0:
                break
            rows.append((i, name, size, gram))
            open_ -= grams[gram]
    return rows


def windows(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, number, start, license, dice`` of notices inside paragraphs: windows of a template's size that reach the threshold.

    ``start`` is the number of the window's first word in the paragraph, from 0. Of overlapping windows the best stays, by coefficient, then
    size, template and start. Only paragraphs with a word of some prefix are looked at.
    """
    first = prefixes(texts, threshold)
    spark = docs.sparkSession
    held = F.broadcast(templates(spark, texts).select("template", "size", "bigram", "times"))
    anchors = sorted({min(g.split(), key=lambda w: (TELLING.index(w) if w in TELLING else len(TELLING), -len(w))) for *_, g in first})
    long, short = F.array(*[F.lit(a) for a in anchors if len(a) > 3]), "|".join(a for a in anchors if len(a) <= 3)
    low = F.transform(F.array(F.lower("text")), lambda t: F.exists(long, lambda a: F.contains(t, a)) | (
        F.rlike(t, F.lit(rf"(?<![a-z0-9])(?:{short})(?![a-z0-9])")) if short else F.lit(False)))
    whole = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").where(F.get(low, F.lit(0)))
    parts = F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n[ \t]*\n", -1)).alias("at", "part")
    plain = whole.select("row", "doc_id", parts).select("row", "doc_id", (F.col("at") + 1).alias("number"), F.get(
        F.transform(F.array(F.split(normal(F.col("part")), " ")), bigrams), F.lit(0)).alias("grams"))
    # places of prefixes, with the size of the largest template they belong to; only what is as near to one is written
    reach = {}
    for _, _, size, gram in first:
        reach[gram] = max(size, reach.get(gram, 0))
    sizes = F.create_map(*[F.lit(x) for pair in reach.items() for x in pair])
    placed = F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("pos"), g.alias("gram"))), lambda x: x["gram"].isin(list(reach)))
    spots = F.transform(placed, lambda x: F.struct(x["pos"], F.element_at(sizes, x["gram"]).alias("size")))
    # written, as a column of a frame is worked out anew for every element of a function over another one
    met = materialise(plain.withColumn("spots", spots).where(F.size("spots") > 0), "license-paragraphs")
    near = F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("pos"), g.alias("bigram"))), lambda x: F.exists(
        "spots", lambda y: F.abs(x["pos"] - y["pos"]) < y["size"]))
    grams = met.select("row", "number", F.size("grams").alias("n"), F.inline(near))
    window = ["row", "number", "n", "template", "size"]
    dice = lambda both: 2.0 * F.col(both) / (2 * F.col("size"))
    # of every bigram of a template its places, in order; a place counts for the windows that hold it, but not so many earlier ones of the
    # same bigram as the template has
    places = grams.join(F.broadcast(held.select("bigram").distinct()), "bigram").groupBy("row", "number", "n", "bigram").agg(
        F.array_sort(F.collect_list("pos")).alias("places"))
    shared = places.join(held, "bigram").where("n >= size").withColumn("times", F.col("times").cast("int"))
    spans = F.transform("places", lambda p, i: F.struct(
        F.greatest(F.lit(0), p - F.col("size") + 1, F.coalesce(F.get("places", i - F.col("times")) + 1, F.lit(0))).alias("first"),
        F.least(p, F.col("n") - F.col("size")).alias("last")))
    spanned = shared.select(*window, F.least(F.size("places"), F.col("times")).alias("most"), spans.alias("spans")).groupBy(*window).agg(
        F.sum("most").alias("most"), F.collect_list("spans").alias("spans")).where(dice("most") >= threshold)
    steps = spanned.select(*window, F.explode(F.flatten("spans")).alias("span")).where("span.first <= span.last").select(*window, F.inline(F.array(
        F.struct(F.col("span.first").alias("start"), F.lit(1).alias("step")), F.struct((F.col("span.last") + 1).alias("start"), F.lit(-1).alias("step")))))
    along = W.partitionBy(*window).orderBy("start")
    level = steps.groupBy(*window, "start").agg(F.sum("step").alias("step")).withColumn("both", F.sum("step").over(along)).withColumn(
        "until", F.lead("start").over(along))
    good = level.withColumn("dice", dice("both")).where(F.col("dice") >= threshold).withColumn(
        "start", F.explode(F.sequence(F.col("start"), F.col("until") - 1)))
    # per paragraph as many windows as there are places in it for notices
    ranked = good.groupBy("row", "number").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("dice")).alias("order"), (-F.col("size")).alias("less"), "template", "start", "size", "dice"))).alias("found"))

    def apart(kept: Column, x: Column) -> Column:
        return ~F.exists(kept, lambda a: (a["start"] <= x["start"] + x["size"]) & (x["start"] <= a["start"] + a["size"]))

    kept = F.aggregate("found", F.slice("found", F.lit(1), F.lit(0)), lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    names = F.lit([name for name, _ in texts]).cast("array<string>")
    named = ranked.select("row", "number", F.explode(kept).alias("w")).select(
        "row", "number", F.col("w.start").cast("bigint").alias("start"), F.get(names, F.col("w.template")).alias("license"), F.col("w.dice").alias("dice"))
    return named.join(met.select("row", "number", "doc_id"), ["row", "number"]).select("doc_id", "number", "start", "license", "dice")


def scan(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, unit, number, start, license, dice`` for every piece of ``(doc_id, text)`` that reaches ``threshold`` with a template, and
    for every notice inside a paragraph (unit ``window``, see ``windows``; the others start at word 0).

    The best template names the license, of equal ones the first in the list. Null and wordless texts have no pieces to
    compare. Repeated rows come back once each; other columns are not read. An empty table gives an empty result. A very long text
    is split in one task, its bigrams are rows of their own.
    """
    least = F.broadcast(templates(docs.sparkSession, texts))  # a fixed list
    sizes = [len(_words(t)) for _, t in texts]
    sizes = [max(n - 1, min(n, 1)) for n in sizes]
    low, high = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    open_ = pieces(docs.select("doc_id", "text"), low, high).select(
        "row", "doc_id", "unit", "number", "n", F.split("plain", " ").alias("words")).select(
        "row", "doc_id", "unit", "number", "n", F.explode(bigrams(F.col("words"))).alias("bigram"))
    bound = 2 * F.least(F.col("n"), F.col("size")) >= threshold * (F.col("n") + F.col("size"))
    shared = open_.join(least, "bigram").where(bound).groupBy(
        "row", "doc_id", "unit", "number", "n", "template", "license", "size", "bigram").agg(
        F.least(F.count("*"), F.first("times")).alias("both"))
    dice = shared.groupBy("row", "doc_id", "unit", "number", "n", "template", "license", "size").agg(
        (2.0 * F.sum("both") / (F.col("n") + F.col("size"))).alias("dice")).where(F.col("dice") >= threshold)
    best = dice.groupBy("row", "doc_id", "unit", "number").agg(
        F.max(F.struct("dice", (-F.col("template")).alias("order"), "license")).alias("best"))
    pieced = best.select("doc_id", "unit", "number", F.lit(0).cast("bigint").alias("start"), F.col("best.license").alias("license"),
                         F.col("best.dice").alias("dice"))
    return pieced.unionByName(windows(docs, texts, threshold).withColumn("unit", F.lit("window")))


def _words(text: str) -> list[str]:
    """Words of a template in normal form."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()
