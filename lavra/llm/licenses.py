"""Licence notices in documents by Dice coefficient over word bigrams, each counted as often as it is there.

Lines, blocks between blank lines, and whole texts are held against templates; a notice inside a longer part
is found in windows of its template's length. A part of b bigrams can reach the threshold only with
templates whose size is within a fixed ratio of b, so parts are left out by their word count before any
bigram is built. A part that reaches it misses at most a third of a template's bigrams, so it holds one of
the third, and one more, that were chosen as anchors, the longest ones: texts without an anchor are left out
first, and anchors place the windows. Built-in functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lavra.session import fence, stage

THRESHOLD = 0.8

# The notices that the licences themselves, or common usage, prescribe.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


# What normalising replaces, in this order; a word is a run of letters, digits and inner full stops.
STEPS = ((r"[^\p{L}\p{N}.\n]+", " "), (r"\.+([ \n]|\z)", " $1"), (r" *\n *", "\n"), (" +", " "))


def normal(text: Column) -> Column:
    """Lower case, with single spaces between words, and with its line ends."""
    text = F.lower(text)
    for pattern, new in STEPS:
        text = F.regexp_replace(text, pattern, new)
    return text


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, "\n+", " ")), " ")


def _bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


@dataclass
class Templates:
    """``bigrams`` has a row per template and distinct bigram, ``anchors`` one per template and anchor with its place."""

    bigrams: DataFrame
    anchors: DataFrame
    anchor_list: list[str]
    least: int
    most: int


def _templates(spark: SparkSession, templates, threshold: float) -> Templates:
    """The table is small and fixed, so it may pass through the driver."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, license string, notice string")
    table = table.select("template", "license", _bigrams(_words(normal(F.col("notice")))).alias("b")).collect()
    ratio = threshold / (2 - threshold)
    bigrams, anchors, bounds = [], [], []
    for i, name, b in table:
        size = len(b)
        low, high = math.ceil(size * ratio - 1e-9), math.floor(size / ratio + 1e-9)
        bounds += [low, high]
        bigrams += [(i, name, size, low, high, x, b.count(x)) for x in sorted(set(b))]
        longest = sorted(range(size), key=lambda at: (-len(b[at]), b[at].encode(), at))
        anchors += [(i, size, b[at], at) for at in longest[: size - low + 1]]
    return Templates(
        spark.createDataFrame(bigrams, "template int, license string, size int, low int, high int, bigram string, times int"),
        spark.createDataFrame(anchors, "template int, size int, bigram string, place int"),
        sorted({a[2] for a in anchors}), min(bounds), max(bounds),
    )


def _alike(parts: DataFrame, known: Templates, threshold: float) -> DataFrame:
    """Of ``(key, row, part, only, w)``: the best Dice of each part and licence at the threshold or above.

    A part whose ``only`` is not null is held against that template alone.
    """
    sized = parts.withColumn("n", F.size("w") - 1).where(F.col("n").between(known.least, known.most))
    pairs = sized.select("key", "row", "part", "only", "n", F.explode(_bigrams(F.col("w"))).alias("bigram"))
    fits = F.col("n").between(F.col("low"), F.col("high")) & (F.col("only").isNull() | (F.col("only") == F.col("template")))
    hits = pairs.join(F.broadcast(known.bigrams), "bigram").where(fits)
    keys = ("key", "row", "part", "template", "license", "n", "size")
    common = hits.groupBy(*keys, "bigram", "times").agg(F.count("*").alias("here")).groupBy(*keys)
    common = common.agg(F.sum(F.least("here", "times")).alias("common"))
    dice = 2.0 * F.col("common") / (F.col("n") + F.col("size"))
    return common.withColumn("dice", dice).where(F.col("dice") >= threshold).groupBy("key", "row", "part", "license").agg(F.max("dice").alias("dice"))


def license_scan(
    docs: DataFrame, *, key="doc_id", text="text", templates=TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """Per key and licence found: ``license``, the best ``dice``, and ``n_units``, how many parts reach it.

    Null and wordless texts give no rows. Parts of one document that are equal count once each as they
    stand; a line that is its own block and text counts once. Where no part of a row reaches a licence, its
    windows as long as a template, placed by the template's anchors, are held against it and count as one.
    Rows that repeat a key add up. The table of templates is small and fixed; other columns of ``docs`` are
    not read.
    """
    known = _templates(docs.sparkSession, templates, threshold)
    rows = docs.select(F.col(key).alias("key"), normal(F.col(text).cast("string")).alias("n"), F.monotonically_increasing_id().alias("row"))
    rows = fence(rows.where(F.col("n").isNotNull()), _words(F.col("n")).alias("w"))
    placed = F.transform(_bigrams(F.col("w")), lambda x, i: F.struct(i.alias("at"), x.alias("bigram")))
    rows = fence(rows, F.filter(placed, lambda x: x["bigram"].isin(known.anchor_list)).alias("hits"), keep=["key", "row", "n"])
    rows = stage(rows.where(F.size("hits") > 0), "anchored")

    lines = F.transform(F.split("n", "\n"), lambda x: F.struct(F.lit("l").alias("kind"), x.alias("t")))
    blocks = F.transform(F.split("n", "\n\n+"), lambda x: F.struct(F.lit("b").alias("kind"), F.translate(x, "\n", " ").alias("t")))
    whole = F.array(F.struct(F.lit("w").alias("kind"), F.regexp_replace("n", "\n+", " ").alias("t")))
    # A text of one line is one part, a block of one line too.
    parts = F.concat(lines, F.when(F.instr("n", "\n") > 0, F.concat(blocks, whole)).otherwise(F.array().cast("array<struct<kind:string,t:string>>")))
    parts = rows.select("key", "row", F.posexplode(parts).alias("part", "u"))
    parts = fence(parts, F.split(F.trim("u.t"), " ").alias("w"), F.lit(None).cast("int").alias("only"), keep=["key", "row", "part"])
    best = stage(_alike(parts, known, threshold), "parts")

    starts = rows.select("key", "row", F.explode("hits").alias("hit")).select("key", "row", "hit.*").join(F.broadcast(known.anchors), "bigram")
    starts = starts.select("key", "row", "template", "size", (F.col("at") - F.col("place")).alias("start")).distinct()
    starts = starts.groupBy("row").agg(F.collect_list(F.struct("template", "size", "start")).alias("starts"))
    windows = fence(rows.join(starts, "row"), _words(F.col("n")).alias("w"), keep=["key", "row", "starts"])
    first = F.greatest(F.col("s.start"), F.lit(0))
    length = F.least(F.col("s.start") + F.col("s.size") + 1, F.size("w")) - first
    windows = windows.select("key", "row", "w", F.posexplode("starts").alias("part", "s")).where(length > 1)
    windows = fence(windows, F.slice("w", first + 1, length).alias("w"), F.col("s.template").alias("only"), keep=["key", "row", "part"])
    inside = _alike(windows, known, threshold).groupBy("key", "row", "license").agg(F.max("dice").alias("dice"))
    inside = inside.join(best.select("row", "license"), ["row", "license"], "left_anti")

    best = best.select("key", "license", "dice").unionByName(inside.select("key", "license", "dice"))
    out = best.groupBy("key", "license").agg(F.max("dice").alias("dice"), F.count("*").alias("n_units"))
    return out.select(F.col("key").alias(key), "license", "dice", "n_units")


def scan_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan of ``documents`` in DuckDB's SQL."""

    def plain(text: str) -> str:
        text = f"lower({text})"
        for pattern, new in STEPS:
            new = new.replace("$1", "\\1").replace("\n", "' || chr(10) || '")
            pattern = pattern.replace("\n", "\\n")
            text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
        return text

    values = ", ".join(f"({i}, '{name}', '{notice.replace(chr(39), chr(39) * 2)}')" for i, (name, notice) in enumerate(templates))
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    low = f"ceil(size * {threshold / (2 - threshold)} - 1e-9)"

    def alike(parts: str) -> str:
        return f"""(
            SELECT r, doc_id, part, license, max(2::DOUBLE * common / (n + size)) AS dice FROM (
                SELECT r, doc_id, part, n, i, license, size, sum(least(here, times)) AS common FROM (
                    SELECT r, doc_id, part, only_i, n, bigram, count(*) AS here
                    FROM (SELECT r, doc_id, part, only_i, len(w) - 1 AS n, unnest({pairs}) AS bigram FROM {parts} WHERE len(w) BETWEEN 2 AND 200)
                    GROUP BY ALL
                ) JOIN tb USING (bigram) WHERE only_i IS NULL OR only_i = i GROUP BY ALL
            ) WHERE 2::DOUBLE * common / (n + size) >= {threshold} GROUP BY ALL
        )"""

    return f"""
    WITH t AS (SELECT i, license, string_split(trim(replace({plain("notice")}, chr(10), ' ')), ' ') AS w FROM (VALUES {values}) AS v(i, license, notice)),
    tp AS (SELECT i, license, len(w) - 1 AS size, unnest({pairs}) AS bigram, unnest(range(0, len(w) - 1)) AS place FROM t),
    tb AS (SELECT i, license, size, bigram, count(*) AS times FROM tp GROUP BY ALL),
    ta AS (
        SELECT i, size, bigram, place FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY length(bigram) DESC, bigram, place) AS k FROM tp)
        WHERE k <= size - {low} + 1
    ),
    d AS (SELECT row_number() OVER () AS r, doc_id, {plain("text")} AS n FROM documents WHERE text IS NOT NULL),
    u AS (
        SELECT r, doc_id, 'l' || generate_subscripts(x, 1) AS part, unnest(x) AS s FROM (SELECT r, doc_id, string_split(n, chr(10)) AS x FROM d)
        UNION ALL
        SELECT r, doc_id, 'b' || generate_subscripts(x, 1), replace(unnest(x), chr(10), ' ')
        FROM (SELECT r, doc_id, string_split_regex(n, '\\n\\n+') AS x FROM d WHERE contains(n, chr(10)))
        UNION ALL
        SELECT r, doc_id, 'w', regexp_replace(n, '\\n+', ' ', 'g') FROM d WHERE contains(n, chr(10))
    ),
    ws AS (SELECT r, doc_id, part, NULL::INT AS only_i, string_split(trim(s), ' ') AS w FROM u),
    f AS {alike("ws")},
    dw AS (SELECT r, doc_id, string_split(trim(regexp_replace(n, '\\n+', ' ', 'g')), ' ') AS w FROM d),
    h AS (SELECT r, unnest({pairs}) AS bigram, unnest(range(0, len(w) - 1)) AS pos FROM dw WHERE len(w) > 1),
    st AS (SELECT DISTINCT r, i, size, pos - place AS s FROM h JOIN ta USING (bigram)),
    wi AS (SELECT r, doc_id, i || ':' || s AS part, i AS only_i, w[greatest(s, 0) + 1 : least(s + size + 1, len(w))] AS w FROM st JOIN dw USING (r)),
    g AS (SELECT r, doc_id, license, max(dice) AS dice FROM {alike("wi")} AS x GROUP BY ALL),
    e AS (
        SELECT doc_id, license, dice FROM f
        UNION ALL
        SELECT doc_id, license, dice FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.r = g.r AND f.license = g.license)
    )
    SELECT doc_id, license, max(dice) AS dice, count(*) AS n_units FROM e GROUP BY ALL
    """
