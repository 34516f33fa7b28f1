"""Licences of files: TF-IDF cosine to templates, then inheritance along paths.

All of it is DataFrame functions.  Every line and run of adjoining lines of every
file is a possible header; licence files are also compared as a whole, with full
texts.  Parts and templates are sparse TF-IDF vectors over words; document
frequencies of all words are counted over the whole corpus.  A file's own licence
is that of its most similar part.  A file without one inherits from the licence file of its
nearest ancestor directory, by joining directories, not files, along paths.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import staged

# Short notices of common licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal, public domain dedication."),
    ("proprietary", "All rights reserved."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    *[(f"{short}GPL-{v}.0", f"{t} is free software: you can redistribute it and/or modify it under the terms of the GNU {long}General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.")
      for short, long, v, t in (("", "", 2, "This program"), ("", "", 3, "This program"), ("L", "Lesser ", 3, "This library"), ("A", "Affero ", 3, "This program"))],
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
]

THRESHOLD = 0.8
#: Between words; one match takes a whole run of signs.
BETWEEN = r"(?<![.+-])[.+-]*+[^a-z0-9.+-][^a-z0-9]*"
#: Between blocks: lines without words.
BREAK = r"\n[^a-z0-9]*\n"
HOLDER = r"^(LICEN[SC]E|COPYING)(\..*)?$"


def _tokens(text: Column) -> Column:
    """Lower-case words; full stops, plus and minus signs at their ends go."""
    return F.filter(F.split(F.btrim(F.lower(text), F.lit(".+-")), BETWEEN), lambda w: w != "")


def full_texts() -> list[tuple[str, str]]:
    """Full texts of licences, by name."""
    return [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def template_vectors(spark: SparkSession, idf: DataFrame, n: int, templates: list[tuple[str, str]], full: list[tuple[str, str]]) -> DataFrame:
    """``template``, ``full``, ``licence``, ``word``, ``weight``, of length one.
    ``n``: the number of files, for words that none of them has."""
    texts = [(i, i >= len(templates), name, text) for i, (name, text) in enumerate([*templates, *full])]
    rows = spark.createDataFrame(texts, "template int, full boolean, licence string, t string")
    of = ["template", "full", "licence"]
    counts = rows.select(*of, F.explode(_tokens(F.col("t"))).alias("word")).groupBy(*of, "word").count()
    weighted = counts.join(idf, "word", "left").withColumn("x", F.col("count") * F.coalesce("idf", F.log(F.lit(n + 1.0)) + 1))
    norm = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return weighted.join(norm, "template").select(*of, "word", (F.col("x") / F.col("norm")).alias("weight"))


def key_words(vectors: list, threshold: float) -> list[str]:
    """Words of which a text must have one to come near a template.  A text
    without them shares only what is left of a template, whose length bounds
    the cosine."""
    by: dict[int, list] = {}
    for r in vectors:
        by.setdefault(r["template"], []).append(r)
    keys: set[str] = set()
    for rows in by.values():
        left = 1.0
        for r in sorted(rows, key=lambda r: (-r["weight"], r["word"])):
            if left < (threshold - 1e-9) ** 2:
                break
            keys.add(r["word"])
            left -= r["weight"] ** 2
    return sorted(keys)


def _runs(lines: Column, keys: Column, most: int) -> Column:
    """Of a block's lines (word arrays): each run of adjoining lines, single lines
    included, that has a key word and at most ``most`` words, or one line."""
    none = F.array().cast("array<array<string>>")

    def longer(s: Column, w: Column) -> Column:
        now = F.concat(s["now"], w)
        fits = ~s["over"] & ((F.size(now) <= most) | (F.size(s["now"]) == 0))
        return F.struct(
            F.when(fits, now).otherwise(s["now"]).alias("now"),
            F.when(fits, F.concat(s["runs"], F.array(now))).otherwise(s["runs"]).alias("runs"),
            (~fits).alias("over"),
        )

    start = F.struct(F.array().cast("array<string>").alias("now"), none.alias("runs"), F.lit(False).alias("over"))
    return F.filter(F.aggregate(lines, start, longer, lambda s: s["runs"]), lambda w: F.arrays_overlap(w, keys))


def own_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, full: list[tuple[str, str]] | None = None) -> DataFrame:
    """``file_id``, ``licence``, ``similarity`` of files with a part whose cosine to
    a template is ``threshold`` or more; the best, and of equals the first by name.

    Parts are lines, runs of adjoining lines and whole blocks (lines up to one
    without words), which are compared with ``templates``, and, if there is a
    ``path``, whole licence files, which are compared with the ``full`` texts too.
    Runs have up to twice the words of the longest template; a longer one that is
    near it has a shorter one nearer, unless it repeats the template's words.
    The templates are fixed lists, whose size bounds what is sent to executors.
    """
    spark = files.sparkSession
    full = full_texts() if full is None else full
    n = files.count()
    text = F.coalesce(F.col("text"), F.lit(""))
    df = files.select(F.explode(F.array_distinct(_tokens(text))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = staged(df.select("word", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf")), "idf")
    vectors = staged(template_vectors(spark, idf, n, templates, full), "templates")
    notices = vectors.where("NOT full").collect()  # the words of a fixed list
    keys = F.array(*[F.lit(w) for w in key_words(notices, threshold)])
    most = 2 * max((len(t.split()) for _, t in templates), default=0)

    # generated code splits blocks and looks for key words; the few left are cut into runs
    of = ["file_id", "h", "block", "first", "run"]
    key = ["file_id", F.xxhash64("text").alias("h")]
    blocks = files.select(*key, F.posexplode(F.split(F.lower(text), BREAK)).alias("block", "text"))
    blocks = blocks.withColumn("w", _tokens(F.col("text"))).where(F.arrays_overlap("w", keys))
    lines = F.transform(F.split("text", "\n"), lambda x: _tokens(x))
    lines = staged(blocks.select("file_id", "h", "block", F.filter(lines, lambda x: F.size(x) > 0).alias("lines")), "blocks")
    starts = lines.select("file_id", "h", "block", F.posexplode(F.transform("lines", lambda _, i: F.slice("lines", i + 1, most))).alias("first", "from"))
    runs = starts.select("file_id", "h", "block", "first", F.posexplode(_runs(F.col("from"), keys, most)).alias("run", "w"))
    whole = lines.where(F.size("lines") > 1).select("file_id", "h", "block", F.lit(-1).alias("first"), F.lit(0).alias("run"), F.flatten("lines").alias("w")).where(F.size("w") > most)
    parts = runs.unionByName(whole).withColumn("entire", F.lit(False))
    if "path" in files.columns:
        holders = files.where(_name(F.col("path")).rlike(HOLDER)).select(*key, _tokens(text).alias("w"))
        parts = parts.unionByName(holders.select("*", F.lit(-1).alias("block"), F.lit(-1).alias("first"), F.lit(0).alias("run"), F.lit(True).alias("entire")))
    counts = parts.select(*of, "entire", F.explode("w").alias("word")).groupBy(*of, "entire", "word").count()
    weighted = counts.join(idf, "word").withColumn("x", F.col("count") * F.col("idf"))
    weighted = staged(weighted.drop("count", "idf"), "weighted")
    norm = weighted.groupBy(*of).agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    dots = (
        weighted.join(F.broadcast(vectors), "word")
        .where(F.col("entire") | ~F.col("full"))
        .groupBy(*of, "template", "licence")
        .agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    )
    same = [dots[c].eqNullSafe(norm[c]) for c in of]
    cosine = dots.join(norm, same).select(dots["file_id"], "licence", F.round(F.col("dot") / F.sqrt("square"), 9).alias("similarity"))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "licence")).alias("m")
    return cosine.where(F.col("similarity") >= threshold).groupBy("file_id").agg(best).select(
        "file_id", "m.licence", (-F.col("m.s")).alias("similarity")
    )


def _name(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, r"([^/]*)$", 1))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``file_id``, ``path``, ``own_licence``, ``similarity``, ``licence``,
    ``inherited_from`` of every row of ``file_id``, ``path``, ``text``.

    A licence file is one named ``LICENSE`` or ``COPYING``, with any ending; it
    speaks for its directory and all below it that have no nearer one.  Several
    in one directory: the most similar, then the first by name.  A file without
    an own licence takes that of the nearest such directory, ``inherited_from``
    (empty for the root).  Files with neither, null and empty texts, and null
    paths (no directory) have null.  ``file_id`` names the row; rows that repeat
    it share the best licence.  An empty table gives no rows.  Other columns
    are ignored.
    """
    own = staged(own_licences(files, templates, threshold), "own-licences")
    rows = files.select("file_id", "path", _parent(F.col("path")).alias("dir"))
    holders = rows.where(_name(F.col("path")).rlike(HOLDER)).join(own, "file_id")
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "licence")).alias("m")
    speaks = staged(holders.groupBy("dir").agg(best).select(F.col("dir").alias("ancestor"), F.col("m.licence").alias("inherited")), "directories")
    # Each directory once, whatever the number of its files, with its ancestors.
    dirs = rows.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    nearest = (
        dirs.select("dir", F.explode(F.array_distinct(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(up))).alias("ancestor"))
        .join(speaks, "ancestor")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "inherited")).alias("m"))
        .select("dir", F.col("m.ancestor").alias("ancestor"), F.col("m.inherited").alias("inherited"))
    )
    joined = rows.join(own, "file_id", "left").join(nearest, "dir", "left")
    has = F.col("licence").isNotNull()
    return joined.select(
        "file_id",
        "path",
        F.col("licence").alias("own_licence"),
        "similarity",
        F.coalesce("licence", "inherited").alias("licence"),
        F.when(~has, F.col("ancestor")).alias("inherited_from"),
    )
