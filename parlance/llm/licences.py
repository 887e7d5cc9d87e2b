"""Licence notices by MinHash bands over overlapping text windows, in DataFrame functions only.

Templates are cut by length into classes, each with windows a little longer than its templates, so that every occurrence
lies whole in one window and the Jaccard similarity of the two shingle sets has a lower bound. The number of bands
follows from that bound: a window that holds enough of a template misses all bands with a probability under ``MISS``.
Retrieved pairs are verified by exact shingle containment.

A few anchor words are chosen so that a text or a window without any of them holds too few shingles of any template to
match: those are set aside before any hashing, which loses nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-4
#: Words that any prose is full of and that therefore make poor anchors.
COMMON = frozenset("a an and any are as at be by for from has have if in is it may not of on or that the this to under use was will with you".split())
#: Short notices of public licences, as they are found in texts. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def anchors(templates: dict[str, list[str]]) -> list[str]:
    """Words without any of which a text holds less than ``CONTAINMENT`` of every template's shingles.

    Chosen greedily: no common words where others do, then long ones that cover many shingles.
    """
    bare = {n: {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} for n, w in templates.items()}
    enough = {n: CONTAINMENT * len(s) for n, s in bare.items()}
    chosen = []
    while left := [s for n, s in bare.items() if len(s) >= enough[n]]:
        words = {w for group in left for s in group for w in s}
        best = max(sorted(words), key=lambda w: (w not in COMMON, len(w) > 5, sum(w in s for group in left for s in group), len(w)))
        chosen.append(best)
        bare = {n: {s for s in group if best not in s} for n, group in bare.items()}
    return sorted(chosen)


def size_classes(templates: dict[str, list[str]]) -> dict[int, dict[str, list[str]]]:
    """Templates by the number of words, in classes up to 8, 16, 32, ... words."""
    classes: dict[int, dict[str, list[str]]] = {}
    for name, words in templates.items():
        most = 8
        while most < len(words):
            most *= 2
        classes.setdefault(most, {})[name] = words
    return classes


def bands(window: int, shortest: int) -> int:
    """Bands of one row that miss a window with enough of a template with a probability under ``MISS``."""
    held = math.ceil(CONTAINMENT * max(1, shortest - SHINGLE + 1))
    similarity = held / (max(1, window - SHINGLE + 1) + max(1, shortest - SHINGLE + 1) - held)
    return math.ceil(math.log(MISS) / math.log(1 - min(similarity, 0.999)))


def _shingles(words: Column) -> Column:
    count = F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(words, i, SHINGLE))))


def _bands(shingles: Column, count: int) -> Column:
    return F.array(*(F.array_min(F.transform(shingles, _seeded(j))) for j in range(count)))


def _seeded(j: int) -> Callable[[Column], Column]:
    return lambda s: F.xxhash64(s, F.lit(j))


def licence_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text") -> DataFrame:
    """doc_id, licence, containment (largest over windows) and first_word (of the first window with it) of each match.

    Texts are compared in lower case by their runs of ``[a-z0-9]``. Windows of each class start at every multiple of its
    stride and end with the text. Null, empty and short texts match nothing unless they hold a template. Repeated rows
    give one row; rows with a null doc_id are taken as one document. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    own = {name: template_words(t) for name, t in templates.items()}
    sought = anchors(own)
    whole = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select("doc_id", whole.alias("text")).where(F.col("text").rlike("(?<![a-z0-9])(?:" + "|".join(sought) + ")(?![a-z0-9])"))
    rows = rows.select("doc_id", F.filter(F.split("text", "[^a-z0-9]+"), lambda w: w != "").alias("words"))
    found = None
    for most, group in size_classes(own).items():
        longest, shortest = max(map(len, group.values())), min(map(len, group.values()))
        stride = max(1, longest // 2)
        window = longest + stride - 1
        count = bands(window, shortest)
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(stride))
        cut = rows.select("doc_id", "words", F.explode(starts).alias("at")).select("doc_id", "at", F.slice("words", F.col("at") + 1, window).alias("words"))
        cut = cut.where(F.arrays_overlap("words", F.array(*map(F.lit, sought)))).select("doc_id", "at", _shingles(F.col("words")).alias("held"))
        cut = cut.withColumn("band", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(count - 1)).alias("j"), _bands(F.col("held"), count).alias("h"))))
        known = spark.createDataFrame([(n, w) for n, w in group.items()], "licence string, words array<string>").select("licence", _shingles(F.col("words")).alias("wanted"))
        known = known.withColumn("band", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(count - 1)).alias("j"), _bands(F.col("wanted"), count).alias("h"))))
        pairs = cut.join(F.broadcast(known), "band")  # as many rows as templates have bands
        share = F.size(F.array_intersect("wanted", "held")) / F.size("wanted")
        pairs = pairs.select("doc_id", "licence", "at", share.alias("containment")).where(F.col("containment") >= CONTAINMENT)
        found = pairs if found is None else found.union(pairs)
    return found.groupBy("doc_id", "licence").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word"))


def oracle(templates: dict[str, str] = TEMPLATES) -> str:
    """The same by comparing every window with every template."""
    own = {name: template_words(t) for name, t in templates.items()}
    parts = []
    for group in size_classes(own).values():
        longest = max(map(len, group.values()))
        stride = max(1, longest // 2)
        window = longest + stride - 1
        for name, words in group.items():
            wanted = "[" + ", ".join("'" + " ".join(words[i : i + SHINGLE]) + "'" for i in range(max(1, len(words) - SHINGLE + 1))) + "]"
            parts.append(
                f"SELECT doc_id, '{name}' AS licence, pos, len(list_filter(list_distinct({wanted}), lambda s: contains(' ' || array_to_string(words[pos + 1 : pos + {window}], ' ') || ' ', ' ' || s || ' '))) / len(list_distinct({wanted})) AS containment "
                f"FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words), 1), {stride})) AS pos FROM d)"
            )
    return (
        "WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS words FROM documents) "
        f"SELECT doc_id, licence, max(containment) AS containment, min(pos) AS first_word FROM ({' UNION ALL '.join(parts)}) WHERE containment >= {CONTAINMENT} GROUP BY ALL"
    )
