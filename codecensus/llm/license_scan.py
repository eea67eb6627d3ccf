"""License scans by MinHash over overlapping windows, in column expressions only.

Templates are classed by their number of shingles: class T holds those with T / 2 < t <= T. Documents are read in windows
of T + S shingles, one each S = max(1, T / 4) shingles, so that every run of T shingles lies in one. A window that holds a
whole template resembles it by at least 0.4, one with four fifths of it by 0.3. With 24 bands of one row the chance to meet
in no band is 5e-6 and 2e-4. What meets is confirmed by the exact share of the template's shingles in the document.

A template can only be confirmed where enough of its weight occurs, so each has a guard: words of which every choice of
shingles with four fifths of its weight holds one. Texts and windows without a guard word of any template are passed over.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codecensus.llm.common import any_of
from codecensus.llm.native import SHINGLE, bounded, contained, exploded, hashes, shingle_hashes, weighted_shingles, words
from codecensus.session import cut

GAP = r"[^a-z0-9]+"
BANDS = 24
SIMILAR_PERCENT = 80

#: Notices as their licenses word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
                "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(templates.items()), "license string, text string")


def guard_words(templates: dict[str, str], percent: int = SIMILAR_PERCENT, size: int = SHINGLE) -> list[str]:
    """Words such that a text with ``percent`` of a template's weight holds one of them: longest words first."""
    sets = {}
    for name, text in templates.items():
        found = [w for w in re.split(GAP, text.lower()) if w]
        sets[name] = {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}
    held = Counter(s for shingles in sets.values() for s in shingles)
    weight = {s: max(1, 1000 // n) for s, n in held.items()}  # as weighted_shingles has it
    chosen: set[str] = set()
    for shingles in sets.values():
        total = sum(weight[s] for s in shingles)
        while (free := [s for s in shingles if not chosen & set(s)]) and 100 * sum(weight[s] for s in free) >= percent * total:
            gain: Counter = Counter()
            for s in free:
                for w in set(s):
                    gain[w] += weight[s]
            chosen.add(max(gain, key=lambda w: (len(w) >= 7, gain[w] * len(w), w)))
    return sorted(chosen)


def class_of(shingles: int) -> int:
    return 1 << max(0, shingles - 1).bit_length()


def seeds(bands: int = BANDS) -> list[int]:
    return [int(x) for x in np.random.default_rng(6).integers(-(2**63), 2**63 - 1, bands)]


def _minima(shingles: Column, size: int, bands: int) -> Column:
    """Keys of a window: for each band the least hash under the band's mask, with band and class mixed in.

    XOR with a constant permutes the hashes; the least of random hashes under a permutation falls on each alike.
    """
    def least(mask: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(F.lit(mask))))

    return F.array(*[F.xxhash64(F.lit(size), F.lit(b), least(mask)) for b, mask in enumerate(seeds(bands))])


def _slices(items: str, starts: Column, length: int) -> Column:
    return F.transform(starts, lambda i: F.slice(items, i + 1, F.lit(length)))


def _starts_near(mark: Column, reach: int, step: int) -> Column:
    """Multiples of ``step`` from which ``reach`` words hold the word at ``mark``."""
    first = F.greatest(F.lit(0), F.ceil((mark - reach + 1) / step).cast("int"))
    return F.transform(F.sequence(first, F.greatest(first, F.floor(mark / step).cast("int"))), lambda k: k * step)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: dict[str, str] | None = None, bands: int = BANDS,
                  percent: int = SIMILAR_PERCENT) -> DataFrame:
    """(doc_id, license, shared, total, containment): documents that hold ``percent`` of a template's weighted five-word shingles.

    Words are runs of a-z and 0-9 of the lower-cased text. Templates of fewer than five words match nothing. Null and empty
    texts hold nothing; rows that repeat an id are one document. An empty table gives an empty result; other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    listed = template_table(spark, templates)
    parts = cut(weighted_shingles(listed, "license", "text", "license", GAP))
    sets = parts.groupBy("license").agg(F.collect_set("x").alias("xs"))
    classes = sorted({class_of(n) for t in templates.values() if (n := len([w for w in re.split(GAP, t.lower()) if w]) - SHINGLE + 1) > 0})
    guards = guard_words(templates, percent) or [""]
    holds = any_of([F.contains(F.lower("text"), F.lit(g)) for g in guards])
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(holds)
    # Places of guard words; window i begins with shingle i and ends four words after its last shingle.
    read = texts.select("_id", words(F.col("text"), GAP).alias("w"))
    marked = F.filter(F.transform("w", lambda x, i: F.when(x.isin(guards), i)), lambda i: i.isNotNull())
    shingled = cut(read.select("_id", hashes(F.col("w")).alias("h"), marked.alias("marks")).select("_id", shingle_hashes(F.col("h")).alias("s"), "marks"))
    met = []
    for t in classes:
        step = max(1, t // 4)
        # Of the windows 0, S, 2 S, ... those that reach a mark; one that begins past the last shingle is empty.
        near = F.flatten(F.transform("marks", lambda m: _starts_near(m, t + step + SHINGLE - 1, step)))
        starts = F.filter(F.array_distinct(near), lambda i: i < F.size("s"))
        windows = exploded(shingled, _slices("s", starts, t + step), "w", "_id")
        keys = exploded(windows, _minima(F.col("w"), t, bands), "key", "_id")
        filed = sets.where(F.size("xs").between(t // 2 + 1, t)).select("license", F.explode(_minima(F.col("xs"), t, bands)).alias("key"))
        met.append(keys.join(bounded(filed), "key").select("_id", "license"))
    pairs = met[0] if met else texts.select("_id", F.lit("").alias("license")).limit(0)
    for more in met[1:]:
        pairs = pairs.union(more)
    pairs = cut(pairs.distinct())
    found = contained(texts, pairs, parts, "license", GAP, percent)
    return found.select(F.col("_id").alias("doc_id"), "license", "shared", "total", (F.col("shared") / F.col("total")).alias("containment"))
