"""Find licence notices: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a shingle (a shorter template's shingle is all its words), and the share of a template's shingles that a window must hold.
K, CONTAINED = 5, 0.75
#: Characters of a piece of a text, at least. A word longer than LONG, and than all of the templates, isn't a template's; it counts as a word without letters.
PIECE, LONG = 16384, 64
#: Bands of one MinHash value each. A window that holds the share wanted of a template has a Jaccard similarity to it of
#: at least 0.5 (see :func:`window`), so all bands miss with a probability of at most 0.5 ** 16 = 0.000015.
BANDS = 16

#: Public licence notices, as their licences ask for or as they are commonly written.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the terms of the MIT license.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def template_shingles(text: str) -> list[str]:
    """Distinct shingles of a template in order; one of all its words if it has fewer than ``K``."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    return list(dict.fromkeys(" ".join(words[i : i + K]) for i in range(max(1, len(words) - K + 1))))


def window(n: int) -> tuple[int, int]:
    """(length, stride) in shingles of the windows for a template of ``n``.

    Some window holds any run of ``n`` consecutive shingles whole, and none is longer than the least that grants
    it at this stride: under 1.25 n. With 0.75 n in common the union is under 1.5 n.
    """
    stride = max(1, n // 4)
    return n + stride - 1, stride


def anchors(shingles: dict[str, list[str]]) -> list[str]:
    """Words, or runs of three, of which each text that holds enough of any template has at least one.

    Of each template's shingles, less than 1 - CONTAINED are left without one of them. Words of seven letters or more come
    first; other shingles are covered by runs of three words.
    """

    def parts(shingle: str) -> list[str]:
        words = shingle.split()
        return [w for w in words if len(w) >= 7] + [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]

    chosen: list[str] = []
    while True:
        left = {t: [s for s in ss if not any(f" {a} " in f" {s} " for a in chosen)] for t, ss in shingles.items()}
        open_ = [s for t, ss in left.items() if len(ss) > (1 - CONTAINED) * len(shingles[t]) - 1e-9 for s in ss]
        if not open_:
            return chosen
        found = sorted({p for s in open_ for p in parts(s)})
        chosen.append(max(found, key=lambda p: (" " not in p, sum(f" {p} " in f" {s} " for s in open_))))


def _literals(values: list) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _hashes(band: int) -> Column:
    return F.transform("s", lambda x: F.xxhash64(x, F.lit(band)))


def _pieces(docs: DataFrame, need: int, longest: int, chosen: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, first, own, w): the words of overlapping pieces of each text with an anchor word.

    ``first`` is the number of the piece's first word in the text, ``own`` how many words lie before the next piece; ``need`` words (if
    the text has them) of what follows are added, so each run of so many words lies whole in the piece in which it begins.
    """
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = F.concat(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), F.lit(" "))
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("t")).where(F.concat(F.lit(" "), F.col("t")).rlike(chosen))
    short = F.regexp_replace("t", f"[a-z0-9]{{{longest + 1},}}", "-")
    # whole words, each with the blank behind it; so a piece's beginning holds a word for each longest + 1 characters at least
    size = max(PIECE, 2 * need * (longest + 1))
    # explode(array(x)) keeps x from being written out, and so computed, wherever it is used
    rows = rows.select("doc_id", F.explode(F.array(F.regexp_extract_all(short, F.lit(f"(?s).{{0,{size}}}[^ ]* "), F.lit(0)))).alias("p"))
    counts = F.transform("p", lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))))
    rows = rows.select("doc_id", "p", F.explode(F.array(counts)).alias("n"))
    before = F.aggregate("n", F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
    rows = rows.select("doc_id", "p", "n", F.explode(F.array(before)).alias("before"))
    more = lambda i: F.substring(F.coalesce(F.get("p", i + 1), F.lit("")), 1, need * (longest + 1))
    piece = F.transform("n", lambda n, i: F.struct(F.get("before", i).alias("first"), n.alias("own"), F.concat(F.get("p", i), more(i)).alias("t")))
    rows = rows.select("doc_id", F.explode(piece).alias("x")).select("doc_id", "x.first", "x.own", "x.t").where(F.concat(F.lit(" "), F.col("t")).rlike(chosen))
    # what lies behind the words needed may be a part of a word
    return rows.select("doc_id", "first", "own", F.explode(F.array(F.slice(F.split(F.trim("t"), " "), F.lit(1), F.col("own") + need))).alias("w"))


def _scanned(docs: DataFrame, shingles: dict[str, list[str]], k: int, id_col: str, text_col: str) -> DataFrame:
    """The windows found of templates whose shingles have ``k`` words: doc_id, license, containment, first_word."""
    spark = docs.sparkSession
    values = sorted({s for own in shingles.values() for s in own})
    # the templates' own hashes, by the same expressions: as many numbers as shingles and bands
    hashed = spark.range(1).select(*(_literals(values).alias("v"),)).select(F.explode("v").alias("s")).select("s", *(F.xxhash64("s", F.lit(b)).alias(f"b{b}") for b in range(BANDS))).collect()
    minima = {name: [min(r[f"b{b}"] for r in hashed if r["s"] in set(own)) for b in range(BANDS)] for name, own in shingles.items()}
    need = max(window(len(own))[0] for own in shingles.values()) + k
    longest = max(LONG, *(len(w) for s in values for w in s.split()))
    rows = _pieces(docs, need, longest, f" (?:{'|'.join(anchors(shingles))}) ", id_col, text_col).where(F.size("w") >= k)
    rows = rows.select("doc_id", "first", "own", F.explode(F.array(F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.array_join(F.slice("w", i + 1, k), " ")))).alias("s"))
    rows = rows.where(F.arrays_overlap("s", _literals(values)))
    rows = rows.select("doc_id", "first", "own", "s", F.explode(F.array(F.array(*(_hashes(b) for b in range(BANDS))))).alias("h"))
    # a window without any template's shingle shares no MinHash value; windows are formed around the others only
    known = _literals(sorted(r["b0"] for r in hashed))
    places = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.array_contains(known, F.col("h")[0][i]))
    rows = rows.select("doc_id", "first", "own", "s", "h", F.explode(F.array(places)).alias("places"))
    bands = F.sequence(F.lit(0), F.lit(BANDS - 1))

    def found(name: str, own: list[str]) -> Column:
        length, stride = window(len(own))
        # windows begin at multiples of the stride, counted from the text's beginning: those that begin in the piece and hold a place
        lowest = F.ceil(F.col("first") / stride)
        low = lambda i: F.greatest(lowest, F.ceil((F.col("first") + i - (length - 1)) / stride))
        high = lambda i: F.least(F.floor((F.col("first") + i) / stride), F.ceil((F.col("first") + F.col("own")) / stride) - 1)
        runs = F.transform("places", lambda i: F.when(low(i) <= high(i), F.sequence(low(i), high(i))).otherwise(F.array().cast("array<bigint>")))
        starts = F.transform(F.array_distinct(F.flatten(runs)), lambda x: (x * stride - F.col("first")).cast("int"))
        least = _literals(minima[name])
        retrieved = F.filter(starts, lambda x: F.exists(bands, lambda b: F.array_min(F.slice(F.col("h")[b], x + 1, length)) == least[b]))
        held = F.transform(retrieved, lambda x: F.struct((F.size(F.array_intersect(F.slice("s", x + 1, length), _literals(own))) / len(own)).alias("containment"), (-x - F.col("first")).alias("at")))
        return F.transform(F.filter(held, lambda x: x["containment"] >= CONTAINED), lambda x: F.struct(F.lit(name).alias("license"), x["containment"].alias("containment"), x["at"].alias("at")))

    return rows.select("doc_id", "first", F.explode(F.flatten(F.array(*(found(name, own) for name, own in shingles.items())))).alias("f")).select("doc_id", "f.license", "f.containment", "f.at")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every template of which a window of a document holds 75 % or more of the distinct five-word shingles.

    Words are runs of a-z and 0-9 after lower-casing. For each template, overlapping windows of its own length and stride cover the
    whole text, those without a shingle of any template being skipped; a window is retrieved if one of ``BANDS`` MinHash values equals the template's, and its shingles
    are then compared with the template's as strings. Texts without any anchor word, or without any
    shingle of a template, can't hold one and are put aside first; this loses nothing. A text is cut into
    overlapping pieces of some 16 KB, so a text of any length is treated whole, and its hashes for one piece at a time. A template of fewer
    than five words is one shingle of all of them. All is done by built-in functions; only the windows found are grouped by document.

    Returns a row for each document row and template found: ``doc_id, license, containment`` (of the best
    window, the first of equals), ``first_word`` (its position, from 0), ``windows`` (verified ones). Null and empty texts
    hold none; rows that repeat are scanned each; without templates or rows there is no result.
    """
    shingles = {name: template_shingles(text) for name, text in (TEMPLATES if templates is None else templates).items()}
    lengths = {name: len(own[0].split()) for name, own in shingles.items() if own != [""]}
    rows = docs.withColumn("__row", F.struct(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("doc_id")))
    parts = [_scanned(rows, {name: shingles[name] for name, n in lengths.items() if n == k}, k, "__row", text_col) for k in sorted(set(lengths.values()))]
    if not parts:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"), F.lit(0).alias("windows")).limit(0)
    best = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "license").agg(F.max(F.struct("containment", "at")).alias("best"), F.count("*").cast("int").alias("windows"))
    return best.select("doc_id.doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.at")).cast("int").alias("first_word"), "windows")
